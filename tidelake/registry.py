"""Name -> query and name -> oracle SQL of everything outside the training-data subpackage."""
from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("profile", "dedup", "clean", "audit", "stream", "suggest", "relational", "versions")


def _modules():
    return [importlib.import_module(f"tidelake.plans.queries_{m}") for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for m in _modules() for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.ORACLES.items()}
