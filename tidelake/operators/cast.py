"""Lossy-tolerant type casting by a plan {column: logical type}. Failures become null and are counted."""
from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates as D
from ..functions import text as X
from ..functions.nullness import strip
from .profile import ROW, q

log = logging.getLogger(__name__)
#: Spellings of the seven logical types.
ALIASES = {"integer": "int", "long": "int", "double": "float", "decimal": "float", "number": "float", "string": "str", "text": "str", "boolean": "bool", "timestamp": "datetime"}
TYPES = ("int", "float", "str", "bool", "date", "datetime", "time")
TRUE, FALSE = ("true", "t", "yes", "y", "1"), ("false", "f", "no", "n", "0")


def logical_type(name: str | None) -> str | None:
    """One of TYPES, or null for an unknown name (no cast)."""
    n = (name or "").strip().lower()
    n = ALIASES.get(n, n)
    return n if n in TYPES else None


def to_float(c: Column) -> Column:
    return X.number_token(c).try_cast("double")


def to_int(c: Column) -> Column:
    """The first number, fractions rounded half to even."""
    return F.bround(to_float(c), 0).try_cast("bigint")


def to_bool(c: Column) -> Column:
    s = F.lower(strip(c.cast("string")))
    return F.when(s.isin(*TRUE), True).when(s.isin(*FALSE), False)


def to_datetime(c: Column) -> Column:
    return D.parse_timestamp(c)


def to_date(c: Column) -> Column:
    return D.parse_timestamp(c).cast("date")


def cast_column(df: DataFrame, name: str, kind: str) -> Column:
    """The cast of one column to a logical type; columns of that physical type stay as they are."""
    c, have = q(name), df.schema[name].dataType
    if kind == "str":
        return c.cast("string")
    if kind in ("float", "int") and isinstance(have, T.NumericType):
        return c.cast("double") if kind == "float" else F.bround(c.cast("double"), 0).try_cast("bigint")
    if kind == "bool":
        return c if isinstance(have, T.BooleanType) else to_bool(c)
    if isinstance(have, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return {"datetime": c.cast("timestamp_ntz"), "date": c.cast("date"), "time": F.date_format(c, "HH:mm:ss")}.get(kind, X.number_token(c).try_cast("double"))
    return {"float": to_float, "int": to_int, "datetime": to_datetime, "date": to_date, "time": D.parse_time}[kind](c)


def cast_columns(df: DataFrame, plan: dict[str, str], order: str = ROW) -> DataFrame:
    """df with the plan's columns cast; columns the table lacks and unknown types are left out. Row count stays."""
    todo = {c: k for c, t in plan.items() if c in df.columns and (k := logical_type(t))}
    for c, k in todo.items():
        if k in ("date", "datetime") and isinstance(df.schema[c].dataType, T.StringType) and order in df.columns:
            df = D.complete_dates(df, c, order)
    return df.select(*(cast_column(df, c, todo[c]).alias(c) if c in todo else q(c) for c in df.columns))


def cast_plan(strategy: dict, columns: list[str] | None = None, expected: dict[str, str] | None = None) -> dict[str, str]:
    """{column: logical type} of a task: the types its strategy names by column (as text or as a document with expected_type), else those that are
    expected of the task's columns. Unknown types are left out."""
    named = {c: (v.get("expected_type") if isinstance(v, dict) else v) for c, v in (strategy.get("per_column") or strategy).items()}
    known = {c: k for c, t in named.items() if isinstance(t, str | None) and (k := logical_type(t))}
    return known or {c: k for c in columns or [] if (k := logical_type((expected or {}).get(c)))}


def cast_checked(df: DataFrame, plan: dict[str, str], order: str = ROW) -> tuple[DataFrame, list[str]]:
    """(df with the columns cast that can be, failed rules). A column whose cast Spark refuses stays as it is; so do missing ones."""
    failed = [f"missing_column:{c}" for c in plan if c not in df.columns] + [f"unknown_type:{c}" for c, t in plan.items() if c in df.columns and not logical_type(t)]
    good = {}
    for c, t in plan.items():
        if c in df.columns and logical_type(t):
            try:
                cast_columns(df, {c: t}, order).schema  # noqa: B018 - a cast that doesn't fit fails on analysis
                good[c] = t
            except (AnalysisException, KeyError) as e:
                failed.append(f"cast_failed:{c}")
                log.warning("the cast of %s to %s is left out: %s", c, t, e)
    return cast_columns(df, good, order), failed


def cast_report(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, dtype_before, dtype_after, nulls_before, nulls_after, coerced_nulls. One aggregate a side."""
    def nulls(df: DataFrame, name: str) -> DataFrame:
        each = [F.struct(F.lit(c).alias("column_name"), F.lit(df.schema[c].dataType.simpleString()).alias(f"dtype_{name}"),
                         (F.count(F.lit(1)) - F.count(q(c))).alias(f"nulls_{name}")) for c in columns]
        return df.agg(F.array(*each).alias("a")).select(F.inline("a"))

    both = nulls(before, "before").join(F.broadcast(nulls(after, "after")), "column_name")
    return both.withColumn("coerced_nulls", F.greatest(F.col("nulls_after") - F.col("nulls_before"), F.lit(0)))


def original_format(df: DataFrame, column: str, order: str = ROW) -> tuple[str | None, str | None]:
    """(regular expression, strftime format) of a column's first value."""
    c = q(column).cast("string")
    first = df.agg(F.min_by(c, F.when(c.isNotNull(), F.col(order)))).first()[0]
    return (None, None) if first is None else (X.regex_of(first), D.format_of(first))


def restore_format(c: Column, strftime: str) -> Column:
    """A cleaned date or date-time written in its original format."""
    java = D.java_format(strftime)
    return F.date_format(c, java) if java else c.cast("string")


def guard(before: DataFrame, after: DataFrame, plan: dict[str, str]) -> list[str]:
    """Failed rules of a cast: missing columns, changed row count."""
    failed = [f"missing_column:{c}" for c in plan if c not in before.columns]
    return failed + ["row_count_changed"] * (before.count() != after.count())
