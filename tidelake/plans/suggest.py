"""Suggestions and small look-ups over profiles and specs."""
from __future__ import annotations

import os
import shutil
import uuid
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.profile import q
from .guardrails import column_family
from .specs import ColumnSpec


def key_sets(stats: DataFrame, most: int = 8) -> DataFrame:
    """key_set, unique_ratio: single near-unique and key columns with few nulls, then pairs of regular columns."""
    usable = stats.where("null_rate <= 0.3")
    singles = usable.where("unique_category IN ('primary_key', 'near_unique')").select(F.col("column_name").alias("key_set"), "unique_ratio", F.lit(0).alias("kind"))
    r = usable.where("unique_category = 'regular'")
    pairs = r.alias("a").join(r.alias("b"), F.col("a.column_name") < F.col("b.column_name")).select(
        F.concat_ws(",", "a.column_name", "b.column_name").alias("key_set"), F.greatest("a.unique_ratio", "b.unique_ratio").alias("unique_ratio"), F.lit(1).alias("kind"))
    return singles.unionByName(pairs).orderBy("kind", F.desc("unique_ratio"), "key_set").limit(most).select("key_set", "unique_ratio")


def fuzzy_columns(specs: dict[str, ColumnSpec], most: int = 10) -> dict[str, str]:
    """{column: family} of columns worth a fuzzy comparison."""
    wanted = ("organization", "person", "address")
    found = {c: f for c, s in specs.items() if (f := column_family(c, s)) in wanted and s.expected_type == "str"}
    return dict(sorted(found.items(), key=lambda x: (wanted.index(x[1]), x[0]))[:most])


def support_columns(stats: DataFrame, target: str, specs: dict[str, ColumnSpec], most: int = 5) -> list[str]:
    """Columns that can back a fuzzy match: e-mails, phones and identifiers first, then by uniqueness and fill."""
    weight = {"email": 3.0, "phone": 3.0, "identifier": 2.0, "address": 1.0}
    rows = stats.where(F.col("column_name") != target).select("column_name", "unique_ratio", "null_rate").collect()  # a row for each column
    score = {r[0]: weight.get(column_family(r[0], specs.get(r[0])), 0.0) + r[1] * (1 - r[2]) for r in rows if r[2] < 0.8}
    return sorted(score, key=lambda c: (-score[c], c))[:most]


def top_normal_values(df: DataFrame, columns: list[str], k: int = 5, ascii_only: bool = False) -> DataFrame:
    """column_name, value, n of the most frequent normalised values."""
    norm, out = X.ascii_text if ascii_only else X.normal_text, None
    for c in columns:
        one = df.select(norm(q(c)).alias("value")).where("value != ''").groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)
        one = one.select(F.lit(c).alias("column_name"), "value", "n")
        out = one if out is None else out.unionByName(one)
    return out


def spec_table(spark, specs: dict[str, ColumnSpec]) -> DataFrame:
    rows = [(i, c, s.expected_type, s.semantic_type, s.logical_group, s.description, s.expected_pattern is not None) for i, (c, s) in enumerate(specs.items())]
    return spark.createDataFrame(rows, "pos int, column_name string, expected_type string, semantic_type string, logical_group string, description string, has_pattern boolean")


def profiled_specs(stats: DataFrame, columns: list[str]) -> DataFrame:
    """spec_table of a profiled table: types as they are, grouped by how far values are unique."""
    place = F.array_position(F.array(*map(F.lit, columns)), F.col("column_name")).cast("int") - 1
    return stats.select(place.alias("pos"), "column_name", F.col("dtype").alias("expected_type"), F.col("unique_category").alias("semantic_type"), F.col("unique_category").alias("logical_group"),
                        F.concat(F.lit("nulls: "), F.col("null_count").cast("string")).alias("description"), F.lit(False).alias("has_pattern"))


def search_specs(table: DataFrame, text: str = "", group: str | None = None) -> DataFrame:
    """Rows of spec_table that contain a text in any of four fields, in one group."""
    hit = F.lit(False)
    for c in ("column_name", "expected_type", "semantic_type", "description"):
        hit = hit | F.contains(F.lower(c), F.lit(text.lower()))
    return table.where(hit & (F.lit(group is None) | (F.col("logical_group") == group))).orderBy("pos")


def groups(table: DataFrame) -> DataFrame:
    """logical_group, columns in order."""
    return table.groupBy("logical_group").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "column_name"))), lambda x: x["column_name"]).alias("columns"))


def failed_first(table: DataFrame, failed: list[str]) -> DataFrame:
    """spec_table with columns in error first; n_errors on each row."""
    bad = F.col("column_name").isin(failed)
    return table.withColumns({"is_error": bad, "n_errors": F.count_if(bad).over(Window.partitionBy())}).orderBy(F.desc("is_error"), "pos")


def resolution_counts(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("resolution").agg(F.count(F.lit(1)).alias("n"))


def dedup_payload(before: int, after: int, failed: list[str], resolutions: dict[str, int] | None = None) -> dict[str, Any]:
    """What a validator sees of a deduplication."""
    review = (resolutions or {}).get("review", 0)
    return {"rows_before": before, "rows_after": after, "rows_removed": before - after, "failed_rules": failed, "resolutions": resolutions or {},
            "next_action": "fix the failed rules" if failed else "review uncertain pairs" if review else "continue"}


def keep_upload(path: str, folder: str) -> str:
    """A copy of an uploaded file under a name of its own."""
    os.makedirs(folder, exist_ok=True)
    return shutil.copy(path, os.path.join(folder, f"{uuid.uuid4().hex[:6]}_{os.path.basename(path)}"))


def resolve_source(state: dict[str, str], keys: tuple[str, ...] = ("read_path", "write_path", "physical_dataframe_path", "dataset_path")) -> str:
    """The first path that a run's state names."""
    for k in keys:
        if state.get(k):
            return state[k]
    raise KeyError("no dataset path")


def latest_source(spark, store, session: str | None, state: dict[str, str], write_key: str | None = None, read_key: str | None = None) -> tuple[DataFrame, str]:
    """(table, where it is from): the session's latest version if it has rows, else the path under the task's write key, its read key,
    physical_dataframe_path or dataset_path."""
    from ..sources.readers import load

    if session is not None and (n := store.latest_number(session)):
        df = store.read(session, n)
        if not df.isEmpty():
            return df, f"lineage:{session}"
    path = resolve_source(state, tuple(k for k in (write_key, read_key, "physical_dataframe_path", "dataset_path") if k))
    return load(spark, path), path


LOG_KEY = ("timestamp", "agent", "message")


def union_logs(kept: DataFrame, live: DataFrame, order: str) -> DataFrame:
    """Entries of both once each by LOG_KEY, the first by source and `order`, in order of time."""
    both = kept.withColumn("_source", F.lit(0)).unionByName(live.withColumn("_source", F.lit(1)))
    rest = [c for c in kept.columns if c not in LOG_KEY]
    first = F.min_by(F.struct(*rest), F.struct("_source", order))
    return both.groupBy(*LOG_KEY).agg(first.alias("_first")).select(*[F.col(c) if c in LOG_KEY else F.col(f"_first.{c}").alias(c) for c in kept.columns]).orderBy("timestamp")


def merged_logs(*logs: list[dict[str, Any]]) -> list[dict[str, Any]]:
    """Log entries once each by (timestamp, agent, message), in order of time."""
    once = {(e.get("timestamp"), e.get("agent"), e.get("message")): e for log in logs for e in log}
    return [once[k] for k in sorted(once, key=lambda k: tuple(str(x) for x in k))]
