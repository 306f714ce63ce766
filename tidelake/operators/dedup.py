"""Exact deduplication: full rows and normalised keys, with explicit survivors. Input order is the column ROW."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from .profile import ROW, comparable, data_columns, q

KEEP = ("keep_first", "keep_last", "keep_most_complete")


def null_score(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Nulls in a row."""
    total = F.lit(0)
    for c in columns or data_columns(df):
        total = total + q(c).isNull().cast("int")
    return total


def key_column(c: Column, handler: str | None = None) -> Column:
    """A key as compared: phone and e-mail in normal form where they have one, else as a string; nulls are equal to each other only."""
    own = {"phone": X.phone, "email": X.email}.get(handler or "")
    s = c.cast("string")
    return F.coalesce(own(c), s, F.lit("\u0000null")) if own else F.coalesce(s, F.lit("\u0000null"))


def _survivors(df: DataFrame, keys: list[Column], keep: str, order: str) -> DataFrame:
    """The best row of each key. Its rank is a minimum that is combined before the shuffle: a key with a third of all rows is a few
    rows there. The winners' rows are then kept by a semi-join on the unique row id."""
    named = {f"_k{i}": k for i, k in enumerate(keys)}
    whole = isinstance(df.schema[order].dataType, T.IntegralType)  # else rows are named by something else than numbers
    row = F.col(order).cast("bigint") if whole else F.col(order)
    flat = df.select(*[k.alias(n) for n, k in named.items()], row.alias("_row"), *([null_score(df).alias("_nulls")] if keep == "keep_most_complete" else []))
    won = {"keep_first": F.min("_row"), "keep_last": F.max("_row"), "keep_most_complete": F.min(F.struct("_nulls", "_row"))["_row"]}[keep]
    best = flat.groupBy(*named).agg(won.alias("_won"))
    return df.join(best.select("_won"), row == F.col("_won"), "left_semi")


def dedup_full_rows(df: DataFrame, order: str = ROW) -> DataFrame:
    """The first of equal rows; nulls are equal."""
    columns = [c for c in df.columns if c != order]
    return _survivors(df, [comparable(df, c) for c in columns], "keep_first", order)


def dedup_keys(df: DataFrame, keys: list[str], keep: str = "keep_most_complete", handlers: dict[str, str] | None = None, order: str = ROW) -> DataFrame:
    """One row for each normalised key."""
    return _survivors(df, [key_column(q(c), (handlers or {}).get(c)) for c in keys], keep, order)


def duplicate_groups(df: DataFrame, keys: list[str], handlers: dict[str, str] | None = None) -> DataFrame:
    """Keys as compared and n of groups of two and more."""
    named = [key_column(q(c), (handlers or {}).get(c)).alias(c) for c in keys]
    return df.select(*named).groupBy(*[q(c) for c in keys]).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def inspect_key_sets(df: DataFrame, sets: list[list[str]]) -> DataFrame:
    """key_set, valid, reason, duplicate_groups, surplus_rows, member_rows for each set of columns."""
    out = None
    for keys in sets:
        name, lacking = F.lit(",".join(keys)).alias("key_set"), [c for c in keys if c not in df.columns]
        if lacking or not keys:
            one = df.sparkSession.range(1).select(name, F.lit(False).alias("valid"), F.lit(f"missing: {', '.join(lacking)}").alias("reason"),
                                                  *[F.lit(0).cast("bigint").alias(c) for c in ("duplicate_groups", "surplus_rows", "member_rows")])
        else:
            one = duplicate_groups(df, keys).agg(
                F.count(F.lit(1)).alias("duplicate_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus_rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("member_rows")
            ).select(name, F.lit(True).alias("valid"), F.lit(None).cast("string").alias("reason"), "duplicate_groups", "surplus_rows", "member_rows")
        out = one if out is None else out.unionByName(one)
    return out


def has_duplicates(df: DataFrame, keys: list[str]) -> bool:
    return not duplicate_groups(df, keys).limit(1).isEmpty()


@dataclass
class DedupDecision:
    """What a deduplication does: keys (none: full rows), survivor rule, handlers, fuzzy settings."""

    keys: list[str] = field(default_factory=list)
    keep: str = "keep_most_complete"
    handlers: dict[str, str] = field(default_factory=dict)
    reason: str = ""


def check_decision(decision: DedupDecision, stats: dict[str, dict], df: DataFrame, weak_share: float = 0.2) -> DedupDecision:
    """Keys that can't serve go: missing, over 30 % null; a lone technical id or name only, or a weak single key, falls back to full rows.

    stats: {column: {"null_rate": ..., "unique_ratio": ..., "is_technical": ...}}"""
    keys = [c for c in decision.keys if c in df.columns and stats.get(c, {}).get("null_rate", 0.0) <= 0.3]
    full = lambda why: DedupDecision([], decision.keep, {}, why)
    if not keys:
        return full("no usable key")
    if all(stats.get(c, {}).get("null_rate", 0.0) > 0.8 for c in keys):
        return full("keys are almost all null")
    if len(keys) == 1:
        if stats.get(keys[0], {}).get("is_technical"):
            return full("a technical id alone")
        if "name" in keys[0].lower():
            return full("a name alone")
        if stats.get(keys[0], {}).get("unique_ratio", 1.0) < weak_share:
            return full("a weak key alone")
    return DedupDecision(keys, decision.keep, {c: h for c, h in decision.handlers.items() if c in keys}, decision.reason)


def fallback_decision(df: DataFrame, stats: DataFrame, planned_keys: list[str], planned_columns: list[str], usable: Callable[[list[str]], bool] | None = None) -> DedupDecision:
    """The first of planned keys, planned columns, near-unique columns and key candidates that can serve (usable) and has duplicates; else full rows."""
    rows = stats.select("column_name", "unique_category").collect()  # a row for each column
    near = [r[0] for r in rows if r[1] == "near_unique"]
    candidates = [r[0] for r in rows if r[1] == "primary_key"]
    for why, keys in (("planned keys", planned_keys), ("planned columns", planned_columns), ("near-unique columns", near[:1]), ("key candidates", candidates[:1])):
        keys = [c for c in keys if c in df.columns]
        if keys and (usable is None or usable(keys)) and has_duplicates(df, keys):
            return DedupDecision(keys, reason=why)
    return DedupDecision([], reason="full rows")


def run(df: DataFrame, decision: DedupDecision, order: str = ROW) -> DataFrame:
    """Full rows first, then keys."""
    out = dedup_full_rows(df, order)
    return dedup_keys(out, decision.keys, decision.keep, decision.handlers, order) if decision.keys else out


def guard(before: DataFrame, after: DataFrame, decision: DedupDecision) -> list[str]:
    """Failed checks after a deduplication."""
    failed = ["row_count_increased"] * (after.count() > before.count())
    failed += ["residual_full_row_duplicates"] * has_duplicates(after, data_columns(after))
    return failed + ["residual_key_duplicates"] * bool(decision.keys and has_duplicates(after, decision.keys))
