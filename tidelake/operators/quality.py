"""Quality check of a table: logical types, nulls, placeholders, constants, duplicates."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nullness import is_disguised_or_blank
from ..functions.text import full_match
from .profile import ROW, comparable, data_columns, duplicate_rows, q


def _logical(df: DataFrame, c: str) -> Column:
    """Aggregate: the logical type's name."""
    kind, v = df.schema[c].dataType, q(c)
    if isinstance(kind, T.DateType):
        return F.lit("date")
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        return F.when(F.bool_and(F.date_trunc("day", v) == v), "date").otherwise("datetime")
    if isinstance(kind, T.BooleanType):
        return F.lit("bool")
    if isinstance(kind, T.IntegralType):
        return F.lit("int")
    if isinstance(kind, T.NumericType):
        return F.lit("float")
    return F.when(F.bool_and(full_match(v.cast("string"), r"([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d+)?)?")), "time").otherwise("str")


def logical_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, logical_type. One pass."""
    each = [F.struct(F.lit(c).alias("column_name"), _logical(df, c).alias("logical_type")) for c in columns or data_columns(df)]
    return df.agg(F.array(*each).alias("a")).select(F.inline("a"))


def column_quality(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, logical_type, null_count, null_rate, disguised_count, distinct_count, is_constant, issues. One pass."""
    n, each = F.count(F.lit(1)), []
    for c in columns or data_columns(df):
        kind = df.schema[c].dataType
        hidden = F.lit(0).cast("bigint") if isinstance(kind, T.NumericType) else F.count_if(is_disguised_or_blank(comparable(df, c)))
        each.append(F.struct(F.lit(c).alias("column_name"), _logical(df, c).alias("logical_type"), n.alias("rows"), (n - F.count(q(c))).alias("null_count"),
                             hidden.alias("disguised_count"), F.count_distinct(comparable(df, c)).alias("distinct_count")))
    long = df.agg(F.array(*each).alias("a")).select(F.inline("a"))
    issues = F.array_compact(F.array(F.when(F.col("null_count") > 0, "nulls"), F.when(F.col("disguised_count") > 0, "disguised_nulls"), F.when(F.col("distinct_count") <= 1, "constant")))
    return long.select("column_name", "logical_type", "null_count", F.round(F.coalesce(F.try_divide("null_count", "rows"), F.lit(0.0)), 6).alias("null_rate"),
                       "disguised_count", "distinct_count", (F.col("distinct_count") <= 1).alias("is_constant"), issues.alias("issues"))


def quality_report(df: DataFrame) -> DataFrame:
    """One row: rows, columns, duplicate_rows, lists of columns with an issue of each kind, passed (no issue, no duplicates)."""
    cols = column_quality(df)
    names = lambda issue: F.array_sort(F.collect_list(F.when(F.array_contains("issues", issue), F.col("column_name"))))
    lists = cols.agg(names("nulls").alias("null_columns"), names("disguised_nulls").alias("disguised_columns"), names("constant").alias("constant_columns"), F.sum(F.size("issues")).alias("n_issues"))
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    return rows.join(F.broadcast(lists)).join(F.broadcast(duplicate_rows(df))).withColumn("columns", F.lit(len(data_columns(df)))).withColumn(
        "passed", (F.col("n_issues") == 0) & (F.col("duplicate_rows") == 0))


def is_unique(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: is_unique; nulls are equal."""
    groups = df.groupBy(*[comparable(df, c).alias(f"k{i}") for i, c in enumerate(columns)]).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.max("n") <= 1, F.lit(True)).alias("is_unique"))


__all__ = ["ROW", "column_quality", "is_unique", "logical_types", "quality_report"]
