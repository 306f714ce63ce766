"""Rule validation: declared checks become one aggregate, plus one grouped count for each uniqueness rule.

A rule is a dict: {"rule": name, "column": ..., "threshold": ...}. Names as specs give them; unknown names pass with a note."""
from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nullness import is_listed
from .profile import duplicate_rows, q

UNIQUE = ("column_unique", "is_unique")
NO_DUPLICATES = ("dataframe_no_exact_duplicates", "no_duplicate_rows", "duplicate_rows_eq_0")
NULL_RATE = ("null_rate_lt", "null_rate_lte")  # both fail only above the threshold


def _scalar(df: DataFrame, rule: dict, strategies: dict[str, str]) -> Column | str:
    """violations of a rule as an aggregate, or a note that it passes."""
    name, c = rule["rule"], rule.get("column")
    gone = c is not None and c not in df.columns
    if name in NULL_RATE:
        plan = strategies.get(c, "")
        if plan == "drop_column":
            return F.lit(0 if gone else 1)
        if gone or plan in ("leave_as_is", "keep_null", "skip"):
            return "exempt"
        rate = F.try_divide(F.count(F.lit(1)) - F.count(q(c)), F.count(F.lit(1)))
        return (F.coalesce(rate, F.lit(0.0)) > rule.get("threshold", 0.0)).cast("int")
    if name == "no_disguised_missing_values":
        if gone:
            return "exempt"
        known = rule.get("acknowledged")
        hidden = is_listed(q(c), [str(v) for v in rule.get("values", [])])
        return F.count_if(hidden & (q(c).cast("string") != str(known)) if known is not None else hidden)
    if name == "expected_str_pattern":  # the fill constant is held against the pattern, not the data
        if gone or isinstance(df.schema[c].dataType, (T.DateType, T.TimestampNTZType, T.TimestampType)) or rule.get("fill_value") is None or rule.get("approved"):
            return "exempt"
        return F.lit(0 if re.match(rule["pattern"], str(rule["fill_value"])) else 1)
    return "unsupported"


def validate(df: DataFrame, rules: list[dict[str, Any]], strategies: dict[str, str] | None = None) -> DataFrame:
    """rule, column, violations, passed, note of each rule, in order."""
    spark, parts, scalars, notes = df.sparkSession, [], [], []
    for i, r in enumerate(rules):
        head = (F.lit(i).alias("pos"), F.lit(r["rule"]).alias("rule"), F.lit(r.get("column")).cast("string").alias("column"))
        if r["rule"] in NO_DUPLICATES:
            parts.append(duplicate_rows(df).select(*head, F.col("duplicate_rows").cast("bigint").alias("violations"), F.lit(None).cast("string").alias("note")))
        elif r["rule"] in UNIQUE and r.get("column") in df.columns:
            over = df.groupBy(q(r["column"]).alias("k")).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("violations"))
            parts.append(over.select(*head, "violations", F.lit(None).cast("string").alias("note")))
        else:
            made = "missing column" if r["rule"] in UNIQUE else _scalar(df, r, strategies or {})
            if isinstance(made, str):
                notes.append((i, r["rule"], r.get("column"), 0, made))
            else:
                scalars.append(F.struct(*head, F.coalesce(made, F.lit(0)).cast("bigint").alias("violations"), F.lit(None).cast("string").alias("note")))
    if scalars:
        parts.append(df.agg(F.array(*scalars).alias("a"), F.count(F.lit(1)).alias("_n")).select(F.inline("a")))
    if notes:
        parts.append(spark.createDataFrame(notes, "pos int, rule string, column string, violations bigint, note string"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("passed", F.col("violations") == 0).orderBy("pos")


def passed(checked: DataFrame) -> bool:
    """The gate: no rule failed."""
    return checked.where("NOT passed").limit(1).isEmpty()
