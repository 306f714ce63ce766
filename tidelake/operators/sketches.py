"""Profiles that merge: counts and sketches of a column, a row each, from which figures of any union of tables are read without their rows.

Distinct values are counted by HyperLogLog, quantiles by KLL sketches (numeric columns), frequent values by summaries of items. Buffers have a fixed
size, so a profile of a column takes some 50 kB for any number of rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .profile import comparable, data_columns, is_numeric, q

#: log2 of the registers (standard error 0.8 %), the quantile sketches' size (ranks within some 0.5 %), and frequent items tracked.
REGISTERS, QUANTILES, ITEMS = 14, 400, 1024
DECILES = [i / 10 for i in range(1, 10)]
#: Quantiles that a distribution is compared by.
POINTS = 200


def sketched(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, n_rows, n_nulls, least, greatest (by number, else by text; as text), distinct_sketch, value_sketch (null unless numeric) and
    item_sketch of each column, in one pass. NaN is a value, but in no value_sketch."""
    def each(c: str):
        text, number = comparable(df, c).cast("string"), q(c).cast("double") if is_numeric(df, c) else F.lit(None).cast("double")
        told = q(c) if is_numeric(df, c) or isinstance(df.schema[c].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) else text
        name = f"`_t{names[c]}`"
        plain.update({f"_t{names[c]}": text, f"_x{names[c]}": F.nanvl(number, F.lit(None)), f"_v{names[c]}": told})
        return F.struct(
            F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(name).isNull()).alias("n_nulls"),
            F.min(f"_v{names[c]}").cast("string").alias("least"), F.max(f"_v{names[c]}").cast("string").alias("greatest"),
            F.hll_sketch_agg(name, F.lit(REGISTERS)).alias("distinct_sketch"), (F.kll_sketch_agg_double(f"_x{names[c]}", F.lit(QUANTILES)) if is_numeric(df, c) else F.lit(None).cast("binary")).alias("value_sketch"),
            F.expr(f"approx_top_k_accumulate({name}, {ITEMS})").alias("item_sketch"), F.lit(is_numeric(df, c)).alias("numeric"))

    columns = columns or data_columns(df)
    names, plain = {c: i for i, c in enumerate(columns)}, {}
    all_of = [each(c) for c in columns]
    return df.select(*[v.alias(n) for n, v in plain.items()]).agg(F.array(*all_of).alias("a")).select(F.inline("a"))


def merged(profiles: DataFrame) -> DataFrame:
    """The profile of the union of the tables that profiles (of `sketched`, unioned) are of; a column that a table lacks adds no rows."""
    of_number = lambda pick: F.when(F.bool_and("numeric"), pick("least", "greatest"))
    low = F.coalesce(of_number(lambda a, b: F.min_by(a, F.col(a).try_cast("double"))), F.min("least"))
    high = F.coalesce(of_number(lambda a, b: F.max_by(b, F.col(b).try_cast("double"))), F.max("greatest"))
    return profiles.groupBy("column_name").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_nulls").alias("n_nulls"), low.alias("least"), high.alias("greatest"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.when(F.bool_and("numeric"), F.kll_merge_agg_double("value_sketch")).alias("value_sketch"), F.expr(f"approx_top_k_combine(item_sketch, {ITEMS})").alias("item_sketch"),
        F.bool_and("numeric").alias("numeric"))


def _held(sketch: str):
    """The sketch if it holds a value, as an empty one has no quantiles."""
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.col(sketch))


def estimated(profiles: DataFrame, top: int = 10) -> DataFrame:
    """column_name, n_rows, n_nulls, null_rate, least, greatest, distinct_estimate, deciles (null without numbers), frequent (value, count)."""
    return profiles.select(
        "column_name", "n_rows", "n_nulls", F.coalesce(F.try_divide("n_nulls", "n_rows"), F.lit(0.0)).alias("null_rate"), "least", "greatest", F.hll_sketch_estimate("distinct_sketch").alias("distinct_estimate"),
        F.kll_sketch_get_quantile_double(_held("value_sketch"), F.array(*map(F.lit, DECILES))).alias("deciles"), F.expr(f"approx_top_k_estimate(item_sketch, {top})").alias("frequent"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """column_name, state (added, removed, kept), rows_delta, null_rate_delta, distinct_delta and shift between two profiles: shift is the greatest
    distance of the two distributions at the deciles of the first (null unless both hold numbers), read from POINTS quantiles of each."""
    points = F.array(*[F.lit((i + 0.5) / POINTS) for i in range(POINTS)])
    told = lambda p, s: estimated(p).join(p.select("column_name", F.kll_sketch_get_quantile_double(_held("value_sketch"), points).alias("points")), "column_name").select(
        "column_name", *[F.col(c).alias(f"{c}_{s}") for c in ("n_rows", "null_rate", "distinct_estimate", "deciles", "points")])
    both = told(before, "a").join(told(after, "b"), "column_name", "full")
    share = lambda of, test: F.size(F.filter(of, test)) / POINTS
    apart = lambda x, test: F.abs(share("points_a", lambda v: test(v, x)) - share("points_b", lambda v: test(v, x)))
    shift = F.array_max(F.transform("deciles_a", lambda x: F.greatest(apart(x, lambda v, x: v <= x), apart(x, lambda v, x: v < x))))
    state = F.when(F.col("n_rows_a").isNull(), "added").when(F.col("n_rows_b").isNull(), "removed").otherwise("kept")
    return both.select("column_name", state.alias("state"), *[(F.col(f"{c}_b") - F.col(f"{c}_a")).alias(name) for c, name in (("n_rows", "rows_delta"), ("null_rate", "null_rate_delta"), ("distinct_estimate", "distinct_delta"))],
                       F.when(F.col("points_b").isNotNull(), shift).alias("shift"))
