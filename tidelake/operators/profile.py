"""Column profiles. Scalar figures of all columns come from one aggregate; frequencies from one top-k per column."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.nullness import DISGUISED, strip
from .heavy import top_values
from .ranks import exact_quantiles

ROW = "_row_index"
#: Columns whose exact distinct counts share one aggregate.
PASS_COLUMNS = 16


def q(name: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col(f"`{name.replace('`', '``')}`")


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ROW]


def is_numeric(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.NumericType)


def comparable(df: DataFrame, c: str) -> Column:
    """Nested cells as JSON, which can be grouped."""
    return F.to_json(q(c)) if isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType)) else q(c)


def unique_category(ratio: Column) -> Column:
    return (F.when(ratio == 1, "primary_key").when(ratio > 0.8, "near_unique").when(ratio > 0.2, "regular")
            .when(ratio > 0, "categorical").otherwise("constant"))


def column_stats(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    """column_name, dtype, total_rows, null_count, null_rate, unique_count, unique_ratio, unique_category. approx: distinct
    counts from sketches. Exact distinct counts send each row once for each column of an aggregate, so wide tables take a pass for
    each PASS_COLUMNS columns."""
    columns = columns or data_columns(df)
    n = F.count(F.lit(1))
    distinct = F.approx_count_distinct if approx else F.count_distinct
    each = [F.struct(
        F.lit(c).alias("column_name"), F.lit(df.schema[c].dataType.simpleString()).alias("dtype"), n.alias("total_rows"),
        (n - F.count(q(c))).alias("null_count"), distinct(comparable(df, c)).alias("unique_count")) for c in columns]
    width = len(each) if approx else PASS_COLUMNS
    long = reduce(DataFrame.unionByName, [df.agg(F.array(*each[i : i + width]).alias("a")).select(F.inline("a")) for i in range(0, len(each), width)])
    ratio = lambda x: F.coalesce(F.try_divide(x, "total_rows"), F.lit(0.0))
    raw = ratio("unique_count")
    return long.select(
        "column_name", "dtype", "total_rows", "null_count", ratio("null_count").alias("null_rate"), "unique_count",
        F.round(raw, 6).alias("unique_ratio"), unique_category(raw).alias("unique_category"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: duplicate_rows = rows less distinct rows, nulls equal."""
    keys = [comparable(df, c).alias(f"k{i}") for i, c in enumerate(data_columns(df))]
    groups = df.select(*keys).groupBy(*[f"k{i}" for i in range(len(keys))]).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def dataset_rollup(stats: DataFrame) -> DataFrame:
    """One row of column lists: pk_candidates, near_unique, categorical, high_null."""
    names = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("column_name"))))
    return stats.agg(
        names(F.col("unique_category") == "primary_key").alias("pk_candidates"), names(F.col("unique_category") == "near_unique").alias("near_unique"),
        names(F.col("unique_category") == "categorical").alias("categorical"), names(F.col("null_rate") > 0.5).alias("high_null"))


def numeric_stats(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    """Spread and shape of numeric columns, one row each. Quantiles are exact with linear interpolation, found by counting (`ranks`),
    so no buffer grows with a column; approx takes sketches instead, in the same pass as all else."""
    columns = columns or [c for c in data_columns(df) if is_numeric(df, c)]
    n, cuts = F.count(F.lit(1)), [0.05, 0.25, 0.5, 0.75, 0.95]
    exact = {} if approx else exact_quantiles(df, {c: q(c).cast("double") for c in columns}, cuts)

    def each(c: str) -> Column:
        x = q(c).cast("double")
        k = F.count(x)
        many = lambda v, least: F.when(k >= least, v).otherwise(F.lit(float("nan")))
        skew = F.when(F.var_pop(x) == 0, 0.0).otherwise(F.skewness(x) * F.sqrt(k * (k - 1)) / F.nullif(k - 2, F.lit(0)))
        kurt = F.when(F.var_pop(x) == 0, 0.0).otherwise((k - 1) / F.nullif((k - 2) * (k - 3), F.lit(0)) * ((k + 1) * F.kurtosis(x) + 6))
        held = F.array(*map(F.lit, exact[c])) if exact.get(c) else F.lit(None)
        p = F.percentile_approx(x, cuts, 10_000) if approx else held.cast("array<double>")
        return F.struct(
            F.lit(c).alias("column_name"), k.alias("values_count"), (n - k).alias("missing_count"), F.count_if(x == 0).alias("zeroes_count"),
            F.coalesce(F.round(F.try_divide(F.count_if(x == 0), n), 4), F.lit(0.0)).alias("zeroes_pct"),
            F.min(x).alias("min"), F.max(x).alias("max"), F.sum(x).alias("sum"), F.avg(x).alias("avg"),
            F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("std"), F.coalesce(F.var_samp(x), F.lit(0.0)).alias("var"),
            many(skew, 3).alias("skew"), many(kurt, 4).alias("kurt"), p.alias("cuts"))

    long = df.agg(F.array(*[each(c) for c in columns]).alias("a")).select(F.inline("a"))
    at = lambda i: F.get("cuts", F.lit(i))
    return long.withColumns({
        "range": F.col("max") - F.col("min"), "p5": at(0), "q1": at(1), "median": at(2), "q3": at(3), "p95": at(4), "iqr": at(3) - at(1)}).drop("cuts")


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """bin, bin_start, bin_end, n of equal-width bins, the last one closed; a constant column is widened by one half on both sides."""
    x = q(column).cast("double")
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    ends = ends.select(F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
                       F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    w = (F.col("hi") - F.col("lo")) / bins
    counted = df.select(x.alias("x")).where("x IS NOT NULL").join(F.broadcast(ends)).groupBy(
        F.least(F.floor((F.col("x") - F.col("lo")) / w), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = ends.where("lo IS NOT NULL").select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return frame.join(F.broadcast(counted), "bin", "left").select(
        "bin", (F.col("lo") + F.col("bin") * w).alias("bin_start"), (F.col("lo") + (F.col("bin") + 1) * w).alias("bin_end"), F.coalesce("n", F.lit(0)).alias("n"))


def top_frequencies(df: DataFrame, columns: list[str], order: str = ROW, k: int = 5) -> DataFrame:
    """column_name, rank, value, n, pct of the k most frequent values of each column, and (Other). Ties: first seen. Two scans find the most
    frequent values of all columns that have such (`heavy`)."""
    totals: dict[str | None, int] = {}
    top = top_values(df, {c: q(c) for c in columns}, k, order, totals=totals)
    present = df.sparkSession.createDataFrame([(c, totals[c]) for c in columns], "of string, present bigint")  # a row for each column
    lists = top.groupBy("column_name").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "first", "value", "n"))).alias("l"))
    taken = F.aggregate("l", F.lit(0).cast("bigint"), lambda s, x: s + x["n"])
    rows = F.transform("l", lambda x, i: F.struct((i + 1).alias("rank"), x["value"].alias("value"), x["n"].alias("n")))
    rest = F.when(F.col("present") > taken, F.array(F.struct(F.lit(k + 1).alias("rank"), F.lit("(Other)").alias("value"), (F.col("present") - taken).alias("n")))).otherwise(
        F.array().cast("array<struct<rank:int,value:string,n:bigint>>"))
    made = lists.join(F.broadcast(present), F.col("column_name") == F.col("of")).select("column_name", F.inline(F.concat(rows, rest)))
    return made.select("column_name", "rank", "value", "n", F.round(F.col("n") / F.lit(totals[None]), 4).alias("pct"))


def format_patterns(df: DataFrame, column: str, order: str = ROW, head: int = 10_000, most: int = 15, legacy: bool = True) -> DataFrame:
    """format_pattern, pct among the first `head` values; given only where 2 to `most` patterns occur, or more and one holds 30 %."""
    seen = df.where(q(column).isNotNull()).orderBy(order).limit(head).select(X.abstract_format(q(column), legacy).alias("format_pattern"))
    groups = seen.groupBy("format_pattern").agg(F.count(F.lit(1)).alias("n"))
    sums = groups.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("kinds"), F.max("n").alias("top"))
    told = (F.col("kinds") > 1) & ((F.col("kinds") <= most) | (F.col("top") >= 0.3 * F.col("rows")))
    return groups.join(F.broadcast(sums)).where(told).orderBy(F.desc("n"), "format_pattern").limit(most).select("format_pattern", (F.col("n") / F.col("rows")).alias("pct"))


def disguised_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, rule, n of the placeholders found in columns that aren't numeric. One pass."""
    each = []
    for c in columns:
        s = F.lower(strip(q(c).cast("string")))
        each += [F.struct(F.lit(c).alias("column_name"), F.lit(r).alias("rule"), F.count_if(s == r.lower()).alias("n")) for r in DISGUISED]
    return df.agg(F.array(*each).alias("a")).select(F.inline("a")).where("n > 0")


def pattern_shares(df: DataFrame, column: str) -> DataFrame:
    """pattern, precedence, share of all patterns over a column's values."""
    c = q(column).cast("string")
    each = [F.struct(F.lit(i).alias("precedence"), F.lit(name).alias("pattern"), F.avg(X.full_match(c, rx).cast("int")).alias("share"))
            for i, (name, rx, _) in enumerate(X.PATTERNS)]
    return df.agg(F.array(*each).alias("a")).select(F.inline("a"))


def detected_pattern(df: DataFrame, columns: list[str], threshold: float = 0.7) -> DataFrame:
    """column_name, pattern: the first whose share reaches min(threshold, its own least share); null if none."""
    each = []
    for c in columns:
        s = q(c).cast("string")
        hits = [F.when(F.avg(X.full_match(s, rx).cast("int")) >= min(threshold, own), name) for name, rx, own in X.PATTERNS]
        each.append(F.struct(F.lit(c).alias("column_name"), F.coalesce(*hits).alias("pattern")))
    return df.agg(F.array(*each).alias("a")).select(F.inline("a"))


def representative_sample(df: DataFrame, column: str, order: str = ROW, n: int = 20) -> DataFrame:
    """value: the n/2 most frequent, then values drawn by the least digest of a row that has them, without repeats. The same at any partitioning."""
    v = q(column).cast("string")
    present = df.where(v.isNotNull()).select(v.alias("value"), F.col(order).alias("row"))
    groups = present.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"), F.min(F.md5(F.col("row").cast("string"))).alias("draw"))
    top = groups.orderBy(F.desc("n"), "first").limit(n // 2).select("value", F.lit(0).alias("kind"), F.lit("").alias("draw"))
    rest = groups.join(F.broadcast(top.select("value")), "value", "left_anti").orderBy("draw").limit(n).select("value", F.lit(1).alias("kind"), "draw")
    return top.unionByName(rest).orderBy("kind", "draw", "value").limit(n).select("value")


def fuzzy_column_profile(df: DataFrame, columns: list[str], ascii_only: bool = False) -> DataFrame:
    """column_name, non_null_rate, distinct_normalized, distinct_ratio, avg_length of normalised values."""
    norm = X.ascii_text if ascii_only else X.normal_text
    flat = df.select(*[norm(q(c)).alias(f"c{i}") for i, c in enumerate(columns)])
    n = F.count(F.lit(1))
    each = []
    for i, c in enumerate(columns):
        v = F.when(F.col(f"c{i}") != "", F.col(f"c{i}"))
        each.append(F.struct(F.lit(c).alias("column_name"), F.round(F.try_divide(F.count(v), n), 6).alias("non_null_rate"), F.count_distinct(v).alias("distinct_normalized"),
                             F.round(F.try_divide(F.count_distinct(v), F.count(v)), 6).alias("distinct_ratio"), F.round(F.avg(F.length(v)), 6).alias("avg_length")))
    return flat.agg(F.array(*each).alias("a")).select(F.inline("a"))


def popular_rows(df: DataFrame, columns: list[str], k: int = 10) -> DataFrame:
    """The k most frequent combinations of columns with their count n."""
    return df.groupBy(*[q(c) for c in columns]).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *[q(c) for c in columns]).limit(k)


def ranked_columns(stats: DataFrame, most: int = 20) -> DataFrame:
    """column_name, rank of the columns whose values repeat most (least unique ratio first)."""
    w = Window.orderBy("unique_ratio", "column_name")  # a row for each column
    return stats.select("column_name", F.row_number().over(w).alias("rank")).where(F.col("rank") <= most)


def popular_sample(df: DataFrame, stats: DataFrame, columns: int = 20, k: int = 10, order: str = ROW) -> DataFrame:
    """The k most frequent combinations of the `columns` that repeat most; the other columns stand beside them with their first k values."""
    chosen = [r[0] for r in ranked_columns(stats, columns).orderBy("rank").collect()]
    groups = df.groupBy(*[q(c) for c in chosen]).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), *[F.asc_nulls_first(q(c)) for c in sorted(chosen)]).limit(k)
    place = lambda w: (F.row_number().over(w) - 1).alias("_at")
    top = groups.select("*", place(Window.orderBy(F.desc("_n"), *[F.asc_nulls_first(q(c)) for c in sorted(chosen)]))).drop("_n")  # k rows
    others = [c for c in data_columns(df) if c not in chosen]
    head = df.orderBy(order).limit(k).select(*[q(c) for c in others], place(Window.orderBy(order)))
    return top.join(head, "_at", "left").orderBy("_at").select(*[q(c) for c in data_columns(df)])


def temporal_vote(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, n_date_time, n_time_only, expected_type by the larger (datetime, time), null where neither occurs."""
    from ..functions.dates import has_date, has_time

    each = []
    for c in columns:
        both, only = F.count_if(has_date(q(c)) & has_time(q(c))), F.count_if(~has_date(q(c)) & has_time(q(c)))
        each.append(F.struct(F.lit(c).alias("column_name"), both.alias("n_date_time"), only.alias("n_time_only"),
                             F.when(both + only > 0, F.when(both >= only, "datetime").otherwise("time")).alias("expected_type")))
    return df.agg(F.array(*each).alias("a")).select(F.inline("a"))


def numeric_vote(df: DataFrame, columns: list[str], share: float = 0.8) -> DataFrame:
    """column_name, int_share, number_share, expected_type of strings that look like numbers."""
    each = []
    for c in columns:
        s = strip(q(c).cast("string"))
        ints, nums = F.avg(X.full_match(s, r"[-+]?\d+").cast("int")), F.avg(X.full_match(s, r"[-+]?\d*\.?\d+").cast("int"))
        each.append(F.struct(F.lit(c).alias("column_name"), ints.alias("int_share"), nums.alias("number_share"),
                             F.when(ints > share, "int").when(nums > share, "float").alias("expected_type")))
    return df.agg(F.array(*each).alias("a")).select(F.inline("a"))
