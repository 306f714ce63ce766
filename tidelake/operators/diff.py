"""Before/after comparison of versions and scoring against ground truth."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nullness import is_diff_null
from ..functions.text import diff_text, score_text
from .joins import aligned, placed
from .profile import ROW, comparable, data_columns, q


STRIPE = 4096


def _common(a: DataFrame, b: DataFrame, columns: list[str] | None) -> list[str]:
    return [c for c in data_columns(a) if c in b.columns and (columns is None or c in columns)]


def _flat(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    return df.select(F.col(order), *[comparable(df, c).cast("string").alias(c) for c in columns])


def column_changes(before: DataFrame, after: DataFrame, columns: list[str] | None = None, order: str = ROW, align: str = "position") -> DataFrame:
    """column_name, compared, changed_cells, change_rate, nulls before and after, null_delta, dtypes. One join, one aggregate."""
    cols = _common(before, after, columns)
    both = aligned(_flat(before, cols, order), _flat(after, cols, order), "inner", order, align)
    n, each = F.count(F.lit(1)), []
    for c in cols:
        a, b = q(f"a_{c}"), q(f"b_{c}")
        changed = F.count_if(diff_text(a) != diff_text(b))
        na, nb = F.count_if(is_diff_null(a)), F.count_if(is_diff_null(b))
        each.append(F.struct(
            F.lit(c).alias("column_name"), n.alias("compared"), changed.alias("changed_cells"), F.round(F.coalesce(F.try_divide(changed, n), F.lit(0.0)), 4).alias("change_rate"),
            na.alias("before_nulls"), nb.alias("after_nulls"), (nb - na).alias("null_delta"),
            F.lit(before.schema[c].dataType.simpleString()).alias("before_dtype"), F.lit(after.schema[c].dataType.simpleString()).alias("after_dtype")))
    return both.agg(F.array(*each).alias("a")).select(F.inline("a"))


def top_changed(changes: DataFrame, limit: int = 10) -> DataFrame:
    """Columns that changed, most first."""
    return changes.where("changed_cells > 0").orderBy(F.desc("changed_cells"), "column_name").limit(max(1, min(50, limit)))


def changed_cells(before: DataFrame, after: DataFrame, columns: list[str] | None = None, limit: int | None = 100, order: str = ROW, align: str = "position") -> DataFrame:
    """_pos, column_name, before, after of changed cells; rows that one side lacks are padded. limit: rows compared (1 to 500), null for all."""
    names = [c for c in dict.fromkeys([*data_columns(before), *data_columns(after)]) if columns is None or c in columns]
    fill = lambda df: df.select(F.col(order), *[(comparable(df, c).cast("string") if c in df.columns else F.lit(None).cast("string")).alias(c) for c in names])
    both = aligned(fill(before), fill(after), "full_outer", order, align)
    if limit is not None:
        both = both.where(F.col("_pos") < max(1, min(500, limit)))
    cells = F.filter(F.array(*[F.struct(F.lit(c).alias("column_name"), q(f"a_{c}").alias("before"), q(f"b_{c}").alias("after")) for c in names]),
                     lambda x: diff_text(x["before"]) != diff_text(x["after"]))
    return both.select("_pos", F.inline(cells))


def change_samples(before: DataFrame, after: DataFrame, k: int = 8, **options) -> DataFrame:
    """column_name and samples: the first k changed cells of each column.

    A column's first k are ranked among the first k of each of its stripes of positions, and a stripe's among its own, so no task ranks a whole column."""
    cells = changed_cells(before, after, limit=None, **options).withColumn("_b", F.floor(F.col("_pos") / STRIPE))
    # stripes that can hold a first cell: the earliest whose counts together reach k
    counts = cells.groupBy("column_name", "_b").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("column_name").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    needed = counts.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0))).where(F.col("_before") < k).select("column_name", "_b")
    few = cells.join(F.broadcast(needed), ["column_name", "_b"])  # k stripes of a column at most
    return few.groupBy("column_name").agg(F.slice(F.array_sort(F.collect_list(F.struct("_pos", "before", "after"))), 1, k).alias("samples"))


def score(dirty: DataFrame, cleaned: DataFrame, truth: DataFrame, order: str = ROW, align: str = "position") -> DataFrame:
    """One row: cells, tp, fp, fn, correct, precision, recall, f1, cell_accuracy. Ratios without a denominator are 1 (f1: 0)."""
    cols = [c for c in data_columns(truth) if c in cleaned.columns and c in dirty.columns and c != "index"]
    first = aligned(_flat(dirty, cols, order), _flat(cleaned, cols, order), "inner", order, align)
    third = placed(_flat(truth, cols, order), order, align).select("_pos", *[q(c).alias(f"t_{c}") for c in cols])
    both = first.join(third, "_pos")
    tp = fp = fn = ok = F.lit(0).cast("bigint")
    for c in cols:
        d, x, t = (score_text(q(f"{s}_{c}")) for s in "abt")
        right, wrong_before, touched = x.eqNullSafe(t), ~d.eqNullSafe(t), ~x.eqNullSafe(d)
        tp = tp + (wrong_before & right).cast("bigint")
        fp = fp + (~right & touched).cast("bigint")
        fn = fn + (wrong_before & ~right).cast("bigint")
        ok = ok + right.cast("bigint")
    sums = both.select(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), ok.alias("ok")).agg(
        (F.count(F.lit(1)) * len(cols)).alias("cells"), *[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("tp", "fp", "fn")], F.coalesce(F.sum("ok"), F.lit(0)).alias("correct"))
    p = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(1.0))
    r = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(1.0))
    return sums.withColumns({"precision": p, "recall": r}).withColumns({
        "f1": F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)),
        "cell_accuracy": F.coalesce(F.try_divide("correct", "cells"), F.lit(0.0))})
