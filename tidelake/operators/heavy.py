"""The most frequent values of many columns, exactly, in two passes: mergeable summaries name candidates, then these are counted.

A summary of frequent items (`approx_top_k`) has a bound on what it can miss: a value that it doesn't name occurs at most
2 * 3.5 / TRACKED of the rows, or as often as its last item may. If the k-th candidate's exact count is over that bound, the k candidates
are the k most frequent values; so it is if the candidates are all values there are. Only columns without such a proof (near-unique ones)
are grouped by value, one by one.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Items that a summary tracks.
TRACKED = 8192
#: Types that summaries take.
_PLAIN = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def top_values(df: DataFrame, columns: dict[str, Column], k: int, order: str | None = None, proofs: dict[str, bool] | None = None, totals: dict[str | None, int] | None = None) -> DataFrame:
    """column_name, value (string), n, first of the k most frequent values of each column, nulls left out. Of equally frequent ones those come first
    whose least `order` is less (first; null without order: then by value). proofs is told which columns' candidates were proven,
    totals how many values each column has (under null: rows)."""
    names = list(columns)
    kinds = df.select(*[columns[c].alias(f"v{i}") for i, c in enumerate(names)]).schema
    plain = [i for i in range(len(names)) if isinstance(kinds[i].dataType, _PLAIN)]
    first = F.min(F.col(order)) if order else F.lit(None).cast("bigint")
    base = df.select(*[columns[c].cast("string").alias(f"v{i}") for i, c in enumerate(names)], *([F.col(order)] if order else []))
    wide = max(64, 4 * k)
    told = base.agg(F.count(F.lit(1)).alias("n"), *[F.count(f"v{i}").alias(f"n{i}") for i in range(len(names))], *[F.expr(f"approx_top_k(v{i}, {wide}, {TRACKED})").alias(f"t{i}") for i in plain]).first()
    if totals is not None:
        totals.update({None: told["n"]} | {c: told[f"n{i}"] for i, c in enumerate(names)})
    named = [(i, r["item"], r["count"]) for i in plain for r in told[f"t{i}"] if r["item"] is not None]
    proven: set[int] = set()
    counted = None
    if named:
        spark = df.sparkSession
        candidates = F.broadcast(spark.createDataFrame([x[:2] for x in named], "i int, value string"))  # `wide` rows a column
        rows = base.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"v{i}").alias("value")) for i in plain])), *([F.col(order)] if order else []))
        rows = rows.join(candidates, ["i", "value"]).groupBy("i", "value").agg(F.count(F.lit(1)).alias("n"), first.alias("first"))
        exact = {(r["i"], r["value"]): (r["n"], r["first"]) for r in rows.collect()}
        best = []
        for i in plain:
            own = sorted(((-exact[j, v][0], exact[j, v][1] if order else v, v) for j, v, _ in named if j == i))
            estimates = [e for j, _, e in named if j == i]
            bound = max(7 * told[f"n{i}"] / TRACKED, min(estimates) if len(estimates) >= wide else 0) if estimates else 0
            whole = -sum(n for n, _, _ in own) == told[f"n{i}"]
            if whole or len(own) >= k and -own[k - 1][0] > bound:
                proven.add(i)
                best += [(names[i], v, -n, f if order else None) for n, f, v in own[:k]]
        counted = spark.createDataFrame(best, "column_name string, value string, n bigint, first bigint") if best else None
    if proofs is not None:
        proofs.update({c: i in proven for i, c in enumerate(names)})
    parts = [counted] if counted is not None else []
    for i, c in enumerate(names):
        if i not in proven:
            groups = base.where(F.col(f"v{i}").isNotNull()).groupBy(F.col(f"v{i}").alias("value")).agg(F.count(F.lit(1)).alias("n"), first.alias("first"))
            top = groups.orderBy(F.desc("n"), "first", "value").limit(k)
            parts.append(top.select(F.lit(c).alias("column_name"), "value", "n", F.col("first").cast("bigint").alias("first")))
    return reduce(DataFrame.unionByName, parts)


def modes(df: DataFrame, columns: list[str], q) -> dict[str, object]:
    """{column: its most frequent value, of equally frequent ones the least}, in the column's type; null for a column without values."""
    texts = {c: q(c) for c in columns if isinstance(df.schema[c].dataType, T.StringType)}
    others = {c: q(c) for c in columns if c not in texts}
    out: dict[str, object] = dict.fromkeys(columns)
    for r in top_values(df, texts, 1).collect() if texts else ():
        out[r["column_name"]] = r["value"]
    for c, v in others.items():  # the least of a type isn't the least of its text, so those that tie are compared as they are
        r = df.where(v.isNotNull()).groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "v").limit(1).collect()
        out[c] = r[0]["v"] if r else None
    return out
