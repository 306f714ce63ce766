"""Exact quantiles of columns of any size: the value at a rank by counting, not by sorting or by holding all distinct values.

Each wanted rank keeps an open interval of values that is known to hold it and the number of rows below. A round sketches the values inside all
intervals (one pass, buffers of a fixed size), takes two values of the sketch a little before and after the rank, and counts
exactly what lies below, on and between them (one pass). Rows inside shrink some thousandfold a round, whatever the distribution; once HELD
or fewer are left they are sorted in one buffer. All columns and ranks share each pass; single numbers come to the driver.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most values that one buffer holds, and the sketch's accuracy (its ranks are right within 1 / ACCURACY).
HELD, ACCURACY = 1 << 20, 10_000


@dataclass
class _Search:
    """The value at `rank` (from 0, among values that aren't null): strictly between low and high (null: no bound), `below` rows before it."""

    column: str
    rank: int
    inside: int
    low: float | None = None
    high: float | None = None
    below: int = 0
    found: float | None = None

    def within(self, x: Column) -> Column:
        """x if it lies in the interval, else null."""
        cond = x.isNotNull()
        if self.low is not None:
            cond = cond & (x > F.lit(self.low))
        if self.high is not None:
            cond = cond & (x < F.lit(self.high))
        return F.when(cond, x)

    def narrow(self, a: float, b: float, upto_a: int, on_a: int, between: int, on_b: int) -> None:
        """a <= b are values inside; counts of the rows inside that are below a, equal a, between, equal b."""
        at = self.rank - self.below
        if at < upto_a:
            self.high, self.inside = a, upto_a
        elif at < upto_a + on_a:
            self.found = a
        elif at < upto_a + on_a + between:
            self.low, self.high, self.below, self.inside = a, b, self.below + upto_a + on_a, between
        elif a != b and at < upto_a + on_a + between + on_b:
            self.found = b
        else:
            passed = upto_a + on_a + between + (on_b if a != b else 0)
            self.low, self.below, self.inside = b, self.below + passed, self.inside - passed


def _passed(df: DataFrame, columns: dict[str, Column], aggregates: list[Column]):
    names = {c: f"x{i}" for i, c in enumerate(columns)}
    return df.select(*[columns[c].cast("double").alias(n) for c, n in names.items()]).agg(*[a.alias(f"a{i}") for i, a in enumerate(aggregates)]).first()


def values_at(df: DataFrame, columns: dict[str, Column], ranks: dict[str, list[int]], sizes: dict[str, int], held: int = HELD) -> dict[tuple[str, int], float]:
    """{(column, rank): value} of numeric columns (as doubles; NaN is the greatest). sizes: rows of each column that aren't null."""
    every = [_Search(c, r, sizes[c]) for c, rs in ranks.items() for r in dict.fromkeys(rs)]
    x = {c: F.col(f"x{i}") for i, c in enumerate(columns)}
    while left := [s for s in every if s.found is None]:
        small, large = [s for s in left if s.inside <= held], [s for s in left if s.inside > held]
        cuts = []
        for s in large:
            at, margin = (s.rank - s.below + 0.5) / s.inside, 2 / ACCURACY
            cuts.append(F.percentile_approx(s.within(x[s.column]), [max(0.0, at - margin), min(1.0, at + margin)], ACCURACY))
        # intervals that several ranks share are sorted once
        spans = {(s.column, s.low, s.high): s for s in small}
        took = [F.sort_array(F.collect_list(s.within(x[s.column]))) for s in spans.values()]
        place = {k: i for i, k in enumerate(spans)}
        picked = [F.get(took[place[s.column, s.low, s.high]], F.lit(s.rank - s.below)) for s in small]
        row = _passed(df, columns, picked + cuts)
        for s, v in zip(small, row[: len(small)], strict=True):
            s.found = v
        if not large:
            continue
        counts, bounds = [], row[len(small) :]
        for s, (a, b) in zip(large, bounds, strict=True):
            v = s.within(x[s.column])
            counts += [F.count_if(v < a), F.count_if(v == a), F.count_if((v > a) & (v < b)), F.count_if(v == b)]
        told = _passed(df, columns, counts)
        for i, (s, (a, b)) in enumerate(zip(large, bounds, strict=True)):
            s.narrow(a, b, *told[4 * i : 4 * i + 4])
    return {(s.column, s.rank): s.found for s in every}


def exact_quantiles(df: DataFrame, columns: dict[str, Column], cuts: list[float], held: int = HELD) -> dict[str, list[float] | None]:
    """{column: its quantiles, linearly interpolated}; null for a column without values."""
    if not columns:
        return {}
    sizes = dict(zip(columns, _passed(df, columns, [F.count(f"x{i}") for i in range(len(columns))]), strict=True))
    full = {c: v for c, v in columns.items() if sizes[c]}
    at = {c: [q * (sizes[c] - 1) for q in cuts] for c in full}
    ranks = {c: [r for p in ps for r in (math.floor(p), math.ceil(p))] for c, ps in at.items()}
    values = values_at(df, full, ranks, sizes, held) if full else {}

    def between(c: str, p: float) -> float:
        low, high = values[c, math.floor(p)], values[c, math.ceil(p)]
        return low if low == high or p == math.floor(p) else (math.ceil(p) - p) * low + (p - math.floor(p)) * high

    return {c: [between(c, p) for p in at[c]] if c in full else None for c in columns}
