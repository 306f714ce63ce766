"""SQL forms that Spark's dialect lacks, as functions of a DataFrame: QUALIFY, DISTINCT ON, UNNEST of several columns, EXCLUDE and REPLACE."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .profile import q


def _free(name: str, df: DataFrame) -> str:
    low = {c.lower() for c in df.columns}
    while name.lower() in low:
        name += "_"
    return name


def qualify(df: DataFrame, **conditions) -> DataFrame:
    """Rows for which all conditions hold; each is (a window expression, a function of its value that gives a condition). Null is not true."""
    names = {k: _free(f"_{k}", df) for k in conditions}
    seen = df.withColumns({names[k]: window for k, (window, _) in conditions.items()})
    for k, (_, holds) in conditions.items():
        seen = seen.where(holds(F.col(names[k])))
    return seen.select(*[q(c) for c in df.columns])


def distinct_on(df: DataFrame, keys: list[str], order: list[Column], columns: list[str] | None = None) -> DataFrame:
    """One row of each group of equal keys (nulls equal): the first in `order`. Firsts combine before the shuffle, so a hot key is no hot task.

    order: columns, or their asc() and desc() with nulls last."""
    place = _free("_first", df)
    taken = columns or df.columns
    ranked = F.struct(*[q(c) for c in taken])
    # the least by several directions: a sorted array of one element wouldn't combine, a comparator over two rows does
    keyed = df.select(*[q(k).alias(f"{place}{i}") for i, k in enumerate(keys)], ranked.alias(place), *[o.alias(f"{place}o{i}") for i, o in enumerate(order)])
    first = F.min_by(F.col(place), F.struct(*[F.col(f"{place}o{i}") for i in range(len(order))]))
    return keyed.groupBy(*[f"{place}{i}" for i in range(len(keys))]).agg(first.alias(place)).select(*[F.col(place)[c].alias(c) for c in taken])


def descending(c: Column) -> Column:
    """A number or time as a key that sorts the other way round, for distinct_on."""
    return -c.cast("double")


def unnest(df: DataFrame, **arrays) -> DataFrame:
    """A row for each place in the arrays, side by side; shorter ones are filled with nulls; rows without an element go. {name: array}."""
    names = list(arrays)
    zipped = F.arrays_zip(*[F.coalesce(a, F.array().cast(df.select(a).schema[0].dataType)).alias(n) for n, a in arrays.items()])
    place = _free("_zip", df)
    return df.select(*[q(c) for c in df.columns if c not in names], F.explode(zipped).alias(place)).select(
        *[q(c) for c in df.columns if c not in names], *[F.col(place)[n].alias(n) for n in names])


def exclude(df: DataFrame, columns: list[str], **replaced) -> DataFrame:
    """All columns but some, in order; `replaced` columns have a new expression in their place. Unknown names are an error, as in SQL."""
    if unknown := [c for c in [*columns, *replaced] if c not in df.columns]:
        raise ValueError(f"no such columns: {', '.join(unknown)}")
    return df.select(*[(replaced[c].alias(c) if c in replaced else q(c)) for c in df.columns if c not in columns])


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group in `order`: qualify by row_number."""
    w = Window.partitionBy(*[q(k) for k in keys]).orderBy(*order)
    return qualify(df, rank=(F.row_number().over(w), lambda r: r <= n))
