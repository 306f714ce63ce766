"""Table-grid operations: value filters, substring and format filters, mixed sorting, pages."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import abstract_format
from .profile import ROW, data_columns, q

BLANKS = "(blanks)"


def value_filter(df: DataFrame, allowed: dict[str, list]) -> DataFrame:
    """Rows whose columns all hold one of the allowed values; null counts as (blanks)."""
    for c, values in allowed.items():
        df = df.where(F.coalesce(q(c).cast("string"), F.lit(BLANKS)).isin(*[str(v) for v in values]))
    return df


def search_filter(df: DataFrame, parts: dict[str, str]) -> DataFrame:
    """Rows whose columns contain a substring, in any case."""
    for c, s in parts.items():
        df = df.where(F.contains(F.lower(F.coalesce(q(c).cast("string"), F.lit(BLANKS))), F.lit(s.lower())))
    return df


def format_filter(df: DataFrame, formats: dict[str, list[str]]) -> DataFrame:
    """Rows whose values have one of the abstract formats."""
    for c, fs in formats.items():
        df = df.where(abstract_format(q(c)).isin(*fs))
    return df


def mixed_order(c: Column, descending: bool = False) -> list[Column]:
    """Nulls last both ways; by number, or by a leading number; then by lower-case text."""
    s = c.cast("string")
    number = F.coalesce(s.try_cast("double"), F.regexp_extract(s, r"\A\s*(-?\d+(\.\d+)?)", 1).try_cast("double"))
    if descending:
        return [c.isNull().asc(), number.desc_nulls_last(), F.lower(s).desc()]
    return [c.isNull().asc(), number.asc_nulls_last(), F.lower(s).asc()]


def grid_page(df: DataFrame, allowed: dict[str, list] | None = None, search: dict[str, str] | None = None, formats: dict[str, list[str]] | None = None,
              sort: str | None = None, descending: bool = False, page: int = 100, skip: int = 0) -> DataFrame:
    """One page of the filtered, sorted grid."""
    out = format_filter(search_filter(value_filter(df, allowed or {}), search or {}), formats or {})
    keys = mixed_order(q(sort), descending) if sort else []
    return out.orderBy(*keys, *([ROW] if ROW in df.columns else [])).offset(skip).limit(page)


def distinct_values(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, value of the filter lists."""
    out = None
    for c in columns or data_columns(df):
        one = df.select(F.lit(c).alias("column_name"), F.coalesce(q(c).cast("string"), F.lit(BLANKS)).alias("value")).distinct()
        out = one if out is None else out.unionByName(one)
    return out
