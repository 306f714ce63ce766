"""Seven notions of a missing value, each under its own name. All take and return Columns; none unify."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens that readers take for null.
INGEST_TOKENS = ("", "NULL", "null", "N/A", "n/a", "NA", "na", "NaN", "nan")
#: Lower-cased placeholders that profiling reports, in its order.
DISGUISED = ("N/A", "null", "unknown", "-", "none", "0")


def strip(c: Column) -> Column:
    """Without white space at both ends (all of Unicode's, not blanks only)."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def is_physical(c: Column) -> Column:
    return c.isNull()


def is_ingest_token(c: Column) -> Column:
    return c.isin(*INGEST_TOKENS)


def is_disguised(c: Column) -> Column:
    """By the profiler's rule."""
    return F.lower(strip(c.cast("string"))).isin(*[x.lower() for x in DISGUISED])


def is_disguised_or_blank(c: Column) -> Column:
    """By the quality check's rule, which counts blanks too."""
    return F.lower(strip(c.cast("string"))).isin(*[x.lower() for x in DISGUISED], "")


def is_listed(c: Column, values: list[str]) -> Column:
    """One of the literals that a semantic profile lists for the column."""
    return c.cast("string").isin(*values) if values else F.lit(False)


def is_diff_null(c: Column) -> Column:
    """Null for before/after comparison."""
    return c.isNull() | F.lower(strip(c.cast("string"))).isin("", "nan", "none", "null", "nat")


def is_score_null(c: Column) -> Column:
    """Null for scoring against ground truth."""
    return c.isNull() | F.regexp_replace(F.lower(strip(c.cast("string"))), r"\.0\z", "").isin("nan", "none", "", "empty")
