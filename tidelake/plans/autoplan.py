"""A plan from a profile alone: types by vote, strategies by the rule table, keys by uniqueness."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nullness import DISGUISED
from ..operators import profile as P
from ..operators.profile import ROW, data_columns, is_numeric
from .guardrails import column_family, recommended
from .specs import CleaningPlan, ColumnSpec, Task

NUMERIC_WORDS = ("id", "zip", "code", "phone", "number")


def infer_specs(df: DataFrame) -> dict[str, ColumnSpec]:
    """Column specs from physical types, numeric and temporal votes, patterns and uniqueness. A fixed number of aggregates, whatever the rows."""
    columns = data_columns(df)
    text = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    stats = {r["column_name"]: r for r in P.column_stats(df).collect()}
    numbers = {r["column_name"]: r["expected_type"] for r in P.numeric_vote(df, text).collect()} if text else {}
    times = {r["column_name"]: r for r in P.temporal_vote(df, text).collect()} if text else {}
    patterns = {r["column_name"]: r["pattern"] for r in P.detected_pattern(df, text).collect()} if text else {}
    hidden: dict[str, list[str]] = {}
    if text:
        for r in P.disguised_nulls(df, text).collect():
            hidden.setdefault(r["column_name"], []).append(r["rule"])
    out = {}
    for c in columns:
        kind, unique = df.schema[c].dataType, stats[c]["unique_category"]
        idlike = any(w in c.lower().replace("_", " ").split() for w in NUMERIC_WORDS)
        expected, semantic = "str", "Nominal"
        if isinstance(kind, T.BooleanType) or patterns.get(c) == "boolean_str":
            expected, semantic = "bool", "Boolean"
        elif isinstance(kind, (T.TimestampNTZType, T.TimestampType, T.DateType)):
            expected, semantic = "date" if isinstance(kind, T.DateType) else "datetime", "Temporal"
        elif is_numeric(df, c):
            whole = isinstance(kind, T.IntegralType)
            expected, semantic = ("int", "Discrete") if whole else ("float", "Continuous")
            if whole and unique == "primary_key":
                semantic = "Identifier"
        elif patterns.get(c) in ("date_iso", "datetime_iso"):
            expected, semantic = "date" if patterns[c] == "date_iso" else "datetime", "Temporal"
        elif times.get(c) and times[c]["expected_type"] and times[c]["n_date_time"] + times[c]["n_time_only"] > 0.5 * (stats[c]["total_rows"] - stats[c]["null_count"]):
            expected, semantic = times[c]["expected_type"], "Temporal"
        elif numbers.get(c) and not idlike:
            expected, semantic = numbers[c], "Discrete" if numbers[c] == "int" else "Continuous"
        elif patterns.get(c) in ("email", "url", "phone", "uuid", "zip_us", "json_object", "json_array"):
            semantic = "Structured text"
        elif unique == "primary_key":
            semantic = "Identifier"
        elif unique in ("near_unique", "regular"):
            semantic = "Free text + Geospatial"
        out[c] = ColumnSpec(expected, semantic, disguised_values=[d for d in DISGUISED if d in hidden.get(c, [])], logical_group=column_family(c))
    return out


def plan(df: DataFrame, specs: dict[str, ColumnSpec] | None = None) -> CleaningPlan:
    """Full-row deduplication, casts of strings to their expected types, and the recommended strategy of each column with nulls."""
    specs = specs or infer_specs(df)
    stats = {r["column_name"]: r for r in P.column_stats(df).collect()}
    numeric = [c for c in data_columns(df) if is_numeric(df, c)]
    shape = {r["column_name"]: r for r in P.numeric_stats(df, numeric, approx=True).collect()} if numeric else {}
    duplicates = P.duplicate_rows(df).first()[0]
    casts = {c: s.expected_type for c, s in specs.items() if s.expected_type != "str" and isinstance(df.schema[c].dataType, T.StringType)}
    fills = {}
    for c, s in specs.items():
        if stats[c]["null_count"] == 0 and c not in casts:
            continue
        r = shape.get(c)
        outliers = bool(r and r["iqr"] is not None and (r["min"] < r["q1"] - 1.5 * r["iqr"] or r["max"] > r["q3"] + 1.5 * r["iqr"]))
        skew = r["skew"] if r and r["skew"] == r["skew"] else None
        fills[c] = {"strategy": recommended(s, stats[c]["null_rate"], skew, outliers)}
    return CleaningPlan([
        Task("deduplication", {"keys": [], "keep": "keep_first"}, skip=duplicates == 0, skip_reason=None if duplicates else "no duplicate rows", rules=[{"rule": "duplicate_rows_eq_0"}]),
        Task("type_casting", casts, skip=not casts, skip_reason=None if casts else "all types fit", must_preserve_row_count=True),
        Task("null_handling", fills, skip=not fills, skip_reason=None if fills else "no nulls")], "planned by rules")


def issues(df: DataFrame, specs: dict[str, ColumnSpec]) -> list[tuple[str, str]]:
    """(NULL, DUPLICATE or TYPECAST; column) of a table."""
    stats = P.column_stats(df).where(F.col("null_count") > 0).select("column_name").collect()
    found = [("NULL", r[0]) for r in stats]
    found += [("TYPECAST", c) for c, s in specs.items() if c in df.columns and s.expected_type != "str" and isinstance(df.schema[c].dataType, T.StringType)]
    return found + [("DUPLICATE", "*")] * (P.duplicate_rows(df).first()[0] > 0)


__all__ = ["ROW", "infer_specs", "issues", "plan"]
