"""Missing-value strategies, in plan order. Fill values are scalars, found together for each run of fills."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates as D
from .heavy import modes
from .profile import q
from .ranks import exact_quantiles

ALIASES = {"keep_null": "leave_as_is", "fill_constant": "fill_value", "skip": "leave_as_is"}
KNOWN = ("drop_row", "fill_value", "fill_mode", "fill_mean", "fill_median", "leave_as_is")
PROHIBITED = ("drop_column", "fill_llm")


class FillTypeError(ValueError):
    """A fill constant that doesn't fit the column's type."""


@dataclass
class ImputeResult:
    df: DataFrame
    notes: dict[str, str] = field(default_factory=dict)
    values: dict[str, Any] = field(default_factory=dict)


def semantic_type(df: DataFrame, column: str, semantic: dict[str, dict] | None = None) -> str:
    """Profile's semantic type, else by expected type, else by physical type, else Nominal."""
    spec = (semantic or {}).get(column, {})
    if spec.get("semantic_type"):
        return spec["semantic_type"]
    by_name = {"int": "Discrete", "float": "Continuous", "bool": "Boolean", "date": "Temporal", "datetime": "Temporal", "time": "Temporal", "str": "Nominal"}
    if spec.get("expected_type") in by_name:
        return by_name[spec["expected_type"]]
    kind = df.schema[column].dataType
    if isinstance(kind, T.IntegralType):
        return "Discrete"
    if isinstance(kind, T.NumericType):
        return "Continuous"
    if isinstance(kind, T.BooleanType):
        return "Boolean"
    return "Temporal" if isinstance(kind, (T.TimestampNTZType, T.TimestampType, T.DateType)) else "Nominal"


def coerce_constant(value: Any, kind: T.DataType) -> Any:
    """value as the column's type takes it; FillTypeError if it can't."""
    text = str(value).strip()
    try:
        if isinstance(kind, T.BooleanType):
            return {"true": True, "1": True, "yes": True, "false": False, "0": False, "no": False}[text.lower()]
        if isinstance(kind, T.IntegralType):
            number = float(text)
            if number != int(number):
                raise ValueError(text)
            return int(number)
        if isinstance(kind, T.NumericType):
            return float(text)
        if isinstance(kind, T.DateType):
            return date.fromisoformat(text[:10])
        if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
            return datetime.fromisoformat(text)
    except (KeyError, ValueError) as e:
        raise FillTypeError(f"fill_value_final_dtype_mismatch: {value!r} for {kind.simpleString()}") from e
    return str(value)


@dataclass(frozen=True)
class Statistic:
    """What fills a column: the mean, median or mode of `over`, in the form that `back` gives it."""

    how: str
    over: Column
    back: Callable[[Column], Column]


def fill_statistic(df: DataFrame, column: str, strategy: str, kind: str) -> Statistic | None:
    """The statistic that fills a column; null where the strategy doesn't suit its type (then it is skipped)."""
    c, have, how = q(column), df.schema[column].dataType, strategy.removeprefix("fill_")
    if how == "mode":
        return Statistic(how, c, lambda v: v)
    if kind == "Temporal":
        if isinstance(have, T.StringType):
            t = D.parse_timestamp(c)
        elif isinstance(have, (T.TimestampNTZType, T.TimestampType, T.DateType)):
            t = c.cast("timestamp_ntz")
        else:
            return None
        text = isinstance(have, T.StringType)
        return Statistic(how, D.micros(t), lambda v: F.date_format(D.from_micros(F.floor(v)), "yyyy-MM-dd HH:mm:ss") if text else D.from_micros(F.floor(v)).cast(have))
    if not isinstance(have, T.NumericType):
        return None
    whole = kind == "Discrete" or isinstance(have, T.IntegralType)
    return Statistic(how, c, lambda v: (F.bround(v, 0) if whole else v).cast(have))


def statistics(df: DataFrame, wanted: dict[str, Statistic]) -> dict[str, Any]:
    """{column: value}: means in one aggregate, medians by counting, modes by grouping; no buffer grows with a column."""
    means = {c: s for c, s in wanted.items() if s.how == "mean"}
    found: dict[str, Any] = modes(df, [c for c, s in wanted.items() if s.how == "mode"], q)
    raw = dict(zip(means, df.agg(*[F.avg(s.over) for s in means.values()]).first(), strict=True)) if means else {}
    medians = exact_quantiles(df, {c: s.over for c, s in wanted.items() if s.how == "median"}, [0.5])
    raw |= {c: v and v[0] for c, v in medians.items()}
    if raw:
        kinds = {c: "double" if c in medians else df.select(F.avg(wanted[c].over)).schema[0].dataType for c in raw}
        made = df.sparkSession.range(1).select(*[wanted[c].back(F.lit(v).cast(kinds[c])).alias(f"v{i}") for i, (c, v) in enumerate(raw.items())]).first()
        found |= dict(zip(raw, made, strict=True))
    return found


def apply_plan(df: DataFrame, plan: dict[str, dict | str], semantic: dict[str, dict] | None = None) -> ImputeResult:
    """plan: {column: strategy or {"strategy": ..., "fill_value": ...}}, applied in order; a drop_row changes what later columns see.

    Statistics of consecutive fills are taken together (they don't depend on each other); each drop_row ends a run."""
    out, pending = ImputeResult(df), []

    def settle() -> None:
        if not pending:
            return
        values = statistics(out.df, {c: s for c, s, _ in pending if s is not None}) | {c: v for c, s, v in pending if s is None}
        for c, v in values.items():
            if v is None:
                out.notes[c] = "skipped: no value to fill with"
            else:
                out.values[c] = v
        kinds = {c: out.df.schema[c].dataType for c in values}
        out.df = out.df.select(*(
            F.coalesce(q(c), F.lit(values[c]).cast(kinds[c])).alias(c) if values.get(c) is not None else q(c) for c in out.df.columns))
        pending.clear()

    for column, spec in plan.items():
        spec = {"strategy": spec} if isinstance(spec, str) else spec
        strategy = ALIASES.get(spec.get("strategy", ""), spec.get("strategy", ""))
        if column not in out.df.columns:
            out.notes[column] = "missing column"
        elif strategy in PROHIBITED:
            out.notes[column] = f"{strategy} isn't done; left as it is"
        elif strategy not in KNOWN:
            out.notes[column] = f"unknown strategy {strategy!r}; left as it is"
        elif strategy == "drop_row":
            settle()
            out.df = out.df.where(q(column).isNotNull())
        elif strategy == "fill_value":
            pending.append((column, None, coerce_constant(spec.get("fill_value", "Unknown"), out.df.schema[column].dataType)))
        elif strategy != "leave_as_is":
            stat = fill_statistic(out.df, column, strategy, semantic_type(out.df, column, semantic))
            if stat is None:
                out.notes[column] = f"{strategy} doesn't suit the type; skipped"
            else:
                pending.append((column, stat, None))
    settle()
    return out


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, nulls. One pass."""
    each = [F.struct(F.lit(c).alias("column_name"), (F.count(F.lit(1)) - F.count(q(c))).alias("nulls")) for c in columns]
    return df.agg(F.array(*each).alias("a")).select(F.inline("a"))


def guard(rows_before: int, rows_after: int, must_preserve: bool) -> list[str]:
    return ["row_count_increased"] * (rows_after > rows_before) + ["row_count_not_preserved"] * (must_preserve and rows_after != rows_before)
