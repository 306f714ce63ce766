"""Deterministic rules around a plan: which strategies suit a column, what a reviewer must see, what an answer changes."""
from __future__ import annotations

import re
from dataclasses import replace
from typing import Any

from ..operators.cast import logical_type
from .specs import ORDER, CleaningPlan, ColumnSpec, Task

#: Strategies by semantic type.
STRATEGIES: dict[str, tuple[str, ...]] = {
    "Continuous": ("fill_mean", "fill_median", "fill_mode", "fill_value", "keep_null"),
    "Discrete": ("fill_mode", "fill_mean", "fill_median", "fill_value", "keep_null"),
    "Nominal": ("fill_mode", "fill_value", "keep_null"),
    "Ordinal": ("fill_mode", "fill_value", "keep_null"),
    "Temporal": ("fill_median", "fill_value", "keep_null", "fill_mode"),
    "Free text + Geospatial": ("keep_null", "fill_value"),
    "Structured text": ("drop_row", "fill_value", "keep_null"),
    "Boolean": ("fill_mode", "fill_value", "keep_null"),
    "Identifier": ("drop_row", "keep_null"),
}
ALIASES = {"keep_null": "leave_as_is", "fill_constant": "fill_value"}
EXECUTABLE = ("fill_mean", "fill_median", "fill_mode", "fill_value", "drop_row", "leave_as_is")


def strategy_name(s: str) -> str:
    s = s.removeprefix("(Recommended)").strip()
    return ALIASES.get(s, s)


def suits_type(strategy: str, final_type: str | None) -> bool:
    """Means and medians need numbers or dates."""
    return strategy not in ("fill_mean", "fill_median") or final_type in ("int", "float", "date", "datetime")


def strategy_options(spec: ColumnSpec, null_rate: float) -> list[str]:
    """Strategies offered for a column with nulls."""
    if null_rate >= 1.0:
        options = ["fill_value", "keep_null"]
    else:
        options = list(STRATEGIES.get(spec.semantic_type, STRATEGIES["Nominal"]))
        if spec.semantic_type == "Temporal" and spec.expected_type in ("time", "str"):
            options = ["fill_mode", "fill_value", "keep_null"]
        if spec.semantic_type in ("Structured text", "Identifier"):
            options = [o for o in options if o != ("drop_row" if spec.allow_missing else "keep_null")]
    if not spec.allow_missing:
        options = [o for o in options if o != "keep_null"]
    return [o for o in options if suits_type(o, logical_type(spec.expected_type))]


def recommended(spec: ColumnSpec, null_rate: float, skew: float | None = None, has_outliers: bool = False, top_share: float | None = None) -> str:
    """Mean where a distribution is even and without outliers, else median; the mode of a nominal column only if it is common."""
    options = strategy_options(spec, null_rate)
    if spec.semantic_type == "Continuous" and {"fill_mean", "fill_median"} <= set(options):
        return "fill_mean" if skew is not None and abs(skew) < 1 and not has_outliers else "fill_median"
    if spec.semantic_type == "Discrete" and "fill_median" in options:
        return "fill_median"
    if spec.semantic_type in ("Nominal", "Ordinal", "Boolean") and "fill_mode" in options and (top_share is None or top_share > 0.4):
        return "fill_mode"
    if spec.semantic_type == "Temporal" and "fill_median" in options:
        return "fill_median"
    return next((o for o in ("keep_null", "drop_row", "fill_value") if o in options), "keep_null")


def final_type(plan: CleaningPlan, column: str, specs: dict[str, ColumnSpec]) -> str | None:
    """The type a column has after casting."""
    cast = next((t for t in plan.tasks if t.task_id == "type_casting" and not t.skip), None)
    planned = (cast.strategy if cast else {}).get(column) or (specs[column].expected_type if column in specs else None)
    return logical_type(planned)


def review_null_plan(plan: CleaningPlan, specs: dict[str, ColumnSpec], null_rates: dict[str, float] | None = None) -> list[dict[str, Any]]:
    """Fields a reviewer must settle: a strategy that doesn't suit the column, or a constant against its pattern or among its placeholders."""
    task = next((t for t in plan.tasks if t.task_id == "null_handling" and not t.skip), None)
    fields = []
    for column, config in (task.strategy if task else {}).items():
        if column not in specs:
            continue
        config = {"strategy": config} if isinstance(config, str) else config
        now, value, spec = strategy_name(str(config.get("strategy", "leave_as_is"))), config.get("fill_value"), specs[column]
        kind = final_type(plan, column, specs)
        fit = [o for o in dict.fromkeys(map(strategy_name, strategy_options(spec, (null_rates or {}).get(column, 0.0)))) if o in EXECUTABLE and suits_type(o, kind)]
        problems = []
        if now not in fit:
            problems.append(f"{now} doesn't suit {spec.semantic_type} of type {kind}")
        if now == "fill_value" and value is not None:
            if spec.expected_pattern and not _matches(spec.expected_pattern, str(value).strip()):
                problems.append(f"{value!r} doesn't match {spec.expected_pattern!r}")
            if value in spec.disguised_values:
                problems.append(f"{value!r} is a placeholder itself")
        if problems:
            keep = now == "fill_value"
            options = [now, *[o for o in fit if o != now]] if keep else fit or ["leave_as_is"]
            fields.append({"column": column, "value": options[0], "options": options, "may_keep": keep, "problems": problems})
    return fields


def _matches(pattern: str, text: str) -> bool:
    try:
        return re.match(pattern, text) is not None
    except re.error:
        return True


def override_null_plan(plan: CleaningPlan, answers: dict[str, dict[str, Any] | str]) -> CleaningPlan:
    """The plan with a person's strategies by column; constants they acknowledge are marked approved."""
    tasks = []
    for t in plan.tasks:
        if t.task_id == "null_handling":
            strategy = dict(t.strategy)
            for column, a in answers.items():
                a = {"strategy": a} if isinstance(a, str) else dict(a)
                a["strategy"] = strategy_name(a["strategy"])
                if a["strategy"] not in EXECUTABLE:
                    raise ValueError(f"{column}: {a['strategy']} can't be run")
                strategy[column] = a
            t = replace(t, strategy=strategy, rules=[r | ({"approved": True} if answers.get(r.get("column")) and isinstance(answers[r["column"]], dict) and answers[r["column"]].get("acknowledged") else {}) for r in t.rules])
        tasks.append(t)
    return replace(plan, tasks=tasks)


def override_dedup(plan: CleaningPlan, keys: list[str] | None = None, keep: str | None = None, skip: bool | None = None) -> CleaningPlan:
    """The plan with a person's keys, survivor rule or wish to skip deduplication."""
    tasks = []
    for t in plan.tasks:
        if t.task_id == "deduplication":
            strategy = dict(t.strategy) | ({"keys": keys} if keys is not None else {}) | ({"keep": keep} if keep else {})
            t = replace(t, strategy=strategy, skip=t.skip if skip is None else skip)
        tasks.append(t)
    return replace(plan, tasks=tasks)


def review_dedup_plan(plan: CleaningPlan, columns: list[str] | None = None) -> list[dict[str, Any]]:
    """Fields of a deduplication that a reviewer sees and may change: mode, keys, identifiers, ignored columns, survivor rule, fuzzy matching."""
    task = next((t for t in plan.tasks if t.task_id == "deduplication" and not t.skip), None)
    if task is None:
        return []
    s = task.strategy
    keys = list(s.get("keys") or s.get("primary_keys") or [])
    fuzzy = bool((s.get("fuzzy_matching") or {}).get("enabled"))
    mode = "fuzzy" if fuzzy else "exact_key" if keys else "exact_full_row"
    rows = (("mode", mode, False, None), ("key_columns", keys, True, columns), ("identifier_columns", list(s.get("identifier_columns") or keys), True, columns),
            ("ignored_columns", list(s.get("ignored_columns") or []), True, columns), ("keep_rule", s.get("keep", "keep_most_complete"), True, ["keep_most_complete", "keep_first", "keep_last"]), ("fuzzy_enabled", fuzzy, True, None))
    return [{"field": name, "value": value, "editable": editable, "options": options} for name, value, editable, options in rows]


def offered(options: list[str], spec: ColumnSpec, final: str | None) -> list[str]:
    """Options as a person sees them: no free prompts, no keep_null where values may not be missing, nothing that doesn't suit the type."""
    plain = [o for o in options if "prompt" not in o.lower() and "custom" not in o.lower()]
    return [o for o in plain if (spec.allow_missing or strategy_name(o) != "leave_as_is") and suits_type(strategy_name(o), final)]


def constant_problems(column: str, config: dict[str, Any], spec: ColumnSpec) -> list[str]:
    """What speaks against a fill constant before it is approved: none given, against the pattern, a placeholder itself."""
    if strategy_name(str(config.get("strategy", ""))) != "fill_value":
        return []
    value = config.get("fill_value")
    if value is None or not str(value).strip():
        return [f"{column}: no constant is given"]
    return ([f"{column}: {value!r} doesn't match {spec.expected_pattern!r}"] if spec.expected_pattern and not _matches(spec.expected_pattern, str(value).strip()) else []) + (
        [f"{column}: {value!r} is a placeholder itself"] if str(value) in map(str, spec.disguised_values) else [])


def allow_missing_from_answers(specs: dict[str, ColumnSpec], answers: dict[str, str]) -> dict[str, ColumnSpec]:
    """Specs with allow_missing by Yes and No answers."""
    said = {"yes": True, "y": True, "true": True, "no": False, "n": False, "false": False}
    return {c: replace(s, allow_missing=said.get(str(answers.get(c, "")).strip().lower(), s.allow_missing)) for c, s in specs.items()}


def missing_specs(specs: dict[str, ColumnSpec], columns: list[str]) -> dict[str, ColumnSpec]:
    """Specs of all columns; those without one are nominal strings that may be missing."""
    return {c: specs.get(c, ColumnSpec()) for c in columns}


def run_order(tasks: list[Task]) -> list[str]:
    return [t.task_id for t in sorted((t for t in tasks if not t.skip), key=lambda t: ORDER.index(t.task_id) if t.task_id in ORDER else len(ORDER))]


def column_family(name: str, spec: ColumnSpec | None = None) -> str:
    """email, phone, address, organization, person, identifier or text by words of a column's name and description."""
    words = f"{name} {spec.logical_group if spec else ''} {spec.description if spec else ''}".lower().replace("_", " ")
    #: Words by family, in order.
    marks = (
        ("email", ("email", "e-mail", "mailbox")), ("phone", ("phone", "telephone", "mobile", "fax")),
        ("address", ("address", "street", "location", "postal", "city", "district", "ward")),
        ("organization", ("organization", "company", "vendor", "provider name", "facility", "school", "hospital", "clinic", "firm")),
        ("person", ("person", "customer name", "individual", "patient", "full name", "contact name")),
        ("identifier", (" id", "identifier", "registration", "license", "tax number", "number", "code")))
    return next((f for f, ms in marks if any(m in words for m in ms)), "text")


def column_references(document: Any, column: str) -> bool:
    """A nested document names a column, as a key or a value."""
    if isinstance(document, dict):
        return any(k == column or column_references(v, column) for k, v in document.items())
    if isinstance(document, (list, tuple)):
        return any(column_references(v, column) for v in document)
    return document == column
