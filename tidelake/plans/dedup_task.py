"""A run's deduplication: which keys serve, exact rows and keys, then fuzzy pairs and their merge, then what must hold afterwards."""
from __future__ import annotations

from dataclasses import asdict, dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dedup as E
from ..operators import fuzzy as Z
from ..operators import profile as P
from ..scratch import written
from . import suggest as U
from .guardrails import column_family
from .specs import ColumnSpec, Task, context_hash


@dataclass
class DedupOutcome:
    """The table, the decision taken (with its context's hash, to be reused), what was found, and failed rules."""

    df: DataFrame
    saved: dict[str, Any]
    notes: dict[str, str] = field(default_factory=dict)
    failed: list[str] = field(default_factory=list)
    payload: dict[str, Any] = field(default_factory=dict)


def planned_decision(task: Task) -> E.DedupDecision:
    """The decision that a planner's deduplication task states: its keys without ignored columns, survivor rule and handlers."""
    s = task.strategy
    keys = list(dict.fromkeys(s.get("keys") or s.get("primary_keys") or (s.get("key_based") or {}).get("keys") or []))
    return E.DedupDecision([k for k in keys if k not in set(s.get("ignored_columns") or [])], s.get("keep", "keep_most_complete"), dict(s.get("handlers", {})), "the plan's own decision")


def reused_decision(context: dict[str, Any], saved: dict[str, Any] | None) -> E.DedupDecision | None:
    """The saved decision {context_hash, decision} if it was made in an equal context, else null."""
    if not saved or saved.get("context_hash") != context_hash(context):
        return None
    return E.DedupDecision(**saved["decision"])


def saved_decision(context: dict[str, Any], decision: E.DedupDecision) -> dict[str, Any]:
    return {"context_hash": context_hash(context), "decision": asdict(decision)}


def decision_context(df: DataFrame, task: Task, specs: dict[str, ColumnSpec], stats: list[dict[str, Any]]) -> dict[str, Any]:
    """What a decision depends on: the plan's wishes, what the columns mean, and their profile."""
    return {"strategy": task.strategy, "specs": {c: vars(s) for c, s in sorted(specs.items())}, "profile": stats, "columns": df.dtypes}


def decide(df: DataFrame, task: Task, specs: dict[str, ColumnSpec], saved: dict[str, Any] | None = None) -> tuple[E.DedupDecision, dict[str, Any]]:
    """(decision, what to save of it). The saved one if its context is the same; else the planned keys if they can serve; else, if keys were
    planned or wished for (infer_keys), the first that can serve and has duplicates of: planned columns, near-unique columns, key candidates;
    else full rows only."""
    told = P.column_stats(df)
    stats = [r.asDict() for r in told.collect()]  # a row for each column
    context = decision_context(df, task, specs, stats)
    if (same := reused_decision(context, saved)) is not None:
        return same, saved
    technical = lambda c: specs.get(c, ColumnSpec()).semantic_type == "Identifier" or column_family(c, specs.get(c)) == "identifier"
    by_name = {r["column_name"]: {"null_rate": r["null_rate"], "unique_ratio": r["unique_ratio"], "is_technical": technical(r["column_name"])} for r in stats}
    planned = planned_decision(task)
    decision = planned
    if planned.keys or task.strategy.get("infer_keys"):
        decision = E.check_decision(planned, by_name, df)
        if not decision.keys:
            usable = lambda keys: bool(E.check_decision(E.DedupDecision(keys), by_name, df).keys)
            ignored = set(task.strategy.get("ignored_columns") or [])
            other = E.fallback_decision(df, told, [], [c for c in task.strategy.get("columns") or [] if c not in ignored], usable)
            why = f"{decision.reason}; {other.reason}" if planned.keys else other.reason
            decision = E.DedupDecision(other.keys, planned.keep, {c: h for c, h in planned.handlers.items() if c in other.keys}, why)
    return decision, saved_decision(context, decision)


def _block_key(d: dict[str, Any]) -> Z.BlockKey:
    return Z.BlockKey(tuple(d.get("columns") or ()), d.get("transform", "normalized_prefix"), bool(d.get("required", False)))


def blocking_of(d: dict[str, Any]) -> Z.Blocking:
    """A comparison from a plain document; unknown fields are left out."""
    known = {k: v for k, v in d.items() if k in Z.Blocking.__dataclass_fields__ and k not in ("block_keys", "sub_block_columns")}
    return Z.Blocking(**known, block_keys=tuple(_block_key(k) for k in d.get("block_keys") or ()), sub_block_columns=tuple(d.get("sub_block_columns") or ()))


def evidence_of(d: dict[str, Any]) -> Z.Evidence:
    known = {k: tuple(v) if isinstance(v, list) else v for k, v in d.items() if k in Z.Evidence.__dataclass_fields__}
    return Z.Evidence(**known)


def fuzzy_wish(task: Task) -> dict[str, Any]:
    s = task.strategy
    return {"scope": s.get("scope"), "type": s.get("type"), **(s.get("fuzzy_matching") or s.get("fuzzy") or {})}


def merge_fuzzy(df: DataFrame, task: Task, specs: dict[str, ColumnSpec], keep: str) -> tuple[DataFrame, dict[str, str], dict[str, int]]:
    """(df without the losers of supported pairs, notes, pairs by resolution)."""
    wish = fuzzy_wish(task)
    families = {c: f for c in P.data_columns(df) if (f := column_family(c, specs.get(c))) in ("organization", "person", "address")}
    plan = Z.check_plan(df, [blocking_of(d) for d in wish.get("blockings") or ()], [evidence_of(d) for d in wish.get("evidence") or ()], tuple(task.strategy.get("ignored_columns") or ()), families)
    notes, counts, supported = {f"fuzzy_{i}": n for i, n in enumerate(plan.notes)}, {}, []
    for c in Z.candidate_sets(df, plan):
        resolved = written(Z.resolve(df, c.pairs, c.spec, list(plan.evidence)), "resolved")
        for r in U.resolution_counts(resolved).collect():  # three rows
            counts[r["resolution"]] = counts.get(r["resolution"], 0) + r["n"]
        notes[f"fuzzy_{c.spec.spec_id}"] = f"{c.found} pairs of {c.rows} rows in {c.blocks} blocks" + (f", {c.capped} rows over the cap" if c.capped else "")
        supported.append(resolved.where("resolution = 'supported'").select("row_a", "row_b"))
    if not supported or not counts.get("supported"):
        return df, notes, counts
    return Z.fuzzy_merge(df, reduce(DataFrame.unionByName, supported).distinct(), keep), notes, counts


def run(df: DataFrame, task: Task, specs: dict[str, ColumnSpec], saved: dict[str, Any] | None = None) -> DedupOutcome:
    """Full rows, keys, then fuzzy pairs if the task asks for them; checked for rows gained and duplicates left."""
    decision, save = decide(df, task, specs, saved)
    out = E.run(df, decision)
    notes = {"keys": ", ".join(decision.keys) or "full rows", "decision": decision.reason}
    counts: dict[str, int] = {}
    if Z.should_run(fuzzy_wish(task)):
        out = written(out, "exact")
        out, more, counts = merge_fuzzy(out, task, specs, decision.keep)
        notes |= more
    out = written(out, "deduplicated")
    failed = E.guard(df, out, decision)
    return DedupOutcome(out, save, notes, failed, U.dedup_payload(df.count(), out.count(), failed, counts))
