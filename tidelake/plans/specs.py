"""Specs of a cleaning run, as plain data: what the columns mean, what is done, what must hold."""
from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from hashlib import sha256
from typing import Any

#: Tasks run in this order.
ORDER = ("deduplication", "type_casting", "null_handling")


@dataclass
class ColumnSpec:
    """What a column means."""

    expected_type: str = "str"
    semantic_type: str = "Nominal"
    allow_missing: bool = True
    disguised_values: list[str] = field(default_factory=list)
    expected_pattern: str | None = None
    logical_group: str = ""
    description: str = ""


@dataclass
class Task:
    task_id: str
    strategy: dict[str, Any] = field(default_factory=dict)
    skip: bool = False
    skip_reason: str | None = None
    must_preserve_row_count: bool = False
    rules: list[dict[str, Any]] = field(default_factory=list)
    rationale: str = ""


@dataclass
class CleaningPlan:
    tasks: list[Task] = field(default_factory=list)
    summary: str = ""
    max_retries: int = 3

    def active(self) -> list[Task]:
        """Tasks that run, in order; unknown tasks last."""
        rank = {t: i for i, t in enumerate(ORDER)}
        return sorted((t for t in self.tasks if not t.skip), key=lambda t: rank.get(t.task_id, len(ORDER)))

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2, sort_keys=True)

    @staticmethod
    def fallback(reason: str) -> CleaningPlan:
        """The safe plan: every task is there, skipped, and says why."""
        return CleaningPlan([Task(t, skip=True, skip_reason=f"no plan: {reason}") for t in ORDER], f"Safe plan, as no other could be made: {reason}")

    @staticmethod
    def from_json(text: str) -> CleaningPlan:
        """A plan; text that can't be read gives the safe plan, in which all is skipped."""
        try:
            d = json.loads(outer_json(text))
            return CleaningPlan([Task(**t) for t in d.get("tasks", [])], d.get("summary", ""), d.get("max_retries", 3))
        except (ValueError, TypeError) as e:
            return CleaningPlan.fallback(str(e))


def outer_json(text: str) -> str:
    """The part of a text from its first { to its last }."""
    a, b = text.find("{"), text.rfind("}")
    return text[a : b + 1] if 0 <= a < b else text


def context_hash(context: Any) -> str:
    """SHA-256 of a context's canonical JSON; equal contexts reuse a decision."""
    return sha256(json.dumps(context, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()
