"""Runs a plan: each task folds operators over the table, is checked, and publishes a version if it passes."""
from __future__ import annotations

import logging
import time
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..operators import cast as C
from ..operators import impute as I
from ..operators import rules as V
from ..operators.profile import q
from . import dedup_task
from .dedup_task import planned_decision, reused_decision, saved_decision
from .lineage import LineageStore
from .specs import CleaningPlan, ColumnSpec, Task

__all__ = ["apply", "captured_formats", "metrics", "planned_decision", "repaired", "reused_decision", "run", "saved_decision", "write_artifact", "written_as"]
log = logging.getLogger(__name__)


@dataclass
class TaskResult:
    """One schema for all tasks."""

    task_id: str
    passed: bool
    rows_before: int
    rows_after: int
    version: int | None
    failed_rules: list[str] = field(default_factory=list)
    notes: dict[str, str] = field(default_factory=dict)
    seconds: float = 0.0
    attempts: int = 1


@dataclass
class RunResult:
    df: DataFrame
    tasks: list[TaskResult]
    needs_replan: bool = False
    formats: dict[str, str] = field(default_factory=dict)  # strftime formats that date columns were written in
    decisions: dict[str, Any] = field(default_factory=dict)
    artifacts: dict[str, str] = field(default_factory=dict)  # where each task's table was written


def apply(task: Task, df: DataFrame, specs: dict[str, ColumnSpec], decisions: dict[str, Any] | None = None) -> tuple[DataFrame, dict[str, str], list[str]]:
    """The table after one task, notes, and rules that failed already: columns that the task can't treat, duplicates that are left. decisions: those
    of earlier runs by task, which are taken again where nothing they depend on has changed, and which this run's replace."""
    if task.task_id == "deduplication":
        done = dedup_task.run(df, task, specs, decisions.get(task.task_id) if decisions is not None else None)
        if decisions is not None:
            decisions[task.task_id] = done.saved
        return done.df, done.notes | {"next_action": done.payload["next_action"]}, done.failed
    if task.task_id == "type_casting":
        out, failed = C.cast_checked(df, C.cast_plan(task.strategy, list(task.strategy), {c: s.expected_type for c, s in specs.items()}))
        return out, {}, failed
    if task.task_id == "null_handling":
        r = I.apply_plan(df, task.strategy, {c: vars(s) for c, s in specs.items()})
        return r.df, r.notes, []
    raise ValueError(f"unknown task {task.task_id}")


def repaired(task: Task, failed: list[str]) -> Task:
    """The task without what failed: columns whose cast or check failed are left as they are. The same task if no column is to blame."""
    columns = {r.split(":", 1)[1] for r in failed if ":" in r} & set(task.strategy)
    return replace(task, strategy={c: v for c, v in task.strategy.items() if c not in columns}) if columns and task.task_id == "type_casting" else task


#: What a task's artifact is called by.
ARTIFACTS = {"deduplication": "deduplicated", "type_casting": "type_casted", "null_handling": "null_handled"}


def write_artifact(df: DataFrame, path: str, fallback: str, session: str, task: Task) -> str:
    """The task's table as <session>_<what was done>.parquet in a folder; in the fallback folder if that can't be written."""
    name = f"{session}_{ARTIFACTS.get(task.task_id, task.task_id)}.parquet"
    try:
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")
        return f"{path.rstrip('/')}/{name}"
    except Exception as e:  # the folder may be read-only; a second failure is the caller's
        log.warning("%s can't be written, %s is taken: %s", path, fallback, e)
        df.write.mode("overwrite").parquet(f"{fallback.rstrip('/')}/{name}")
        return f"{fallback.rstrip('/')}/{name}"


def run(plan: CleaningPlan, df: DataFrame, store: LineageStore, session: str, specs: dict[str, ColumnSpec] | None = None,
        decisions: dict[str, Any] | None = None, artifacts: tuple[str, str] | None = None, keep_formats: bool = False) -> RunResult:
    """All active tasks. A task that fails, by a rule or by an error, is tried again up to the plan's retries if it can be repaired; then the run
    stops and asks for a new plan, with what failed.

    Each task's table is written once as its version and read back, so validation and the next task don't repeat the work;
    a version of a failed task isn't published. artifacts: a folder, and one to fall back to, in which each task's table is written too.
    keep_formats: columns that became dates are written, once all tasks have passed, in the format of their first value, as a last version."""
    specs, results, formats, paths = specs or {}, [], {}, {}
    decisions = dict(decisions or {})
    if store.latest_number(session) == 0:
        store.append(session, df, "ingest", "original")
        df = store.read(session)
    for task in plan.active():
        before, now = df.count(), task
        for attempt in range(1, plan.max_retries + 1):
            began, after, version, notes, failed = time.time(), before, None, {}, []
            try:
                if keep_formats and now.task_id == "type_casting":
                    formats = captured_formats(df, C.cast_plan(now.strategy, list(now.strategy), {c: s.expected_type for c, s in specs.items()}))
                out, notes, failed = apply(now, df, specs, decisions)
                out = out.persist()
                try:
                    after = out.count()
                    failed = failed + I.guard(before, after, now.must_preserve_row_count)
                    strategies = {c: (s if isinstance(s, str) else s.get("strategy", "")) for c, s in now.strategy.items()} if now.task_id == "null_handling" else {}
                    if now.rules:
                        failed += [r["rule"] + (f":{r['column']}" if r["column"] else "") for r in V.validate(out, now.rules, strategies).where("NOT passed").collect()]
                    version = None if failed else store.append(session, out, now.task_id, now.rationale)
                finally:
                    out.unpersist()
            except Exception as e:  # a task's error fails the task, not the run
                log.exception("%s failed", now.task_id)
                failed = [*failed, f"error:{type(e).__name__}"]
                notes = notes | {"error": str(e).split("\n")[0][:500]}
            result = TaskResult(now.task_id, not failed, before, after, version, failed, notes, round(time.time() - began, 3), attempt)
            if not failed:
                df = store.read(session)
                if artifacts:
                    paths[task.task_id] = write_artifact(df, *artifacts, session, task)
                left = sorted(set(task.strategy) - set(now.strategy))
                if left:
                    result.notes["left_as_they_are"] = ", ".join(left)
                break
            again = repaired(now, failed)
            if again == now and not any(f.startswith("error:") for f in failed):
                break  # the same task on the same table fails alike
            now = again
        results.append(result)
        if not result.passed:
            return RunResult(df, results, True, formats, decisions, paths)
    if formats:
        df = written_as(df, formats)
        store.append(session, df, "formatting", "dates as they were written")
        df = store.read(session)
    return RunResult(df, results, False, formats, decisions, paths)


def captured_formats(df: DataFrame, plan: dict[str, str]) -> dict[str, str]:
    """The strftime format of the first value of each string column that becomes a date or date-time."""
    dates = [c for c, t in plan.items() if C.logical_type(t) in ("date", "datetime") and c in df.columns and isinstance(df.schema[c].dataType, T.StringType)]
    return {c: f for c in dates if (f := C.original_format(df, c)[1])}


def written_as(df: DataFrame, formats: dict[str, str]) -> DataFrame:
    """Date columns as strings in their original formats; others, and columns that are strings still, stay."""
    temporal = (T.DateType, T.TimestampType, T.TimestampNTZType)
    todo = {c: f for c, f in formats.items() if c in df.columns and isinstance(df.schema[c].dataType, temporal)}
    return df.withColumns({c: C.restore_format(q(c), f) for c, f in todo.items()}) if todo else df


def metrics(result: RunResult) -> dict[str, Any]:
    """Totals of a run, and seconds, rows and attempts of each task."""
    each = {t.task_id: {"seconds": t.seconds, "rows_before": t.rows_before, "rows_after": t.rows_after, "attempts": t.attempts, "failed_rules": len(t.failed_rules), "version": t.version} for t in result.tasks}
    return {"by_task": each, "tasks": len(result.tasks), "passed": all(t.passed for t in result.tasks), "seconds": round(sum(t.seconds for t in result.tasks), 3),
            "rows_removed": sum(t.rows_before - t.rows_after for t in result.tasks)}
