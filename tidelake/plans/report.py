"""Reports of a run as JSON, Markdown or HTML, with diagrams and plain-language notes."""
from __future__ import annotations

import html
import json
from dataclasses import asdict
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import diff as A
from ..operators.profile import ROW, data_columns
from .executor import RunResult, metrics
from .guardrails import column_references
from .lineage import LineageStore
from .specs import CleaningPlan


def interpret(stat: dict[str, Any], patterns: list[str] | None = None) -> list[str]:
    """What a column's null rate and uniqueness say."""
    r, u = stat["null_rate"], stat["unique_ratio"]
    bands = ((0.0, "no missing values"), (0.05, f"very few missing values ({r:.2%})"), (0.2, f"some missing values ({r:.2%}); consider filling"), (0.5, f"many missing values ({r:.2%}); fill or remove"))
    said = [next((m for most, m in bands if r <= most), f"mostly missing ({r:.2%}); consider dropping the column")]
    said.append({
        "primary_key": "all values differ; a key candidate", "near_unique": f"{stat['total_rows'] - stat['unique_count']:,} values repeat; look for unintended duplicates",
        "categorical": f"{stat['unique_count']:,} distinct values; probably a category", "constant": "no value carries information"}.get(stat["unique_category"], f"unique ratio {u:.4f}; a regular column"))
    return said + ([f"looks like {', '.join(patterns)}"] if patterns else [])


def plan_summary(plan: CleaningPlan) -> dict[str, Any]:
    return {"summary": plan.summary, "active": [t.task_id for t in plan.active()], "skipped": {t.task_id: t.skip_reason for t in plan.tasks if t.skip}}


def validation_summary(result: RunResult) -> dict[str, Any]:
    issues = [{"task": t.task_id, "rule": r} for t in result.tasks for r in t.failed_rules]
    return {"passed": not issues, "issues": issues, "issue_count": len(issues)}


def step_changes(store: LineageStore, session: str, column: str | None = None) -> DataFrame:
    """version, agent_name, column_name, changed_cells, removed_rows: what each version changed of the one before it, rows matched by their index.
    column: that one only. Versions that share no column have no rows."""
    versions = store.versions(session).select("version", "agent_name").collect()
    parts = []
    for a, b in zip(versions, versions[1:], strict=False):
        old, new = store.read(session, a["version"]), store.read(session, b["version"])
        if column:
            old, new = (df.select(ROW, *[c for c in (column,) if c in df.columns]) for df in (old, new))
        if not set(data_columns(old)) & set(data_columns(new)):
            continue
        gone = old.join(new, ROW, "left_anti").count()
        parts.append(A.column_changes(old, new, align="row_index").select(F.lit(b["version"]).alias("version"), F.lit(b["agent_name"]).alias("agent_name"), "column_name", F.col("changed_cells").cast("bigint").alias("changed_cells"),
                                                                          F.lit(gone).cast("bigint").alias("removed_rows")))
    return reduce(DataFrame.unionByName, parts) if parts else store.spark.createDataFrame([], "version int, agent_name string, column_name string, changed_cells bigint, removed_rows bigint")


def actions(plan: CleaningPlan, result: RunResult) -> list[dict[str, Any]]:
    """What each task that ran did: its treatment of each column, and rows that it removed."""
    ran, out = {t.task_id: t for t in result.tasks if t.passed}, []
    for task in plan.active():
        if task.task_id not in ran:
            continue
        t = ran[task.task_id]
        if task.task_id in ("type_casting", "null_handling"):
            named = lambda s: s if isinstance(s, str) else str(s.get("strategy") or s.get("expected_type") or "treated")
            out += [{"task": task.task_id, "column": c, "action": named(s)} for c, s in task.strategy.items() if c not in t.notes.get("left_as_they_are", "").split(", ")]
        if t.rows_before != t.rows_after:
            out.append({"task": task.task_id, "column": None, "action": f"removed {t.rows_before - t.rows_after} rows"})
    return out


def build(plan: CleaningPlan, result: RunResult, store: LineageStore, session: str, truth: DataFrame | None = None, align: str = "position", tokens: list[dict[str, int]] | None = None) -> dict[str, Any]:
    """All of a run: plan, tasks and their actions, checks, versions, changed columns, what each step changed, score against ground truth, next
    actions. tokens: what calls of a planner's model used, summed by name."""
    first, last = store.read(session, 1), store.read(session)
    changes = [r.asDict() for r in A.top_changed(A.column_changes(first, last, align=align), 12).collect()]
    doc = {"session": session, "plan": plan_summary(plan), "tasks": [asdict(t) for t in result.tasks], "metrics": metrics(result), "validation": validation_summary(result),
           "versions": [r.asDict() for r in store.versions(session).drop("path").collect()], "changed_columns": changes, "n_columns": len(last.columns) - 1, "rows": (first.count(), last.count())}
    doc["actions"], doc["metrics"]["tokens"] = actions(plan, result), {k: sum(t.get(k, 0) for t in tokens or []) for k in sorted({k for t in tokens or [] for k in t})}
    doc["step_changes"] = [r.asDict() for r in step_changes(store, session).where("changed_cells > 0").collect()]  # a row for each version and column at most
    if truth is not None:
        doc["score"] = A.score(first, last, truth, align=align).first().asDict()
    doc["next_actions"] = next_actions(doc)
    return doc


def batch_rollup(runs: DataFrame) -> DataFrame:
    """One row over runs(status, input_rows, tokens, f1): completed, failed, total, and of completed runs total_rows, total_tokens and mean_f1 in percent."""
    done = F.col("status") == "completed"
    of = lambda c: F.coalesce(F.sum(F.when(done, F.col(c))), F.lit(0)).cast("bigint")
    return runs.agg(F.count_if(done).alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.count(F.lit(1)).alias("total"),
                    of("input_rows").alias("total_rows"), of("tokens").alias("total_tokens"), (100 * F.avg(F.when(done, F.col("f1")))).alias("mean_f1"))


def cell_count(doc: dict[str, Any]) -> int | None:
    """Cells that were scored, else rows of the last task times the columns that are followed; null if neither is known."""
    if doc.get("score"):
        return doc["score"]["cells"]
    rows = doc["tasks"][-1]["rows_after"] if doc.get("tasks") else None
    return rows * doc["n_columns"] if rows is not None and doc.get("n_columns") else None


def contexts(doc: dict[str, Any]) -> dict[str, bool]:
    """What a report can be asked about, and whether this one holds it."""
    return {"plan": bool(doc["plan"]["active"] or doc["plan"]["skipped"]), "workers": bool(doc["tasks"]), "validation": bool(doc.get("validation")), "lineage": bool(doc["versions"]),
            "score": bool(doc.get("score")), "changes": len(doc["versions"]) > 1, "exports": True}


def suggested_questions(doc: dict[str, Any], most: int = 4) -> list[str]:
    """Questions that this report can answer."""
    asked = [
        (doc["changed_columns"], "What changed after cleaning, and which steps changed it?"), (doc["versions"], "Which step made each version?"),
        (doc["validation"]["issue_count"], "Which validation issues remain?"), (not doc["validation"]["issue_count"], "Did validation pass, and what shows that?"),
        (doc.get("score"), "How good is the F1 score of this run?"), (doc.get("next_actions"), "What should I do next?")]
    return [q for holds, q in asked if holds][:most]


def console_profile(source: str, rollup: dict[str, Any], stats: list[dict[str, Any]], patterns: dict[str, str] | None = None, samples: dict[str, list] | None = None, most: int = 8) -> str:
    """A profile as plain text: the table's figures, then each column's. rollup and stats: rows of dataset_rollup and column_stats as dicts."""
    wide, thin = "=" * 80, "-" * 80
    out = [wide, "  STATISTICAL PROFILE", f"  Source       : {source}", f"  Total rows   : {rollup['total_rows']:,}", f"  Total columns: {len(stats)}", wide]
    named = {kind: [s["column_name"] for s in stats if s["unique_category"] == kind] for kind in ("primary_key", "near_unique", "categorical")}
    named["high_null"] = [s["column_name"] for s in stats if s["null_rate"] > 0.3]
    out += [f"  {kind:<14}: {', '.join(columns)}" for kind, columns in named.items() if columns] + [f"  {'duplicate rows':<14}: {rollup['duplicate_rows']:,}"]
    for s in stats:
        found = (patterns or {}).get(s["column_name"])
        out += [thin, f"  Column : {s['column_name']}", f"  Nulls  : {s['null_count']:,} / {s['total_rows']:,} ({s['null_rate']:.2%})",
                f"  Unique : {s['unique_count']:,} (ratio {s['unique_ratio']:.4f}, {s['unique_category']})"]
        values = (samples or {}).get(s["column_name"], [])
        out += [f"  Values : {values[:most]!r}" + (f" and {len(values) - most} more" if len(values) > most else "")] * bool(values)
        out += [f"    {x}" for x in interpret(s, [found] if found else None)]
    return "\n".join([*out, wide])


def next_actions(doc: dict[str, Any]) -> list[str]:
    out = [f"review the failed rule {i['rule']} of {i['task']}" for i in doc["validation"]["issues"]]
    if doc.get("score") and doc["score"]["f1"] < 0.85:
        out.append("the score is under 0.85: adapt strategies or keys and run again")
    if not doc["changed_columns"]:
        out.append("nothing changed: check whether the plan skips what you expect")
    return out or ["download the latest version"]


def column_impact(doc: dict[str, Any], column: str) -> dict[str, Any]:
    """What a report says of one column."""
    return {"column": column, "changes": next((c for c in doc["changed_columns"] if c["column_name"] == column), None),
            "tasks": [t["task_id"] for t in doc["tasks"] if column_references(t, column)], "issues": [i for i in doc["validation"]["issues"] if i["rule"].endswith(f":{column}")]}


def mentioned_columns(question: str, columns: list[str]) -> list[str]:
    """Columns that a question names, longest names first."""
    q = question.lower().replace("_", " ")
    return [c for c in sorted(columns, key=len, reverse=True) if c.lower().replace("_", " ") in q]


def pipeline_diagram(result: RunResult) -> str:
    names = ["ingest", *[t.task_id for t in result.tasks], "report"]
    return "\n".join(["flowchart LR", *[f"  n{i}[{n}]" for i, n in enumerate(names)], *[f"  n{i} --> n{i + 1}" for i in range(len(names) - 1)]])


def lineage_diagram(versions: list[dict[str, Any]]) -> str:
    lines = [f"  v{v['version']}[\"v{v['version']}: {v['agent_name']}\"]" for v in versions]
    return "\n".join(["flowchart TD", *lines, *[f"  v{a['version']} --> v{b['version']}" for a, b in zip(versions, versions[1:], strict=False)]])


def flat_metrics(doc: Any, path: str = "") -> list[str]:
    """path: value lines of a nested document."""
    if isinstance(doc, dict):
        return [x for k, v in doc.items() for x in flat_metrics(v, f"{path}.{k}" if path else str(k))]
    if isinstance(doc, (list, tuple)):
        return [x for i, v in enumerate(doc) for x in flat_metrics(v, f"{path}[{i}]")]
    return [f"{path}: {doc}"]


def to_json(doc: dict[str, Any]) -> str:
    from ..sources.export import json_safe

    return json.dumps(json_safe(doc), indent=2, ensure_ascii=False)


def to_markdown(doc: dict[str, Any]) -> str:
    out = [f"# Cleaning report {doc['session']}", "", doc["plan"]["summary"], "", "| task | passed | rows before | rows after | version |", "| --- | --- | --- | --- | --- |"]
    out += [f"| {t['task_id']} | {t['passed']} | {t['rows_before']} | {t['rows_after']} | {t['version']} |" for t in doc["tasks"]]
    out += ["", "| column | changed cells | rate | nulls before | nulls after |", "| --- | --- | --- | --- | --- |"]
    out += [f"| {c['column_name']} | {c['changed_cells']} | {c['change_rate']} | {c['before_nulls']} | {c['after_nulls']} |" for c in doc["changed_columns"]]
    if doc.get("score"):
        out += ["", "Score: " + ", ".join(f"{k} {v}" for k, v in doc["score"].items())]
    return "\n".join([*out, "", *[f"- {a}" for a in doc["next_actions"]]]) + "\n"


def to_html(doc: dict[str, Any]) -> str:
    return f"<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>{html.escape(doc['session'])}</title></head><body><pre>{html.escape(to_markdown(doc))}</pre></body></html>"
