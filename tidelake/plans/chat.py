"""Questions about a run, answered from its report by keywords; messages are kept in an append-only table."""
from __future__ import annotations

import re
import uuid
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGES = "id string, run_id string, role string, content string, sources array<string>, created_at string"
#: Words that tell an intent, in order.
INTENTS = (
    ("tokens", ("token", "cost")), ("actions", ("pipeline action", "actions were", "transformation", "was done", "were applied", "which step")), ("contexts", ("what can i ask", "what can you", "which data do you")), ("cells", ("cell",)), ("columns", ("how many column", "number of columns", "column count")),
    ("changes", ("changed most", "top change", "changed column", "what changed", "difference")), ("score", ("f1", "precision", "recall", "accuracy", "score")),
    ("failures", ("fail", "error", "issue", "violation")), ("approval", ("passed", "approved", "valid")), ("versions", ("version", "lineage", "history")), ("rows", ("row", "removed", "duplicate")),
    ("time", ("long", "second", "time", "duration")), ("retries", ("retry", "retries", "attempt")), ("trace", ("trace", "pipeline", "flow", "walk me")), ("workers", ("worker", "each step", "each task")),
    ("decisions", ("why", "decision", "decide", "rationale")), ("plan", ("plan", "task", "step", "skip")), ("exports", ("export", "download", "file")), ("next", ("next", "should i", "recommend", "action")))


def split_questions(text: str) -> list[str]:
    return [p.strip() for p in re.split(r"[?;\n]+|\band also\b", text) if p.strip()]


def intents(question: str) -> list[str]:
    q = question.lower()
    return [name for name, words in INTENTS if any(w in q for w in words)]


#: The part of a report that an intent is answered from.
SOURCES = {"column": "changed_columns", "changes": "changed_columns", "score": "score", "failures": "validation", "approval": "validation", "versions": "versions", "rows": "metrics", "time": "metrics", "plan": "plan",
           "decisions": "plan", "tokens": "metrics", "actions": "actions", "cells": "tasks", "columns": "n_columns", "retries": "tasks", "trace": "tasks", "workers": "tasks", "next": "next_actions"}


def told(doc: dict[str, Any], text: str) -> list[tuple[str, str]]:
    """(intent, sentence) for each intent of each question, none twice."""
    from .report import cell_count, column_impact, contexts, mentioned_columns

    said: list[tuple[str, str]] = []
    intent = "column"
    say = lambda sentence: said.append((intent, sentence))
    columns = [c["column_name"] for c in doc["changed_columns"]]
    for question in split_questions(text):
        intent = "column"
        for c in mentioned_columns(question, columns):
            got = column_impact(doc, c)["changes"]
            say(f"{c}: {got['changed_cells']} cells changed ({got['change_rate']:.2%}), nulls {got['before_nulls']} to {got['after_nulls']}." + _by_steps(doc, c))
        for intent in intents(question):
            if intent == "tokens":
                used = doc["metrics"].get("tokens") or {}
                say("Tokens used: " + ", ".join(f"{k} {v:,}" for k, v in used.items()) + "." if any(used.values()) else "No model was called, so no tokens were used.")
            elif intent == "actions":
                done = doc.get("actions") or []
                say("Done: " + "; ".join(f"{x['task']}{' ' + x['column'] if x['column'] else ''}: {x['action']}" for x in done) + "." if done else "No step changed the data.")
            elif intent == "changes":
                say("Most changed: " + (", ".join(f"{c['column_name']} ({c['changed_cells']})" for c in doc["changed_columns"][:10]) or "nothing") + ".")
            elif intent == "score":
                say("Score: " + ", ".join(f"{k} {v}" for k, v in doc["score"].items()) + "." if doc.get("score") else "There was no ground truth to score against.")
            elif intent == "failures":
                say("Failed rules: " + (", ".join(f"{i['task']} {i['rule']}" for i in doc["validation"]["issues"]) or "none") + ".")
            elif intent == "versions":
                say("Versions: " + ", ".join(f"v{v['version']} by {v['agent_name']}" for v in doc["versions"]) + ".")
            elif intent == "rows":
                say(f"{doc['metrics']['rows_removed']} rows were removed.")
            elif intent == "time":
                say(f"The tasks took {doc['metrics']['seconds']} seconds.")
            elif intent == "plan":
                say("Tasks run: " + (", ".join(doc["plan"]["active"]) or "none") + ".")
            elif intent == "contexts":
                held = contexts(doc)
                say("I can tell of " + ", ".join(k for k, v in held.items() if v) + "." + (f" Not in this run: {', '.join(k for k, v in held.items() if not v)}." if not all(held.values()) else ""))
            elif intent == "cells":
                n = cell_count(doc)
                say(f"{n:,} cells are followed." if n is not None else "The cells weren't counted.")
            elif intent == "columns":
                say(f"There are {doc.get('n_columns', 0)} columns.")
            elif intent == "approval":
                say("All checks passed." if doc["validation"]["passed"] else f"{doc['validation']['issue_count']} checks failed.")
            elif intent == "retries":
                say("Attempts: " + (", ".join(f"{t['task_id']} {t['attempts']}" for t in doc["tasks"]) or "none") + ".")
            elif intent == "trace":
                say("The run went " + " > ".join(["ingest", *[t["task_id"] for t in doc["tasks"]], "report"]) + ".")
            elif intent == "workers":
                say("; ".join(f"{t['task_id']}: {t['rows_before']} to {t['rows_after']} rows, {'passed' if t['passed'] else 'failed'}" for t in doc["tasks"]) + ".")
            elif intent == "decisions":
                say((doc["plan"]["summary"] or "The plan gives no reason") + "." + "".join(f" {k} was skipped: {v}." for k, v in doc["plan"]["skipped"].items()))
            elif intent == "exports":
                say("The report can be had as JSON, Markdown or HTML, any version as CSV, JSON, Excel or Parquet.")
            elif intent == "next":
                say("Next: " + "; ".join(doc["next_actions"]) + ".")
    return list(dict.fromkeys(said))


def _by_steps(doc: dict[str, Any], column: str) -> str:
    by = [x for x in doc.get("step_changes") or [] if x["column_name"] == column and x["changed_cells"]]
    return (" Changed by " + ", ".join(f"{x['agent_name']} (v{x['version']}, {x['changed_cells']} cells)" for x in by) + ".") if by else ""


def answer(doc: dict[str, Any], text: str) -> str:
    return " ".join(sentence for _, sentence in told(doc, text)) or "That isn't in this run's report; ask about changes, scores, failures, versions, rows, time or the plan."


def composed(doc: dict[str, Any], text: str) -> dict[str, Any]:
    """The answer to a question of several parts: the text (a list if two facts or more are asked for), its facts by intent, the report's parts
    that hold them, and what was asked that the report doesn't answer."""
    facts = told(doc, text)
    unknown = [q for q in split_questions(text) if not told(doc, q)]
    lines = "\n".join(f"- {sentence}" for _, sentence in facts) if len(facts) > 1 else answer(doc, text)
    return {"answer": lines, "facts": {i: [x for k, x in facts if k == i] for i, _ in facts}, "sources": sorted({SOURCES[i] for i, _ in facts if i in SOURCES}), "unanswered": unknown}


def save_message(spark: SparkSession, root: str, run_id: str, role: str, content: str, sources: list[str] | None = None) -> None:
    row = [(uuid.uuid4().hex, run_id, role, content, sources or [], datetime.now(UTC).isoformat())]
    spark.createDataFrame(row, MESSAGES).coalesce(1).write.mode("append").json(f"{root.rstrip('/')}/chat")


def messages(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    return spark.read.schema(MESSAGES).json(f"{root.rstrip('/')}/chat").where(F.col("run_id") == run_id).orderBy("created_at")
