"""Readers, writers, versions, the SQL guard and an end-to-end run."""
import json

import pytest
from pyspark.sql import functions as F

from tidelake.operators.profile import ROW
from tidelake.plans import autoplan, chat, executor, guardrails, report, sql_console
from tidelake.operators import cast
from tidelake.plans.lineage import LineageStore, reorder, session_id, source_order
from tidelake.plans.specs import CleaningPlan, ColumnSpec, Task, context_hash
from tidelake.sources import export, readers


def rows(df):
    return [tuple(r)[:] for r in df.orderBy(ROW).drop(ROW).collect()]


def test_csv_with_bom_semicolons_and_repeated_headers(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes("﻿a;a;b.c\n1;N/A;\"x;\ny\"\n2;é;NaN\n".encode())
    df = readers.ingest(spark, str(p))
    assert [c for c in df.columns if c != ROW] == ["a", "a.1", "b.c"]
    assert rows(df) == [("1", None, "x;\ny"), ("2", "é", None)]


def test_tab_and_windows_encoding(spark, tmp_path):
    p = tmp_path / "a.tsv"
    p.write_bytes("n\tv\n1\tcafé\n2\tthé\n".encode("cp1252"))
    assert rows(readers.ingest(spark, str(p))) == [("1", "café"), ("2", "thé")]


def test_json_forms(spark, tmp_path):
    a, b = tmp_path / "a.json", tmp_path / "b.jsonl"
    a.write_text(json.dumps([{"x": 1, "o": {"k": 2}}, {"x": None, "o": None}]))
    b.write_text('{"x": 1}\n{"x": 2}\n')
    got = {r["x"]: r["o"] for r in readers.ingest(spark, str(a)).collect()}
    assert got == {"1": '{"k":"2"}', None: None}
    assert readers.read_json(spark, str(a), flatten=True).columns == ["o.k", "x"]
    assert rows(readers.ingest(spark, str(b))) == [("1",), ("2",)]


def test_excel_round_trip(spark, tmp_path):
    p = str(tmp_path / "a.xlsx")
    df = spark.createDataFrame([(0, "a<b", 1.5), (1, None, 2.0)], f"{ROW} bigint, s string, x double")
    export.download(df, p, "xlsx")
    assert rows(readers.ingest(spark, p)) == [("a<b", "1.5"), (None, "2.0")]


def test_downloads(spark, tmp_path):
    df = spark.createDataFrame([(1, "b"), (0, "a")], f"{ROW} bigint, s string")
    c = export.download(df, str(tmp_path / "o.csv"), "csv")
    assert open(c, "rb").read() == "﻿s\r\na\r\nb\r\n".encode()
    j = export.download(df, str(tmp_path / "o.json"), "json")
    assert json.load(open(j)) == [{"s": "a"}, {"s": "b"}]
    with pytest.raises(ValueError):
        export.download(df, "x", "odt")
    assert export.preview_rows(df, 1) == {"columns": ["s"], "rows": [{"s": "a"}], "total_rows": 2, "shown": 1}


def test_large_tables_are_written_as_folders(spark, tmp_path):
    df = spark.range(50).select((49 - F.col("id")).alias(ROW), F.col("id").alias("v")).repartition(4)
    with pytest.raises(ValueError):
        export.download(df, str(tmp_path / "x.csv"), "csv", most_rows=49)
    export.write_ordered(df, str(tmp_path / "o"), "json")
    lines = [json.loads(x)["v"] for f in sorted((tmp_path / "o").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines == list(range(49, -1, -1))


def test_bad_inputs(spark, tmp_path):
    with pytest.raises(ValueError):
        readers.detect_format("a.docx")
    with pytest.raises(ValueError):
        readers.check_upload("a.csv", 101 * 1024 * 1024)
    p = tmp_path / "e.csv"
    p.write_text("a,b\n")
    with pytest.raises(ValueError):
        readers.ingest(spark, str(p))


def test_versions_and_views(spark, tmp_path):
    store = LineageStore(spark, str(tmp_path / "s"))
    df = spark.range(5).select(F.col("id").alias(ROW), (F.col("id") * 2).alias("v"))
    assert store.append("s", df, "ingest") == 1 and store.append("s", df.where("v > 2"), "x") == 2
    assert store.read("s").count() == 3 and store.read("s", 1).count() == 5
    with pytest.raises(KeyError):
        store.read("s", 9)
    assert set(store.register_views("s")) == {"v1", "v2", "raw_data", "clean_data", "dataset"}
    assert sql_console.answer(spark, "SELECT count(*) AS n FROM dataset").splitlines()[-1] == "| 3 |"
    assert reorder(df, ["v"]).columns == ["v", ROW]
    assert session_id("nope", None, "/x/12345678123456781234567812345678.csv") == "12345678-1234-5678-1234-567812345678"


@pytest.mark.parametrize("bad", ["DROP TABLE x", "SELECT 1; SELECT 2", "SELECT * FROM parquet.`/etc`", "", "INSERT INTO t SELECT 1", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "SELECT try_reflect('java.lang.System', 'exit', 1)",
    "SELECT `reflect` ('java.lang.Math', 'abs', 1)", "SELECT * FROM org.x.`hdfs://a/b`", "SELECT * FROM tidelake_excel.`a.xlsx`", "FROM t INSERT INTO u SELECT *", "SELECT 1 /* x */ ; DROP TABLE y"])
def test_sql_guard(spark, bad):
    with pytest.raises(sql_console.QueryRefused):
        sql_console.run(spark, bad)


def test_plan_documents():
    plan = CleaningPlan([Task("null_handling", {"a": "fill_mean"}), Task("deduplication")])
    assert [t.task_id for t in plan.active()] == ["deduplication", "null_handling"]
    assert CleaningPlan.from_json("note: " + plan.to_json()).active() == plan.active()
    assert CleaningPlan.from_json("junk").active() == []
    assert context_hash({"a": 1, "b": 2}) == context_hash({"b": 2, "a": 1})


def test_guardrails():
    specs = {"a": ColumnSpec("str", "Nominal", expected_pattern=r"\d+", disguised_values=["0"])}
    plan = CleaningPlan([Task("null_handling", {"a": {"strategy": "fill_mean"}})])
    assert guardrails.review_null_plan(plan, specs)[0]["options"] == ["fill_mode", "fill_value", "leave_as_is"]
    again = guardrails.override_null_plan(plan, {"a": {"strategy": "fill_value", "fill_value": "x"}})
    assert guardrails.review_null_plan(again, specs)[0]["may_keep"]
    with pytest.raises(ValueError):
        guardrails.override_null_plan(plan, {"a": "fill_llm"})
    assert guardrails.strategy_options(ColumnSpec("int", "Identifier", allow_missing=False), 0.1) == ["drop_row"]
    assert guardrails.recommended(ColumnSpec("float", "Continuous"), 0.1, skew=0.2) == "fill_mean"
    assert guardrails.column_family("customer_email") == "email"


def test_end_to_end(spark, tmp_path):
    raw = [(i, f"{i % 40}", None if i % 5 == 0 else f"{i % 9}.5", "Yes" if i % 2 else "No") for i in range(200)]
    raw += [(200 + i, *raw[i][1:]) for i in range(20)]
    df = spark.createDataFrame(raw, f"{ROW} bigint, grp string, score string, flag string")
    specs = autoplan.infer_specs(df)
    assert specs["flag"].expected_type == "bool" and specs["score"].expected_type == "float"
    plan = autoplan.plan(df, specs)
    store = LineageStore(spark, str(tmp_path / "s"))
    result = executor.run(plan, df, store, "s", specs)
    assert not result.needs_replan and [t.task_id for t in result.tasks] == ["deduplication", "type_casting", "null_handling"]
    assert result.df.where("score IS NULL").count() == 0 and dict(result.df.dtypes)["flag"] == "boolean"
    doc = report.build(plan, result, store, "s", align="row_index")
    assert doc["validation"]["passed"] and json.loads(report.to_json(doc))["session"] == "s"
    assert "| deduplication |" in report.to_markdown(doc) and "flowchart" in report.pipeline_diagram(result)
    assert [x["task"] for x in doc["actions"]] and all(x["changed_cells"] > 0 for x in doc["step_changes"])
    assert "rows were removed" in chat.answer(doc, "How many rows were removed? And which version is last?")
    chat.save_message(spark, str(tmp_path), "r", "user", "hi")
    assert chat.messages(spark, str(tmp_path), "r").count() == 1
    assert report.flat_metrics({"a": {"b": [1]}}) == ["a.b[0]: 1"]


def test_failed_rules_ask_for_a_new_plan(spark, tmp_path):
    df = spark.createDataFrame([(0, None), (1, "a")], f"{ROW} bigint, v string")
    plan = CleaningPlan([Task("null_handling", {"v": "drop_row"}, must_preserve_row_count=True)], max_retries=2)
    store = LineageStore(spark, str(tmp_path / "s"))
    result = executor.run(plan, df, store, "s")
    assert result.needs_replan and result.tasks[0].failed_rules == ["row_count_not_preserved"] and result.tasks[0].attempts == 1
    assert store.latest_number("s") == 1


def test_the_guard_lets_reading_queries_through(spark):
    spark.range(3).selectExpr("id", "id AS `set`", "'drop; insert' AS s").createOrReplaceTempView("t")
    assert sql_console.run(spark, "SELECT replace(s, 'drop', 'x') AS r, t.`set` FROM t WHERE id = 1 -- insert").first().r == "x; insert"


def test_a_failing_column_fails_its_cast_only(spark, tmp_path, monkeypatch):
    plain = cast.cast_column
    monkeypatch.setattr(cast, "cast_column", lambda df, name, kind: F.col("no such column") if name == "b" else plain(df, name, kind))
    df = spark.createDataFrame([(0, "1", [1]), (1, "x", [2])], f"{ROW} bigint, a string, b array<int>")
    out, failed = cast.cast_checked(df, {"a": "int", "b": "int", "c": "int", "a2": "odd"})
    assert dict(out.dtypes)["a"] == "bigint" and dict(out.dtypes)["b"] == "array<int>" and set(failed) == {"missing_column:c", "missing_column:a2", "cast_failed:b"}
    assert cast.cast_plan({"per_column": {"a": {"expected_type": "integer"}, "b": {"expected_type": "odd"}}}) == {"a": "int"}
    assert cast.cast_plan({}, ["a", "z"], {"a": "float"}) == {"a": "float"}
    store = LineageStore(spark, str(tmp_path / "s"))
    result = executor.run(CleaningPlan([Task("type_casting", {"a": "int", "c": "int"})]), df, store, "s")
    assert not result.needs_replan and result.tasks[0].attempts == 2 and result.tasks[0].notes["left_as_they_are"] == "c"
    broken = executor.run(CleaningPlan([Task("odd task")], max_retries=2), df, store, "s")
    assert broken.needs_replan and broken.tasks[0].failed_rules == ["error:ValueError"]


def test_decisions_and_reviews():
    task = Task("deduplication", {"primary_keys": ["a", "b", "a"], "ignored_columns": ["b"], "keep": "keep_last"})
    decision = executor.planned_decision(task)
    assert decision.keys == ["a"] and decision.keep == "keep_last"
    saved = executor.saved_decision({"x": 1}, decision)
    assert executor.reused_decision({"x": 1}, saved) == decision and executor.reused_decision({"x": 2}, saved) is None
    fields = {f["field"]: f["value"] for f in guardrails.review_dedup_plan(CleaningPlan([task]))}
    assert fields["mode"] == "exact_key" and fields["key_columns"] == ["a", "b", "a"] and fields["fuzzy_enabled"] is False
    assert [t.skip for t in CleaningPlan.fallback("x").tasks] == [True] * 3
    spec = ColumnSpec("int", "Discrete", allow_missing=False, expected_pattern=r"\d+", disguised_values=["0"])
    assert guardrails.offered(["keep_null", "fill_mode", "custom prompt", "fill_mean"], spec, "str") == ["fill_mode"]
    assert len(guardrails.constant_problems("c", {"strategy": "fill_value", "fill_value": "0"}, spec)) == 1
    assert guardrails.constant_problems("c", {"strategy": "fill_value"}, spec) and not guardrails.constant_problems("c", {"strategy": "fill_mode"}, spec)


def test_artifacts_and_column_order(spark, tmp_path):
    df = spark.range(2)
    (tmp_path / "file").write_text("x")
    made = executor.write_artifact(df, str(tmp_path / "file"), str(tmp_path / "other"), "s", Task("deduplication"))
    assert made.endswith("other/s_deduplicated.parquet") and spark.read.parquet(made).count() == 2
    (tmp_path / "h.csv").write_text("z,y,x\n1,2,3\n")
    order = source_order(spark, str(tmp_path / "h.csv"))
    assert order == ["z", "y", "x"] and reorder(spark.range(1).selectExpr("1 AS x", "2 AS w", "3 AS z"), order).columns == ["z", "x", "w"]


def test_report_answers(spark):
    doc = {"changed_columns": [], "versions": [{"version": 1, "agent_name": "ingest"}], "validation": {"passed": True, "issues": [], "issue_count": 0}, "tasks": [{"task_id": "deduplication", "rows_before": 4, "rows_after": 3, "passed": True, "attempts": 1}],
           "plan": {"summary": "s", "active": ["deduplication"], "skipped": {}}, "metrics": {"rows_removed": 1, "seconds": 2.0}, "next_actions": ["x"], "n_columns": 5}
    assert report.cell_count(doc) == 15 and report.cell_count(doc | {"score": {"cells": 7}}) == 7
    assert len(report.suggested_questions(doc)) == 3 and report.contexts(doc)["changes"] is False
    for asked, said in (("How many cells?", "15 cells"), ("How many columns are there?", "5 columns"), ("Did it pass, is it approved?", "passed"), ("Any retries?", "deduplication 1"), ("Walk me through", "ingest >"), ("Why?", "s."), ("Can I download it?", "CSV"), ("sing", "isn't in this run")):
        assert said in chat.answer(doc, asked)
    text = report.console_profile("f.csv", {"total_rows": 3, "duplicate_rows": 0}, [{"column_name": "a", "null_rate": 0.5, "null_count": 1, "total_rows": 3, "unique_count": 2, "unique_ratio": 1.0, "unique_category": "primary_key"}], samples={"a": [1, 2, 3]}, most=2)
    assert "primary_key   : a" in text and "and 1 more" in text and "1 / 3" in text


def test_answers_of_several_parts():
    doc = {"changed_columns": [{"column_name": "price", "changed_cells": 3, "change_rate": 0.5, "before_nulls": 3, "after_nulls": 0}], "versions": [], "validation": {"passed": True, "issues": [], "issue_count": 0},
           "tasks": [{"task_id": "null_handling", "rows_before": 6, "rows_after": 6, "passed": True, "attempts": 1}], "plan": {"summary": "s", "active": ["null_handling"], "skipped": {}}, "metrics": {"tokens": {"input": 1200, "output": 30}, "rows_removed": 0},
           "actions": [{"task": "null_handling", "column": "price", "action": "fill_median"}], "step_changes": [{"version": 2, "agent_name": "null_handling", "column_name": "price", "changed_cells": 3}], "n_columns": 2, "next_actions": ["x"]}
    got = chat.composed(doc, "How many tokens were used, which columns changed most, and which transformations were applied? What is the weather")
    assert got["facts"]["tokens"] == ["Tokens used: input 1,200, output 30."] and got["facts"]["actions"] == ["Done: null_handling price: fill_median."] and got["facts"]["changes"] == ["Most changed: price (3)."]
    assert got["answer"].count("\n- ") == 2 and got["sources"] == ["actions", "changed_columns", "metrics"] and got["unanswered"] == ["What is the weather"]
    assert "Changed by null_handling (v2, 3 cells)." in chat.answer(doc, "What happened to price?")
    assert "no tokens" in chat.answer(doc | {"metrics": {}}, "What did it cost?") and "No step" in chat.answer(doc | {"actions": []}, "Which transformations were applied?")
    assert chat.composed(doc, "sing")["answer"].startswith("That isn't")
