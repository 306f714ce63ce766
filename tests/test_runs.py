"""Whole cleaning runs: fuzzy merges, key decisions, post-checks, saved decisions, formats and artifacts; prefix-indexed pairs; merges by component."""
import random

import pytest
from pyspark.sql import functions as F

from tidelake.functions import dates as D
from tidelake.operators import fuzzy as Z
from tidelake.operators.profile import ROW
from tidelake.plans import dedup_task, executor
from tidelake.plans.lineage import LineageStore
from tidelake.plans.specs import CleaningPlan, ColumnSpec, Task


def firms(spark):
    rows = [(0, "Acme Hospital Group", "Hue", "10"), (1, "Acme Hospitals Group", "Hue", "10"), (2, "Acme Hospital Grop", "Hue", "11"), (3, "Beta Clinic", "Hue", "12"), (4, "Beta Clinic", "Hue", None),
            (5, "Gamma Works", "Hanoi", "13"), (6, "Gamma Works", "Hanoi", "13")]
    return spark.createDataFrame(rows, f"{ROW} bigint, company string, city string, tax string")


FUZZY = {"enabled": True, "blockings": [{"target": "company", "block_keys": [{"columns": ["city"], "transform": "exact_normalized"}], "threshold": 0.5, "family": "organization", "spec_id": "c", "odd": 1}],
         "evidence": [{"support": ["city"], "reject": ["tax"], "minimum_support": 1}]}


def test_a_run_merges_fuzzy_pairs_and_checks_itself(spark, tmp_path):
    store = LineageStore(spark, str(tmp_path / "s"))
    plan = CleaningPlan([Task("deduplication", {"keep": "keep_first", "fuzzy_matching": FUZZY})])
    result = executor.run(plan, firms(spark), store, "s", artifacts=(str(tmp_path / "out"), str(tmp_path / "other")))
    assert sorted(r[ROW] for r in result.df.collect()) == [0, 2, 3, 5]  # 6 repeats 5, 1 is 0, 4 is 3; 2 has another tax number
    notes = result.tasks[0].notes
    assert "pairs of" in notes["fuzzy_c"] and notes["keys"] == "full rows" and notes["next_action"] == "continue"
    assert spark.read.parquet(result.artifacts["deduplication"]).count() == 4 and result.artifacts["deduplication"].endswith("s_deduplicated.parquet")
    off = executor.run(CleaningPlan([Task("deduplication", {"keep": "keep_first", "fuzzy_matching": FUZZY | {"enabled": False}})]), firms(spark), store, "t")
    assert off.df.count() == 6


@pytest.mark.parametrize("strategy, keys", [
    ({"keys": ["tax"]}, []), ({"keys": ["city", "company"]}, ["city", "company"]), ({"keys": ["nope"], "columns": ["company", "city"]}, ["company", "city"]),
    ({"keys": ["company_name"]}, []), ({"keys": ["city", "tax"], "ignored_columns": ["tax"]}, ["city"]), ({"infer_keys": True, "columns": ["city", "company"]}, ["city", "company"]), ({}, [])])
def test_decisions_fall_back(spark, strategy, keys):
    """An identifier or a name alone, a weak key and missing columns can't serve."""
    df = firms(spark).withColumn("company_name", F.col("company"))
    specs = {"tax": ColumnSpec("str", "Identifier")}
    decision, saved = dedup_task.decide(df, Task("deduplication", strategy), specs)
    assert decision.keys == keys
    again, same = dedup_task.decide(df, Task("deduplication", strategy), specs, saved)
    assert again == decision and same is saved
    assert dedup_task.decide(df.limit(3), Task("deduplication", strategy), specs, saved)[1] is not saved


def test_a_run_takes_decisions_again(spark, tmp_path):
    store = LineageStore(spark, str(tmp_path / "s"))
    plan = CleaningPlan([Task("deduplication", {"keys": ["city", "company"]})])
    first = executor.run(plan, firms(spark), store, "a")
    second = executor.run(plan, firms(spark), store, "b", decisions=first.decisions)
    assert first.decisions == second.decisions and first.decisions["deduplication"]["decision"]["keys"] == ["city", "company"]
    assert second.df.count() == 5


def test_a_failed_check_asks_for_a_new_plan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dedup_task.E, "run", lambda df, decision, order=ROW: df)
    result = executor.run(CleaningPlan([Task("deduplication", {"keys": ["city", "company"]})]), firms(spark), LineageStore(spark, str(tmp_path / "s")), "s")
    assert result.needs_replan and {"residual_full_row_duplicates", "residual_key_duplicates"} <= set(result.tasks[0].failed_rules)


def test_dates_are_written_as_they_were(spark, tmp_path):
    rows = [(0, None, "2024/01/02 03:04", "x"), (1, "31/12/2023", "2024/02/03 04:05", "y"), (2, "01/02/2024", "junk", "z")]
    df = spark.createDataFrame(rows, f"{ROW} bigint, day string, at string, v string")
    plan = CleaningPlan([Task("type_casting", {"day": "date", "at": "datetime"})])
    store = LineageStore(spark, str(tmp_path / "s"))
    result = executor.run(plan, df, store, "s", keep_formats=True)
    assert result.formats == {"day": "%d/%m/%Y", "at": "%Y/%m/%d %H:%M"}
    got = {r[ROW]: (r.day, r.at) for r in result.df.collect()}
    assert got[0] == (None, "2024/01/02 03:04") and got[1] == ("31/12/2023", "2024/02/03 04:05") and got[2][1] is None
    assert store.latest_number("s") == 3 and dict(store.read("s", 2).dtypes)["day"] == "date"
    assert executor.metrics(result)["by_task"]["type_casting"]["rows_after"] == 3


@pytest.mark.parametrize("text, form", [
    ("04/04/2024", "%d/%m/%Y"), ("03/04/2024", "%m/%d/%Y"), ("31/12/2024", "%d/%m/%Y"), ("12/31/2024", "%m/%d/%Y"), ("05-05-2024 01:02", "%d-%m-%Y %H:%M"), ("2024-01-02", "%Y-%m-%d"),
    ("June 01, 2024", "%B %d, %Y"), ("June 1, 2024", None), ("x", None)])
def test_formats_are_guessed_day_first(text, form):
    assert D.format_of(text) == form


@pytest.mark.parametrize("metric, strategy", [("jaccard", "ngram"), ("weighted_jaccard", "token"), ("jaccard", "token")])
@pytest.mark.parametrize("threshold", [0.0, 0.34, 0.6, 1.0])
def test_prefix_pairs_lose_none_and_try_few(spark, metric, strategy, threshold):
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(1, 7))) for _ in range(70)] + ["w1 w1 w2", "w1 w2 w2", "", "w1 w1 w2"]
    df = spark.createDataFrame([(i, t, "b" if i % 3 else "c") for i, t in enumerate(texts)], f"{ROW} bigint, t string, k string")
    spec = Z.Blocking("t", (Z.BlockKey(("k",), "exact_normalized"),), strategy, metric, threshold, max_bucket=1000, ascii_only=True)
    kinds = Z.kinds_of(Z.blocked(df, spec), spec)
    own = {(x._block, x._text): list(x._tokens) for x in kinds.collect()}

    def score(a, b):
        if not a or not b:
            return 0.0
        if metric == "jaccard":
            return len(set(a) & set(b)) / len(set(a) | set(b))
        every = set(a) | set(b)
        return sum(min(a.count(x), b.count(x)) for x in every) / sum(max(a.count(x), b.count(x)) for x in every)

    rows = {x[ROW]: (x._block, x._text) for x in Z.blocked(df, spec).collect()}
    want = {(i, j): round(s, 9) for i in rows for j in rows if i < j and rows[i][0] == rows[j][0] and (s := score(own[rows[i]], own[rows[j]])) >= threshold}
    assert {(x.row_a, x.row_b): round(x.score, 9) for x in Z.candidate_pairs(df, spec).collect()} == want
    if threshold >= 0.6:
        every = kinds.groupBy("_block").count().selectExpr("sum(count * (count - 1) / 2)").first()[0]
        assert Z.prefix_pairs(kinds, threshold).count() < every / 4


@pytest.mark.parametrize("replay", [0, 10, 10**6])
def test_merges_by_component_and_in_rounds(spark, replay):
    r = random.Random(replay)
    nulls = {i: r.randrange(3) for i in range(30)}
    pairs = sorted({tuple(sorted(r.sample(range(30), 2))) for _ in range(28)})
    gone = set()
    for a, b in pairs:
        if a not in gone and b not in gone:
            gone.add(a if nulls[a] > nulls[b] else b)
    df = spark.createDataFrame([(a, b, nulls[a], nulls[b]) for a, b in pairs], "row_a bigint, row_b bigint, na int, nb int")
    assert sorted(x.loser for x in Z.merge_losers(df, "keep_most_complete", replay).collect()) == sorted(gone)


def test_a_long_chain_takes_few_rounds(spark):
    chain, told = spark.range(10_000).selectExpr("id AS row_a", "id + 1 AS row_b", "0 AS na", "0 AS nb"), []
    got = Z.merge_losers(chain, "keep_first", told=told)
    assert sorted(x.loser for x in got.collect()) == list(range(1, 10_001, 2)) and told[0] <= 20


def test_writers_at_once_get_versions_of_their_own(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    store = LineageStore(spark, str(tmp_path / "s"))
    with ThreadPoolExecutor(4) as pool:
        made = list(pool.map(lambda i: (i, store.append("a", spark.range(i + 1).withColumnRenamed("id", ROW), f"w{i}")), range(4)))
    assert sorted(n for _, n in made) == [1, 2, 3, 4]
    assert all(store.read("a", n).count() == i + 1 for i, n in made)
    with pytest.raises(Exception):
        store.append("a", spark.range(1).select(F.raise_error(F.lit("no")).alias(ROW)), "w")
    assert store.latest_number("a") == 4 and len(list((tmp_path / "s" / "data" / "a").iterdir())) == 4
    assert [store._claimed("b", 1) for _ in range(2)] == [True, False]
