"""Fuzzy pairs, evidence, plan checks and merges, positions and joins against plain Python."""
import random
from dataclasses import replace
from difflib import SequenceMatcher

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidelake import registry
from tidelake.operators import alike as L
from tidelake.operators import diff as A
from tidelake.operators import fuzzy as Z
from tidelake.operators import joins as J
from tidelake.operators.listing import list_pairs
from tidelake.operators.profile import ROW
from tidelake.plans import queries_dedup as Q
from tidelake.plans.views import d4

SF = "/root/testdata/sf0.001"


def test_typo_evidence(spark):
    df = d4(spark, SF)
    pairs = Z.candidate_pairs(df, Q.SPEC).collect()
    cells = {r[ROW]: r for r in df.collect()}
    norm = lambda v: (v or "").strip().lower()
    want = {}
    for r in pairs:
        a, b = cells[r.row_a], cells[r.row_b]
        x, y = norm(a.phone), norm(b.phone)
        clash = bool(x and y and x != y) and not (len(x) >= 6 and len(y) >= 6 and SequenceMatcher(None, x, y).ratio() >= 0.78)
        kind = "rejected" if clash else "supported" if norm(a.since) and norm(a.since) == norm(b.since) else "review"
        want[kind] = want.get(kind, 0) + 1
    assert {r.resolution: r.n for r in registry.queries()["fuzzy_typo_evidence"](spark, SF).collect()} == want


@pytest.mark.parametrize("keep", ["keep_first", "keep_last", "keep_most_complete"])
def test_merge_equals_a_replay_of_the_pairs(spark, keep):
    for seed in range(3):
        r = random.Random(seed)
        nulls = {i: r.randrange(3) for i in range(40)}
        pairs = sorted({tuple(sorted(r.sample(range(40), 2))) for _ in range(r.choice([25, 90]))})
        gone = set()
        for a, b in pairs:
            if a not in gone and b not in gone:
                gone.add(a if keep == "keep_last" or keep == "keep_most_complete" and nulls[a] > nulls[b] else b)
        rows = [(a, b, nulls[a], nulls[b]) for a, b in pairs]
        r.shuffle(rows)
        got = Z.merge_losers(spark.createDataFrame(rows, "row_a bigint, row_b bigint, na int, nb int"), keep)
        assert sorted(x.loser for x in got.collect()) == sorted(gone)


def _contacts(spark, n=60):
    r = random.Random(8)
    firms, phones = ["Acme Works 1", "Acme Works 2", "Acme Work", "Zed", ""], ["", "555-1234", "555-1235", "99", "98", "777 0000 1"]
    rows = [(i, r.choice(firms), r.choice("xy"), r.choice(phones), r.choice(["", "m", "n"]), r.choice([None, 1])) for i in range(n)]
    return spark.createDataFrame(rows, f"{ROW} bigint, firm string, k string, phone string, mail string, extra int")


PAIRED = Z.Blocking("firm", (Z.BlockKey(("k",)),), threshold=0.5)


@pytest.mark.parametrize("typo", [None, 0.78])
def test_counts_and_chunks_equal_the_pairs(spark, monkeypatch, typo):
    df, proof = _contacts(spark), [Z.Evidence(("mail",), ("phone",), typo=typo)]
    want = {tuple(r) for r in Z.resolve(df, Z.candidate_pairs(df, PAIRED), PAIRED, proof).select("row_a", "row_b", "resolution").collect()}
    monkeypatch.setattr(Z, "CHUNK_ROWS", 3)
    monkeypatch.setattr(Z, "TASK_PAIRS", 100)
    pairs = Z.resolved_pairs(df, PAIRED, proof).collect()
    assert len(pairs) == len(want) and {(r.row_a, r.row_b, r.resolution) for r in pairs} == want
    counts = {}
    for *_, kind in want:
        counts[kind] = counts.get(kind, 0) + 1
    for most in (4096, 2):
        assert {r.resolution: r.n for r in L.resolution_counts(df, PAIRED, proof, table_values=most).collect()} == counts


@pytest.mark.parametrize("proof", [Z.Evidence(("mail", "phone"), ("phone", "mail"), 2, typo=None), Z.Evidence(("mail",), ("phone", "extra"), 0, False, typo=None), Z.Evidence(typo=None)])
def test_counts_of_equal_values_equal_the_pairs(spark, proof):
    df = _contacts(spark, 80)
    df = df.unionByName(df.where(f"{ROW} % 7 = 0").withColumn("mail", F.lit("m"))).unionByName(df.where(f"{ROW} = 3").withColumn(ROW, F.lit(None).cast("bigint")))  # repeated and lacking numbers
    rows = [r.asDict() for r in df.collect()]
    toks = lambda v: {v[i : i + 3] for i in range(max(1, len(v) - 2))} if v else set()
    for r in rows:
        r |= {"toks": toks(r["firm"].lower().replace(" ", "")), **{c: str("" if r[c] is None else r[c]).strip() for c in ("phone", "mail", "extra")}}
    want = {}
    for a in rows:
        for b in rows:
            if None in (a[ROW], b[ROW]) or a[ROW] >= b[ROW] or a["k"] != b["k"] or not a["toks"] | b["toks"] or len(a["toks"] & b["toks"]) / len(a["toks"] | b["toks"]) < 0.5:
                continue
            clash = any(a[c] and b[c] and a[c] != b[c] for c in proof.reject)
            backed = sum(a[c] == b[c] != "" for c in proof.support) >= proof.minimum_support
            kind = "rejected" if clash and proof.hard_reject else "supported" if backed and not clash else "review"
            want[kind] = want.get(kind, 0) + 1
    assert {r.resolution: r.n for r in L.resolution_counts(df, PAIRED, [proof]).collect()} == want


def test_counts_make_no_pairs(spark, crowded, monkeypatch):
    monkeypatch.setattr(Z, "chunk_pairs", lambda *_: pytest.fail("rows are paired"))
    assert sum(r.n for r in registry.queries()["fuzzy_resolution_counts"](spark, crowded).collect()) == 100_200 * 100_199 // 2


def test_rows_are_sent_once_a_chunk_however_many_kinds_are_alike(spark):
    df = spark.createDataFrame([(i, f"Acme Works {i}", "x") for i in range(30)], f"{ROW} bigint, firm string, k string")
    met = Z.met_chunks(df, PAIRED)
    assert met.selectExpr("sum(size(_a) + size(_b))").first()[0] == 60
    assert Z.candidate_pairs(df, PAIRED).count() == 30 * 29 // 2


@pytest.mark.parametrize("typo", [None, 0.78])
def test_listed_pairs_equal_resolved_ones(spark, monkeypatch, typo):
    df, proof = _contacts(spark, 90), [Z.Evidence(("mail", "phone"), ("phone", "mail"), hard_reject=False, typo=typo)]
    rows = {r[ROW]: r for r in df.collect()}
    toks = lambda v: {v[i : i + 3] for i in range(max(1, len(v) - 2))} if v else set()
    firm = {i: toks(r.firm.lower().replace(" ", "")) for i, r in rows.items()}
    score = lambda a, b: len(firm[a] & firm[b]) / len(firm[a] | firm[b]) if firm[a] | firm[b] else 0.0
    want = {(a, b): round(score(a, b), 6) for a in rows for b in rows if a < b and rows[a].k == rows[b].k and score(a, b) >= 0.5}
    told = Z.resolve(df, Z.candidate_pairs(df, PAIRED), PAIRED, proof).drop("score").collect()
    monkeypatch.setattr(Z, "BLOCK_ROWS", 7)
    monkeypatch.setattr(Z, "LISTED_KINDS", 3)
    monkeypatch.setattr(Z, "TASK_PAIRS", 50)
    pairs = Z.candidate_pairs(df, PAIRED, digits=6).collect()
    assert len(pairs) == len(want) and {(r.row_a, r.row_b): r.score for r in pairs} == want
    assert sorted(map(tuple, Z.resolved_pairs(df, PAIRED, proof).drop("score").collect())) == sorted(map(tuple, told))


def test_a_row_of_listed_pairs_is_bounded():
    rows = [{"row": i, "at": i % 2, "v0": "xy"[i % 3 == 0]} for i in range(20)]
    batch = pa.RecordBatch.from_pylist([{"_a": rows, "_b": rows, "_list": [{"a": a, "b": b, "score": float(a == b)} for a in (0, 1) for b in (0, 1)]}])
    found = [r for x in list_pairs([0], [(0, None)], row_pairs=40, batch_pairs=100)([batch]) for r in x.to_pylist()]
    assert all(len(r["a"]) * len(r["b"]) <= 40 for r in found)
    pairs = {(x, y): (r["score"][j], r["flags"][i * len(r["b"]) + j]) for r in found for i, x in enumerate(r["a"]) for j, y in enumerate(r["b"])}
    assert pairs == {(x, y): (float(x % 2 == y % 2), 1 if (x % 3 == 0) == (y % 3 == 0) else 2) for x in range(20) for y in range(20)}


def test_rows_of_listed_pairs_are_small_and_leave_out_earlier_rows():
    rows = [{"row": 3 * i, "at": i % 2} for i in range(200)]
    batch = pa.RecordBatch.from_pylist([{"_a": rows, "_b": rows, "_list": [{"a": a, "b": b, "score": 0.6 + 0.4 * (a == b)} for a in (0, 1) for b in (0, 1)]}])
    found = [r for x in list_pairs([], [], later=True)([batch]) for r in x.to_pylist()]
    assert max(len(r["a"]) * len(r["b"]) for r in found) <= 4096 and sum(len(r["a"]) * len(r["b"]) for r in found) < 0.65 * 200 * 200
    pairs = sorted((x, y, r["score"][j]) for r in found for x in r["a"] for j, y in enumerate(r["b"]) if x < y)
    assert pairs == [(3 * i, 3 * j, 0.6 + 0.4 * (i % 2 == j % 2)) for i in range(200) for j in range(i + 1, 200)]


def test_block_keys_are_worked_out_once_after_the_spreading(spark, monkeypatch):
    seen, write = {}, Z.written
    monkeypatch.setattr(Z, "written", lambda df, name: seen.setdefault(name, df) and write(df, name))
    df = spark.createDataFrame([(0, "Acme", ""), (1, "Acme", "x"), (2, "", None)], f"{ROW} bigint, firm string, k string")
    assert {tuple(r) for r in Z.blocked(df, PAIRED).collect()} == {(0, "acme", "acme"), (1, "x", "acme")}
    assert "Filter" not in seen["block-rows"]._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("keep", ["keep_first", "keep_last", "keep_most_complete"])
def test_merge_without_pairs(spark, keep):
    df, proof = _contacts(spark), [Z.Evidence(("mail",), ("phone",))]
    supported = Z.resolve(df, Z.candidate_pairs(df, PAIRED), PAIRED, proof).where("resolution = 'supported'")
    want = sorted(r[ROW] for r in Z.fuzzy_merge(df, supported, keep).collect())
    for most in (10**6, 12):
        assert sorted(r[ROW] for r in L.merge_alike(df, PAIRED, proof, keep, unit_rows=most).collect()) == want


@pytest.fixture(scope="module")
def crowded(tmp_path_factory):
    """A folder with 100 200 customers of one block, more than the cap that blocks had."""
    keys, folder = pa.array(range(0, 4 * 100_200, 4), pa.int64()), tmp_path_factory.mktemp("crowded")
    n = len(keys)
    pq.write_table(pa.table({"c_custkey": keys, "c_name": ["c"] * n, "c_nationkey": pa.array([1] * n, pa.int32()), "c_acctbal": [0.0] * n, "c_mktsegment": ["FURNITURE"] * n}), f"{folder}/customer.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["fuzzy_pairs_jaccard", "fuzzy_pairs_token", "fuzzy_pairs_weighted", "fuzzy_resolution_counts"])
def test_large_blocks_are_whole(spark, crowded, monkeypatch, name):
    for module, step in ((Z, "candidate_pairs"), (L, "resolution_counts")):
        monkeypatch.setattr(module, step, lambda df, spec, *_, **__: Z.blocked(df, spec))
    assert registry.queries()[name](spark, crowded).count() == 100_200
    assert "<= 100000" not in registry.oracle_sql()[name]


@pytest.mark.parametrize("keep", ["keep_first", "keep_most_complete"])
def test_large_blocks_are_merged_whole(spark, crowded, keep):
    rows = sorted(d4(spark, crowded).select(ROW, "phone", "email", "firm").collect())
    text = {r.firm: "".join(c for c in r.firm.lower() if c.isalnum()) for r in rows}
    toks = {f: {t[i : i + 3] for i in range(len(t) - 2)} for f, t in text.items()}
    alike = {(f, g): len(toks[f] & toks[g]) / len(toks[f] | toks[g]) >= 0.6 for f in toks for g in toks}
    norm, nulls = lambda v: (v or "").strip().lower(), lambda r: (r.phone is None) + (r.email is None)
    units, gone = {}, set()
    for r in rows:
        if norm(r.email):
            units.setdefault(norm(r.email), []).append((r[ROW], norm(r.phone), r.firm, nulls(r)))
    for unit in units.values():
        for i, (a, x, f, na) in enumerate(unit):
            for b, y, g, nb in unit[i + 1 :]:
                if a in gone:
                    break
                if b not in gone and alike[f, g] and not (x and y and x != y):
                    gone.add(a if keep == "keep_most_complete" and na > nb else b)
    name = {"keep_first": "fuzzy_merge_first", "keep_most_complete": "fuzzy_merge"}[keep]
    assert max(gone) > 4 * 100_000
    assert {r[ROW] for r in registry.queries()[name](spark, crowded).select(ROW).collect()} == {r[ROW] for r in rows} - gone
    assert "<= 100000" not in registry.oracle_sql()[name]


@pytest.mark.parametrize("gap, stripe", [(1, 5), (7919, 5), (7919, 4000), (1, 50_000)])
def test_rows_are_numbered_in_their_block(spark, monkeypatch, gap, stripe):
    monkeypatch.setattr(Z, "STRIPE_ROWS", stripe)
    r = random.Random(2)
    rows = [(i * gap if i % 50 else None, "x" if i % 3 else r.choice("yz")) for i in range(9000)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "id bigint, _block string")
    placed = Z.block_places(df, F.col("id"))
    want = {(i, b, k) for x in "xyz" for k, (i, b) in enumerate(sorted(t for t in rows if t[1] == x and t[0] is not None))}
    assert {tuple(t) for t in placed.select("id", "_block", "_place").collect()} == want and placed.count() == len(want)
    assert Z.block_places(df.where("id IS NULL"), F.col("id")).isEmpty()
    held = df.where("id IS NOT NULL").groupBy("_block", Z.stripe_of(df, "id", stripe)).count().agg(F.max("count")).first()[0]
    assert held <= 2 * stripe  # rows of a block that one window numbers


def test_a_plan_without_a_cap_stays_without(spark):
    df = spark.createDataFrame([(i, "Acme Works", "x") for i in range(120)], f"{ROW} bigint, firm string, k string")
    plan = Z.check_plan(df, [replace(PAIRED, max_bucket=None)], [])
    found = Z.candidate_sets(df, plan)[0]
    assert plan.blockings[0].max_bucket is None and (found.rows, found.capped, found.found) == (120, 0, 120 * 119 // 2)


def test_checked_plan(spark):
    df = spark.createDataFrame([(0, "a", "b")], f"{ROW} bigint, firm string, city string")
    plan = Z.check_plan(df, [Z.Blocking("firm", (Z.BlockKey(("city", "x"), "odd"),), threshold=-1, family="address", max_bucket=2, sub_block_columns=("firm", "city"), metric="odd", spec_id="s"), Z.Blocking("city", spec_id="s")],
                        [Z.Evidence(("city", "x"), ("y",), -3, specs=("s", "t"))], ignore=("y",))
    first, second = plan.blockings
    assert (first.threshold, first.max_bucket, first.metric, first.sub_block_columns, first.block_keys[0].columns) == (0.6, 50, "jaccard", ("city",), ("city",))
    assert second.spec_id == "s_1" and plan.evidence[0] == Z.Evidence(("city",), (), 0, specs=("s",)) and len(plan.notes) >= 3
    assert Z.check_plan(df, [], [], families={"firm": "organization"}).blockings[0].target == "firm"


@pytest.mark.parametrize("ids", [range(100), [i * i for i in range(100)], [*range(50), *range(10**12, 10**12 + 50)], [-5, 3, 2**62], []])
def test_positions_of_ids_with_gaps(spark, ids):
    ids = list(ids)
    df = spark.createDataFrame([(i,) for i in ids], f"{ROW} bigint").repartition(5)
    assert {r[ROW]: r._pos for r in J.with_position(df).collect()} == {x: k for k, x in enumerate(sorted(ids))}


def test_samples_are_the_first_changes(spark):
    before = spark.range(9000).select(F.col("id").alias(ROW), F.col("id").alias("a"), F.lit("x").alias("b"))
    after = before.withColumns({"a": F.when(F.col(ROW) % 3000 == 2999, -1).otherwise(F.col("a")), "b": F.when(F.col(ROW) > 4090, "y").otherwise("x")})
    got = {r.column_name: [s._pos for s in r.samples] for r in A.change_samples(before, after, 5).collect()}
    assert got == {"a": [2999, 5999, 8999], "b": [4091, 4092, 4093, 4094, 4095]}


def test_strategy_of_holes(spark):
    dirty = spark.createDataFrame([(i, None if i > 6 else v, "k" if i < 5 else "l") for i, v in enumerate([1, 1, 1, 2, 4, 9, 31, 0, 0])], f"{ROW} bigint, v bigint, k string")
    fill = lambda x: dirty.withColumn("v", F.coalesce("v", F.lit(x).cast("bigint")))
    for x, options, want in ((7, J.FILLS, "fill_mean"), (2, J.FILLS, "fill_median"), (1, J.FILLS, "fill_mode"), (77, J.FILLS, "fill_value"), (7, ("fill_mode",), "fill_value"), (None, J.FILLS, "leave_as_is")):
        r = J.inferred_strategy(dirty, fill(x), "v", options).first()
        assert (r.n_holes, r.strategy, r.value) == (2, want, x)
    assert J.inferred_strategy(fill(0), fill(0), "v").first().strategy == "leave_as_is"
    assert J.inferred_strategy(dirty, fill(7).where(f"{ROW} < 3"), "v").first().strategy == "drop_row"
