"""Best-fit packing, conversation repair and periodic runs against brute force, on test tables, edge cases and random input."""
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import brute as B
from tests.llm.test_contracts import SF, edge, empty, rows  # noqa: F401
from tidelake.llm import common, packing, registry, repair, runs

WORDS = registry.vocabulary("word_bpe_49k.json")


# --- packing

def least_bins(items, capacity):
    """By exhaustive search."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for room in set(rooms):
            if room >= items[i]:
                left = list(rooms)
                left.remove(room)
                go(i + 1, [*left, room - items[i]])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best[0]


def best_fit_of(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= x]
        if fit:
            rooms.remove(min(fit))
        rooms.append((min(fit) if fit else capacity) - x)
    return len(rooms)


@settings(max_examples=150, deadline=None)
@given(st.sampled_from([10, 17, 30]), st.lists(st.integers(1, 30), max_size=9))
def test_the_reduction_keeps_the_least_number_of_sequences(capacity, items):
    items = [min(x, capacity) for x in items]
    counts = np.bincount(items, minlength=capacity + 1)
    fixed, rest = packing.reduce_instance(counts, capacity)
    assert all(sum(x * k for x, k in content) <= capacity for _, content in fixed)
    left = [x for x in range(capacity + 1) for _ in range(rest[x])]
    assert sum(t for t, _ in fixed) + least_bins(left, capacity) == least_bins(items, capacity)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_grouped_best_fit_is_best_fit(items):
    made = packing.best_fit(np.bincount(items, minlength=41), 40)
    assert sum(t for t, _ in made) == best_fit_of(items, 40)
    assert sorted(items) == sorted(x for t, c in made for x, k in c for _ in range(t * k))


def test_the_plan_does_not_grow_with_the_corpus():
    r = np.random.default_rng(1)
    counts = np.bincount(np.minimum(r.zipf(1.3, 30_000), 4096), minlength=4097)
    small, large = packing.plan(counts, 4096), packing.plan(counts * 1_000_000, 4096)
    assert len(large[0]) < 4 * len(small[0]) and large[1] <= 1_000_000 * small[1]
    assert large[1] >= -(-int((counts * np.arange(4097)).sum()) * 1_000_000 // 4096)


def packed_right(got, capacity=4096):
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


@pytest.mark.parametrize("which", ["edge", "small"])
def test_op11(spark, edge, which):  # noqa: F811
    sf = edge if which == "edge" else SF
    got = registry.op11_best_fit_packing(spark, sf).collect()
    assert B.counted([tuple(r)[:5] for r in got]) == B.counted(B.op11_pieces(rows(spark, sf, "documents", ["doc_id", "text"])))
    assert packed_right(got) <= best_fit_of([r.length for r in got], 4096)


def test_packed_sequences_hold_the_pieces_and_long_texts_are_cut(spark):
    texts = [(1, "a b c"), (2, None), (2, None), (None, "x " * 60), (3, ""), (4, "one two three four five six seven")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    pieces = packing.token_pieces(docs, WORDS, 16)
    assert B.counted([tuple(r) for r in pieces.selectExpr("doc_id", "piece", "start", "length", "crc32(token_ids)").collect()]) == B.counted(B.op11_pieces(texts, 16))
    placed = packing.pack(pieces.withColumn("_part", pieces.piece), 16)  # a name that pack uses
    held = {r.sequence_id: bytes(r.token_ids) for r in packing.sequences(placed).collect()}
    for r in placed.collect():
        assert held[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.token_ids)
    with pytest.raises(ValueError):
        packing.pack(placed)
    with pytest.raises(Exception, match="lengths must be"):
        packing.pack(spark.createDataFrame([(17,)], "length bigint"), 16).collect()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZéÉß×ÿİΣ'sLd1½中́  \t\n\x0b\x1c\x00#ªﬁ<|>endoftx~!"), max_size=40), max_size=5))
def test_words_encoded_one_by_one_are_the_library_s(texts):
    lib = [e.ids for e in packing._tokenizer(WORDS)[0].encode_batch(texts, add_special_tokens=False)]
    assert [list(memoryview(x).cast("I")) for x in packing.encode_words([t.encode() for t in texts], WORDS)] == lib


def test_the_word_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 5)
    for _ in range(3):
        assert len(packing.encode_words([b"q1 q2 q3 q4", b"q5 q6 " + b"z" * 99], WORDS)) == 2
        assert len(packing._tokenizer(WORDS)[-1]) <= 7


# --- repair

def random_rows(r, n_convs=40, longest=14):
    out = []
    for c in range(n_convs):
        for t in range(r.randrange(0, longest)):
            text = r.choice(["Hi.", "yes", "no!", " ", "", "why? ", "end.\n", "so on", None, f"t{r.randrange(9)}.", "中。", " "])
            out.append((None if c == 0 else c, r.choice([t, t, t, t + 1, None]), r.choice(["user", "assistant", "system", "tool", "usr", None, ""]), text))
    return out


RESULTS = ("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "sha")


@pytest.mark.parametrize("limit", [1, 3, 4096])
def test_repair_at_any_length_of_fragments(spark, limit):
    """Conversations in one task, and cut into fragments of one and three rows."""
    found = random_rows(random.Random(limit))
    df = spark.createDataFrame(found, "conv_id bigint, turn bigint, role string, text string").repartition(7)
    results, turns = repair.repair(df, limit_rows=limit)
    spaced = [(c, t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in found]
    got = results.select(*RESULTS).collect()
    assert B.counted(map(tuple, got)) == B.counted(B.op12(spaced, dict.fromkeys(r[0] for r in found)))
    digest = {r.conv: r.sha for r in got}
    held = defaultdict(list)
    for r in turns.collect():
        held[r.conv].append((r.frag or 0, r.state, [(t.role, t.text) for t in r.turns]))
    for conv, parts in held.items():
        parts.sort()
        tail = [(role, "") for role in repair.TAIL[parts[-1][1]][1]] if parts[-1][1] is not None else []
        assert repair.turns_digest([t for _, _, p in parts for t in p] + tail)[0].hexdigest() == digest[conv]


@pytest.mark.parametrize("which", ["edge", "small", "random"])
def test_op12(spark, edge, which, tmp_path):  # noqa: F811
    sf = {"edge": edge, "small": SF, "random": str(tmp_path)}[which]
    if which == "random":
        spark.createDataFrame([(*r, 1, 2) for r in random_rows(random.Random(9), 120)], "conv_id bigint, turn bigint, role string, text string, frag int, tie int").write.parquet(f"{sf}/conversations.parquet")
    found = rows(spark, sf, "conversations", ["conv_id", "turn", "role", "text"])
    got = registry.op12_conversation_repair(spark, sf)
    assert B.counted(map(tuple, got.collect())) == B.counted(B.op12(B.damaged(found), dict.fromkeys(r[0] for r in found)))


def test_op12_sql_on_random_rows(spark, tmp_path):
    import duckdb

    from tests import oracle

    found = [r for r in random_rows(random.Random(11), 80) if r[1] is not None]
    spark.createDataFrame(found, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert oracle.difference(registry.op12_conversation_repair(spark, str(tmp_path)), con, registry.oracle_sql()["op12_conversation_repair"]) is None


# --- runs

def scanned(texts):
    data = [t.encode() for t in texts]
    return common.Words(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=7), st.integers(1, 40)), max_size=4), st.sampled_from([0.01, 0.3, 4]), st.sampled_from([4, 24]), st.sampled_from([2, 3]))
def test_runs_at_any_share_of_frequent_words(parts, cost, least, times):
    words = [w for p, n in parts for w in (p * n)[:n]]
    before, runs.FFT_COST = runs.FFT_COST, cost
    try:
        w = scanned([" ".join(words), "", " ".join(words[::-1])])
        matches, bounds = runs.lag_counts(w.ids, w.counts, times)
    finally:
        runs.FFT_COST = before
    first = np.concatenate([[0], np.cumsum(w.counts)])
    for d, of in enumerate((words, [], words[::-1])):
        part = matches[bounds[d] : bounds[d + 1]]
        assert part[1:].tolist() == [sum(a == b for a, b in zip(of, of[q:], strict=False)) for q in range(1, len(of) // times + 1)]
        assert runs.runs_of(w.ids[first[d] : first[d + 1]], part, least, times) == B.runs(of, least, times)


@pytest.mark.parametrize("which", ["edge", "small"])
def test_op13(spark, edge, which):  # noqa: F811
    sf = edge if which == "edge" else SF
    got = registry.op13_periodic_runs(spark, sf)
    assert B.counted(map(tuple, got.collect())) == B.counted(B.op13(rows(spark, sf, "documents", ["doc_id", "text"])))


def test_op13_on_planted_and_long_texts(spark, tmp_path):
    """Long periods, long texts with very frequent words, periods inside periods, ids whose texts are planted, and clashing names."""
    r = random.Random(3)
    inner = ["x y"] * 20 + ["z"]
    texts = [" ".join(inner * 4), " ".join([r.choice("abcdefgh") for _ in range(900)] * 3), "w " * 3000, " ".join(r.choice("ab") for _ in range(2500)),
             "  " + "p q r\n" * 7 + "p q r", "p q r " * 8, None, ""]
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:24]
    texts += [" ".join(r.choice(["the", "of", *map(str, range(400))]) for _ in range(r.randrange(1, 600))) for _ in ids]
    docs = [*((1000 + i, t, 1, 2) for i, t in enumerate(texts[:8])), *((i, t, 1, 2) for i, t in zip(ids, texts[8:], strict=True)), (None, texts[0], 1, 2)]
    spark.createDataFrame(docs, "doc_id bigint, text string, _h int, runs int").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.op13_periodic_runs(spark, str(tmp_path)).collect()
    assert B.counted(map(tuple, got)) == B.counted(B.op13([d[:2] for d in docs]))
    assert any(g.doc_id in ids and g.n_runs for g in got)
    with pytest.raises(ValueError):
        runs.find_runs(spark.createDataFrame([(1, "a", 1)], "doc_id int, text string, runs int"), keep=("doc_id", "runs"))


def test_kept_words_are_joined():
    w = scanned(["a  b c", "", "d", " e f "])
    assert w.joined(np.array([1, 0, 1, 0, 0, 1], bool)).to_pylist() == ["a c", "", "", "f"]
    assert w.joined(np.zeros(6, bool)).to_pylist() == [""] * 4 and isinstance(w.joined(np.ones(6, bool)), pa.StringArray)
