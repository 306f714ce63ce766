"""Words that some hash takes for equal, and ids of several texts."""
import random

import numpy as np

from tests.llm import brute as B
from tidelake.llm import common, jaccard, quality, registry

#: Two words of 16 bytes that a hash without a key took for one.
X, Y = "ieqh524yng5by1a2", "x27w1eig[,xp;l!z"


def scanned(texts):
    data = [t.encode() for t in texts]
    return common.Words(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))


def test_op2_counts_windows_by_words():
    texts = [f"{X} b c d {Y} b c", f"{X} b c d {X} b c", "", "a b", "a a a a", f"{Y} b c {X} b c"]
    assert quality.repeated_words(scanned(texts)).tolist() == [0, 6, 0, 0, 4, 0] == [r[5] for r in B.op2_base(list(enumerate(texts)))]


def test_windows_of_different_texts_are_apart():
    r = random.Random(1)
    texts = [" ".join(r.choice("abc") for _ in range(r.randrange(30))) for _ in range(50)]
    assert quality.repeated_words(scanned(texts)).tolist() == [r[5] for r in B.op2_base(list(enumerate(texts)))]


def test_op2_measures_do_not_depend_on_words_seen_before():
    paths = [registry.vocabulary(n) for n in registry.FERTILITY]
    alone = [x.tolist() for x in quality.token_measures(scanned([Y]), *paths)]
    quality.token_measures(scanned([X]), *paths)
    assert [x.tolist() for x in quality.token_measures(scanned([Y]), *paths)] == alone


def test_keyed_hashes_differ_by_key_and_tell_words_apart():
    r = random.Random(2)
    words = [b"", b"a", b"a\0", b"a\0\0\0\0", X.encode(), Y.encode(), b"z" * 128, b"z" * 129, *(bytes(r.randrange(256) for _ in range(r.randrange(1, 140))) for _ in range(500))]
    words = list(dict.fromkeys(words))
    at = np.cumsum([0, *map(len, words)])
    made = [common.keyed_hashes(np.frombuffer(b"".join(words), np.uint8), at[:-1], np.diff(at), key) for key in (b"one", b"two")]
    assert len({tuple(x) for x in made[0].tolist()}) == len(set(made[0][:, 0].tolist())) == len(words)
    assert not (made[0] == made[1]).any()
    moved = common.keyed_hashes(np.frombuffer(b"xyz" + b"".join(words), np.uint8), at[:-1] + 3, np.diff(at), b"one")
    assert (moved == made[0]).all()


def test_op9_links_texts_by_words(spark):
    docs = [(1, f"{X} {X} {X}"), (2, f"{Y} {Y} {Y}"), (3, f"{X} " * 9), (4, f"{Y} " * 9), (5, f"{X} {X} {X}")]
    got = jaccard.similarity_components(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert B.counted(got.collect()) == B.counted(B.op9(docs))


def by_rows(docs):
    """op9 of rows that are documents by themselves."""
    at = B.op9([(i, t) for i, (_, t) in enumerate(docs)])
    least = {}
    for i, _, c in at:
        own = docs[i][0]
        least[c] = min(least.get(c, (True, 1 << 62)), (own is not None, own or 0))
    return [(docs[i][0], n, least[c][1] if least[c][0] else None) for i, n, c in at]


def test_op9_keeps_links_of_ids_with_several_texts(spark):
    r = random.Random(4)
    text = lambda: " ".join(f"w{r.randrange(500)}" for _ in range(60))
    for _ in range(4):
        a, b, c, d, e = (text() for _ in range(5))
        docs = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (None, c), (None, d), (4, c + " x"), (5, d + " x"), (1, a), (6, e), (6, e + " y"), (7, None), (7, e + " z z"), (None, ""), (None, c), (0, d + " x y")]
        r.shuffle(docs)
        got = jaccard.similarity_components(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3))
        assert B.counted(got.collect()) == B.counted(by_rows(docs))
