"""Parts of the corpus operators by themselves."""
import io
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import brute as B
from tidelake.llm import bpe, common, decontamination, extraction, jaccard, quality, registry, substrings, warc

PATH = registry.vocabulary("byte_bpe_50k.tiktoken")
ALPHABET = "ab's't re ve ll 'd  \n\t\r\u00a0\u3000\x1c\x85 12\u0663½é中文😀!?.,''`_-AB\u0301ǅ\u200b"


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as P
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(ALPHABET, max_size=40), st.text(max_size=30)), min_size=1, max_size=8))
def test_encoding_equals_the_library(reference, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids, counts = bpe.encode_texts(texts, PATH)
    at = 0
    for t, n in zip(texts, counts, strict=True):
        assert ids[at : at + n].tolist() == reference.encode_ordinary(t)
        at += n


def test_long_slices_merge(reference):
    for t in ("a" * 30_000, " " * 5000, "ab" * 9000, "é!" * 4000):
        assert bpe.encode_texts([t], PATH)[0].tolist() == reference.encode_ordinary(t)


def test_offsets_and_arrays(spark):
    df = spark.createDataFrame([(1, "héllo wörld", 7), (2, None, 8), (3, "", 9)], "doc_id bigint, text string, n_tokens int")
    got = {r.doc_id: r for r in bpe.encode(df.drop("n_tokens"), PATH).collect()}
    assert got[2].token_ids == [] and got[3].n_tokens == 0
    ranks = {v: k for k, v in bpe.load_ranks(PATH).items()}
    assert [len(ranks[i]) for i in got[1].token_ids] == np.diff([*got[1].token_offsets, len("héllo wörld".encode())]).tolist()
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode(bpe.encode(df.drop("n_tokens"), PATH), PATH).collect()}
    assert back == {1: "héllo wörld".encode(), 2: b"", 3: b""}


def test_decoding_needs_fitting_offsets(spark):
    coded = bpe.encode(spark.createDataFrame([(1, "some words here")], "doc_id bigint, text string"), PATH)
    for wrong in ("transform(token_offsets, x -> x + 1)", "slice(token_offsets, 1, 1)"):
        with pytest.raises(Exception, match="offset"):
            bpe.decode(coded.selectExpr("doc_id", "token_ids", f"{wrong} AS token_offsets"), PATH).collect()
    with pytest.raises(ValueError):
        bpe.encode(coded.selectExpr("doc_id", "'x' AS text", "n_tokens"), PATH, keep=("doc_id", "n_tokens"))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("aB \t\né\u2003中", max_size=30), min_size=1, max_size=6))
def test_word_scanning(texts):
    data = [t.encode() for t in texts]
    w = common.Words(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    want = [(i, x) for i, d in enumerate(data) for x in d.split()]
    assert [(int(d), w.raw[s:e].tobytes()) for d, s, e in zip(w.doc, w.starts, w.ends, strict=True)] == want
    assert len({x for _, x in want}) == len(set(w.hash.tolist()))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=25), min_size=1, max_size=6))
def test_suffix_automaton(sequences):
    a, seen = substrings.SuffixAutomaton(), []
    for s in sequences:
        want = []
        for end in range(1, len(s) + 1):
            want.append(max(n for n in range(end + 1) if n == 0 or any(s[end - n : end] == t[i : i + n] for t in seen for i in range(len(t) - n + 1))))
        assert a.matches(s) == want
        a.add(s)
        seen.append(s)


@settings(max_examples=8, deadline=None)
@given(st.integers(0, 10_000))
def test_substring_dedup_against_brute_force(spark, seed):
    r = random.Random(seed)
    pool = [" ".join(r.choice("abc") for _ in range(r.randrange(5, 40))) for _ in range(6)]
    docs = [(i, " ".join(r.choice(pool) for _ in range(r.randrange(4)))) for i in range(12)]
    got = substrings.dedup_substrings(spark.createDataFrame(docs, "doc_id bigint, text string"), window=20)
    assert B.counted((x.doc_id, x.n_words, x.n_removed, B.sha(x.kept)) for x in got.collect()) == B.counted(B.op7(docs))


@pytest.mark.parametrize("letters", [64, 1024, 2048])
def test_words_that_cancel_in_sums_stay_different(spark, letters):
    """Neither removed nor linked, as the windows and shingles differ; nor counted as repeats."""
    x, y = B.cancelling_words(letters)
    a, b = [f"w{i}" for i in range(10)], [f"z{i}" for i in range(9)]
    docs = [(1, " ".join([*a, x, *b])), (2, " ".join([*a, y, *b])), (3, " ".join([x] * 3)), (4, " ".join([y] * 3)), (5, " ".join([x, y, x, y, y, x, x, x]))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = substrings.dedup_substrings(df).collect()
    assert B.counted((r.doc_id, r.n_words, r.n_removed, B.sha(r.kept)) for r in got) == B.counted(B.op7(docs)) and not any(r.n_removed for r in got)
    assert B.counted(jaccard.similarity_components(df).collect()) == B.counted(B.op9(docs))
    data = [t.encode() for _, t in docs]
    words = common.Words(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    assert quality.repeated_words(words).tolist() == [r[5] for r in B.op2_base(docs)]


def test_windows_beyond_the_place_bits_are_refused(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    for window in (5, 262):
        with pytest.raises(ValueError):
            substrings.dedup_substrings(df, window=window)
    assert substrings.dedup_substrings(df, window=261).first().n_words == 2


def test_crowded_anchors_take_the_other_way(spark, monkeypatch):
    r = random.Random(3)
    shared = " ".join(f"s{i}" for i in range(40))
    docs = [(i, " ".join(f"w{r.randrange(9999)}" for _ in range(15)) + " " + shared + " " + " ".join(f"w{r.randrange(9999)}" for _ in range(15))) for i in range(40)]
    monkeypatch.setattr(substrings, "SHARD_CHUNKS", 3)
    got = substrings.dedup_substrings(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert B.counted((x.doc_id, x.n_words, x.n_removed, B.sha(x.kept)) for x in got.collect()) == B.counted(B.op7(docs))


@settings(max_examples=6, deadline=None)
@given(st.integers(0, 10_000))
def test_jaccard_components_against_brute_force(spark, seed):
    """Families of edited copies whose members link only through others."""
    r = random.Random(seed)
    docs = []
    for f in range(3):
        base = [f"f{f}w{i}" if r.random() < 0.7 else f"c{i % 9}" for i in range(r.randrange(30, 150))]
        for _ in range(r.randrange(1, 14)):
            t = list(base)
            for _ in range(r.randrange(6)):
                k = r.randrange(len(t))
                t[k : k + r.randrange(2)] = [f"e{r.randrange(99)}"] * r.randrange(2)
            docs.append((len(docs), " ".join(t)))
            base = t if r.random() < 0.3 else base
    r.shuffle(docs)
    got = jaccard.similarity_components(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert B.counted(got.collect()) == B.counted(B.op9(docs))


def test_long_lists_are_dealt_to_several_tasks(spark, monkeypatch):
    """Whatever the bounds from which a shingle's list is dealt in parts."""
    r = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(90):
        t = list(base)
        for k in r.sample(range(60), r.randrange(5)):
            t[k] = f"e{r.randrange(999)}"
        docs.append((i, " ".join(t[: r.choice([60, 60, 55, 20])])))
    docs += [(100 + i, " ".join(base[:12] + [f"x{i}y{j}" for j in range(r.randrange(3))])) for i in range(20)]
    monkeypatch.setattr(jaccard, "HOT", 2)
    monkeypatch.setattr(jaccard, "SPLIT", 3)
    got = jaccard.similarity_components(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert B.counted(got.collect()) == B.counted(B.op9(docs))


def test_components(spark):
    r = random.Random(1)
    links = [(a, b) for a, b in ((r.randrange(60), r.randrange(60)) for _ in range(45)) if a != b] + [(i, i + 1) for i in range(100, 130)]
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    ids = {x for p in links for x in p}
    got = {x.id: x.component for x in jaccard.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert {i: got.get(i, i) for i in ids} == {i: root(i) for i in ids}


def test_warc_bundles_are_seekable(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i % 5}</p>" * 9000) for i in range(30)], "page_id bigint, url string, html string").coalesce(2)
    folder = f"file://{tmp_path}/w"
    index = warc.archive(pages, folder)
    assert index.agg({"frame": "max"}).first()[0] > 0
    r = index.where("page_id = 3").first()
    fields, block = warc.read_record(folder, r.bundle, r.frame, r.offset, r.length)
    assert fields["WARC-Type"] == "response" and block.decode() == "<p>3</p>" * 9000
    read = {x.page_id: x for x in warc.read_bundles(index, folder, payloads=True).collect()}
    assert len(read) == 30 and read[13].refers_to == 3 and read[13].payload_bytes == len(block) and bytes(read[4].payload) == b"<p>4</p>" * 9000
    assert warc.seek_table(io.BytesIO(open(f"{tmp_path}/w/{r.bundle}", "rb").read()), (tmp_path / "w" / r.bundle).stat().st_size)[0][0] == 0


@pytest.mark.parametrize("page", ["<" * 50_000, "<a '" * 20_000, "<!--" + "x" * 50_000, "<p>a<p>b</div></p>c", "<table><tr><td>x<td>y</table>", "<script>var a='<p>no</p>'</script>yes", "<ul><li>a<li>b</ul>"])
def test_extraction_survives_odd_markup(page):
    extraction.text_under(page, ["/body/article"])


@pytest.mark.parametrize("page", [
    "<div>" * 100_000 + "x", "<div>x" + "</p></b></div></section>" * 40_000, "<i><div>" + "<b>" * 100_000 + "</i>" * 100_000, "<ul><li><ul>" + "<div>" * 50_000 + "<li></li>" * 60_000,
    "<svg>" * 200_000, "<a '" * 200_000, "<b>" * 100_000 + "<div>" + "</b>" * 150_000, "<div>" * 80_000 + "<td></td>" * 60_000, '<a "x>' * 100_000])
def test_extraction_is_linear_in_broken_markup(page):
    """Half a megabyte and more of nested, unmatched or unclosed tags."""
    began = time.process_time()
    extraction.text_under(page, ["/body/article"])
    assert time.process_time() - began < 6


def random_page(r, template):
    words = lambda n: " ".join(r.choice(["one", "two", "three&amp;four", "f\u00fcnf", "six "]) for _ in range(n))

    def piece(depth):
        kind = r.randrange(11)
        if kind < 3 or depth > 3:
            return f"<p>{words(r.randrange(1, 9))}<b>{words(2)}</b></p>"
        if kind == 3:
            return f"<p>{words(2)}<br>{words(1)} <a href='/x'>{words(r.randrange(1, 5))}</a></p>"
        if kind == 4:
            return f"<{(t := r.choice(['nav', 'aside', 'footer', 'form']))}>{words(4)}</{t}>"
        if kind == 5:
            return f"<div class='{r.choice(['ad', 'comments', 'share-buttons', 'related-work', 'no-sidebar', 'box7'])}'>{words(6)}</div>"
        if kind == 6:
            return f"<h2>{words(2)}</h2>"
        if kind == 7:
            return f"<p>{words(2)}<b class='ad'>{words(1)}</b> <math><mi>{words(1)}</mi></math> {words(1)}</p>"
        if kind == 8:
            return f"<pre><code>{words(1)} <span class='comments'># {words(2)}</span> {words(1)}</code></pre>"
        tag = r.choice(["div", "section", "div class='part3'"])
        return f"<{tag}>" + "".join(piece(depth + 1) for _ in range(r.randrange(1, 4))) + f"</{tag.split()[0]}>"

    body = "".join(piece(0) for _ in range(r.randrange(1, 7)))
    head = f"<h1>{words(2)}</h1>"
    return "<html><head><title>t</title></head><body>" + [
        f"<article><header>{head}</header>{body}</article><p>small print</p>", f"<div class='wrap1'>{head}<div class='post9'>{body}</div></div>",
        f"<main>{body}</main>", body, f"<header>{head}</header><div>{body}</div><div class='cookie-notice'>{words(9)}</div>"][template] + "</body></html>"


def test_extraction_against_brute_force(spark, monkeypatch):
    r = random.Random(11)
    pages = [(i, f"http://h{i % 7}.org/{i}", random_page(r, r.choice([i % 7 % 5, r.randrange(5)]))) for i in range(400)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    winners = extraction.winning_paths(extraction.host_votes(df)).cache()
    got = {x.page_id: x.text for x in extraction.extract(df, winners).collect()}
    assert got == dict(B.op5([(i, url.split("/")[2], page) for i, url, page in pages]))
    monkeypatch.setattr(extraction, "BROADCAST_ROWS", 0)  # so hosts meet their paths by shuffle, those of many pages by a broadcast
    assert {x.page_id: x.text for x in extraction.extract(df, winners).collect()} == got


def test_contamination_beyond_its_broadcast_bounds(spark, monkeypatch):
    """The same result whether tables are broadcast or not."""
    words = [f"w{i}" for i in range(60)]
    items = spark.createDataFrame([("a", " ".join(words[:20])), ("b", " ".join(words[30:35])), ("c", None)], "item_id string, text string")
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[5:16])), (3, None), (None, " ".join(["x", *words[2:17]]))], "doc_id bigint, text string")
    told = lambda: sorted(map(str, decontamination.contamination(docs, items).drop("text_hash").collect()))
    small = told()
    assert [sum(f"n_hit={n}," in r for r in small) for n in (25, 0, 15)] == [1, 2, 1]
    for name in ("BROADCAST_BYTES", "BROADCAST_ROWS"):
        monkeypatch.setattr(decontamination, name, 0)
        assert told() == small


@pytest.mark.parametrize(("page", "text"), [
    ("<article><header><h1>Title</h1></header><p>Lead paragraph</p><div class='body'>" + "long " * 99 + "</div></article>", "Title\nLead paragraph\n" + ("long " * 99).strip()),
    ("<article><p>one</p><section class='s1'>two</section><section class='t'>" + "longer " * 99 + "</section></article>", "one\ntwo\n" + ("longer " * 99).strip()),
    ("<article><p>one</p><div class='related-work'>two</div><div class='social-history'>three</div><div class='related-posts'>no</div></article>", "one\ntwo\nthree")])
def test_extraction_gives_whole_articles(page, text):
    path, _ = extraction.vote(page)
    assert path == "/article" and extraction.text_under(page, [path]) == extraction.text_under(page, []) == text


def test_extraction_leaves_boilerplate_out():
    page = ("<body><header>H</header><div id='main-menu'>m</div><main><article class='post-1'><header><h1>T</h1></header><p>Text &eacute;&nbsp;one</p><aside>a</aside><div class='share-buttons'>s</div>"
            "<form><input>f</form><p>Two</p></article><section class='comments'><p>c</p></section></main><div class='cookie-notice'>n</div></body>")
    assert extraction.text_under(page, ["/body/main/article.post-"]) == "T\nText é one\nTwo"


BODY = "<p>One text of some length that is the article of the page.</p><p>Two</p>"


@pytest.mark.parametrize("page", [
    f"<body><article><header class='entry-header'><h1>T</h1></header>{BODY}</article><footer>f</footer></body>",
    f"<body><div class='content no-sidebar'><h1>T</h1>{BODY}</div><div class='sidebar'>s</div></body>",
    f"<body><div class='has-sidebar' id='with-banner'><h1>T</h1>{BODY}</div><div class='comments'>{'c ' * 300}</div></body>",
    f"<body><form><nav>n</nav><div class='ad'>a</div><div><h1>T</h1>{BODY}</div><footer>{'f ' * 300}</footer></form></body>",
    f"<body><div class='page sidebar-left'><main><h1>T</h1>{BODY}</main></div><p>Small print</p></body>",
    f"<body><article><h1>T</h1><svg><select><iframe><noscript>{BODY}</article></body>"])
def test_extraction_keeps_articles_with_odd_wrappers(page):
    assert extraction.text_under(page, []) == "T\nOne text of some length that is the article of the page.\nTwo"


def test_pipeline_against_brute_force(spark):
    """Stages on the smallest table, each held against plain Python on its own input."""
    import corpus_pipeline as C

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(C.STAGES)
    kept = {r.doc_id: r.kept for r in registry.op2_quality_rules(spark, sf).collect()}
    first = stages["quality_rules"](spark, docs, sf)
    assert first.columns == docs.columns
    left = {r.doc_id: r.text for r in first.collect()}
    assert left == {i: t for i, t in texts.items() if kept[i]}
    second = stages["ngram_jaccard_join"](spark, first, sf)
    reps = {i for i, _, c in B.op9(list(left.items())) if i == c}
    assert {r.doc_id for r in second.collect()} == reps
    left = {i: t for i, t in left.items() if i in reps}
    third = {r.doc_id: r for r in stages["substring_dedup"](spark, second, sf).collect()}
    for i, n, gone, digest in B.op7(list(left.items())):
        assert (i in third) == (gone < n or n == 0)
        if i in third:
            assert third[i].text == left[i] if not gone else B.sha(third[i].text) == digest
            assert third[i].n_chars == len(third[i].text)
    rows = [(r.doc_id, r.text) for r in third.values()]
    fourth = stages["benchmark_decontamination"](spark, spark.createDataFrame(list(third.values()), docs.schema), sf)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {r[0] for r in B.op6(rows, bench) if not r[5]}
    assert {r.doc_id for r in fourth.collect()} == clean
    last = stages["byte_level_bpe"](spark, fourth, sf).collect()
    want = {r[0]: r[1] for r in B.op1([x for x in rows if x[0] in clean])}
    assert {r.doc_id: r.n_tokens for r in last} == want
    assert B.counted((r.doc_id, r.n_tokens) for r in C.run(spark, sf).collect()) == B.counted(want.items())


def test_marked_words_inside_text_are_text():
    page = ("<body><article><p>" + "word " * 40 + "</p><pre><code>x <span class='comment'># why</span> y</code></pre><p>Energy <math><mi>E</mi></math> holds</p>"
            "<p>a <b class='ad'>AD</b> b</p><div class='ad'>gone</div><p>c <noscript>d</noscript> <svg><title>no</title><text>e</text></svg></p></article></body>")
    got = extraction.text_under(page, ["/body/article"])
    assert got.split("\n")[1:] == ["x # why y", "Energy E holds", "a AD b", "c d e"]
