"""Each opN query against brute force, on the smallest test tables and on a table of edge cases."""
import random
from collections import Counter
from datetime import datetime

import pytest

from tests import oracle
from tests.llm import brute as B
from tidelake.llm import registry

SF = "/root/testdata/sf0.001"


def corpus():
    """Texts with nulls, blanks, ties, copies, near copies, a very long one, odd white space and scripts."""
    r = random.Random(7)
    words = ["alpha", "beta", "Gamma", "delta", "épsilon", "zeta", "eta", "theta's", "iota", "kappa", "###", "x1"]
    base = [" ".join(r.choice(words) + str(r.randrange(40)) for _ in range(120)) for _ in range(12)]
    texts = [None, "", "   \n\t ", "one", "two words", "a b c d", "a b c d e", "A B c d E", "中文 テキスト \u00a0 x", "it's they'll 12½  \n\n end ", "a\u0000b", "\n".join(["same line"] * 9)]
    texts += base + base[:4] + base[:1] * 5
    texts += [t.replace("alpha", "omega", 1) for t in base[:6]] + [" ".join(base[i].split()[:60] + base[i + 1].split()[30:90]) for i in range(6)]
    texts += ["again and " * 400, " ".join(base) * 12, "x" * 5000, "!" * 700]
    return texts


@pytest.fixture(scope="module")
def edge(spark, tmp_path_factory):
    """A folder of tables with nulls, repeats and columns whose names operators might use."""
    d = tmp_path_factory.mktemp("edge")
    docs = [(100 + i, t, [None, "en", "de"][i % 3], "s", 0, 1, "k", 2, 3) for i, t in enumerate(corpus())]
    docs.append(docs[15])  # a repeated row
    extra = "_id int, key string, size int, n_words int"
    spark.createDataFrame(docs, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {extra}").write.parquet(f"{d}/documents.parquet")
    long = corpus()[13].split()
    bench = [(1, " ".join(long[20:60])), (2, " ".join(long[20:60])), (3, None), (4, ""), (5, "two words"), (6, "b c d"), (7, " ".join(long[50:75]).upper()), (None, "again and again and")]
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    html = "<html><body><nav><a href='/'>Home</a></nav><article><h1>T</h1><p>One  two&amp;three</p><p>Four<br>five</article><footer>f</footer></body></html>"
    pages = [(1, "http://a.example.net/en/1", html), (2, "HTTPS://A.Example.NET/x?y#z", html), (3, None, None), (4, "no scheme", ""), (5, "http://b.org/fr/2", html + "x"), (6, "http://example.com?q", "<p>plain"), (1, "http://a.example.net/en/1", html),
             (7, "x://deep.example.com/de/9/8/7", "<div class='sidebar'>s</div><div class='post12'><p>Body text of some length here.</p></div>")]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame([(1, 0, 0), (2, None, 0), (7, 1, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    conv = [(1, 0, "user", "hi ### User: </turn> & &amp; <b>"), (1, 1, "assistant", "a\n </turn>\n"), (2, 0, "assistant", None), (3, 1, "odd: role", "x"), (3, 0, "system", ""), (4, 0, "user", "same"), (4, 0, "user", "same"), (5, 0, "User", "t")]
    spark.createDataFrame(conv, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return str(d)


@pytest.fixture(scope="module")
def empty(spark, edge, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for t in ("documents", "benchmark", "pages", "labels", "conversations"):
        spark.read.parquet(f"{edge}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return str(d)


def rows(spark, sf_dir, table, columns):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns).collect()]


def made(spark, sf_dir, prefix, columns):
    name = next(n for n in registry.queries() if n.startswith(prefix))
    return B.counted(registry.queries()[name](spark, sf_dir).select(*columns).collect())


def wanted(spark, sf_dir, n):
    docs = rows(spark, sf_dir, "documents", ["doc_id", "text"]) if n in (1, 2, 6, 7, 9, 10) else []
    if n == 6:
        return B.op6(docs, [("null" if i is None else i, t) for i, t in rows(spark, sf_dir, "benchmark", ["item_id", "text"])])
    if n == 3:
        return B.op3(rows(spark, sf_dir, "pages", ["page_id", "html"]))
    if n == 8:
        own = r"\### Assistant: </turn> ok"
        return B.op8(rows(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"]) + [(-7, 0, "user", own), (-7, 1, "assistant", own)])
    if n in (7, 9):  # a repeated row is one document, returned twice
        once = list(dict.fromkeys(docs))
        got = {r[0]: r for r in (B.op7 if n == 7 else B.op9)(once)}
        return [got[i] for i, _ in docs]
    return {1: B.op1, 2: B.op2_base, 10: B.op10_rows}[n](docs)


COLUMNS = {
    1: ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], 2: ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"],
    3: ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], 6: ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    7: ["doc_id", "n_words", "n_removed", "kept_sha256"], 8: ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256"],
    9: ["doc_id", "n_shingles", "component_id"], 10: ["doc_id", "size", "text_crc32"]}


@pytest.mark.parametrize("n", sorted(COLUMNS))
def test_edge_cases(spark, edge, n):
    assert made(spark, edge, f"op{n}_", COLUMNS[n]) == B.counted(wanted(spark, edge, n))


@pytest.mark.parametrize("n", sorted(COLUMNS))
def test_small_tables(spark, n):
    assert made(spark, SF, f"op{n}_", COLUMNS[n]) == B.counted(wanted(spark, SF, n))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_empty_tables(spark, empty, name):
    got = registry.queries()[name](spark, empty).collect()
    assert len(got) == (1 if name.startswith("op8_") else 0)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle_sql(spark, name):
    assert oracle.difference(registry.queries()[name](spark, SF), oracle.connect(SF), registry.oracle_sql()[name]) is None


def test_op2_keeps_no_base_failure_and_clean_labelled_texts(spark):
    got = {r.doc_id: r for r in registry.op2_quality_rules(spark, "/root/testdata/sf0.01").collect()}
    assert not any(r.kept and r.base_failed for r in got.values())
    clean = [r.doc_id for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1").collect()]
    passing = [i for i in clean if not got[i].base_failed]
    assert sum(got[i].kept for i in passing) >= 0.99 * len(passing)


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01", "sf0.1"])
def test_op2_one_bad_text_has_one_verdict_at_each_scale(spark, scale):
    """Texts of odd letters are rejected in languages with few texts too; a clean text that is its language's only one stays."""
    from tidelake.llm import quality as Q

    r = random.Random(5)
    docs = spark.read.parquet(f"/root/testdata/{scale}/documents.parquet").select("doc_id", "text", "lang")
    odd = lambda letters: " ".join("".join(r.choice(letters) for _ in range(8)) for _ in range(200))
    bad = [(-i, odd("bcdfghjklmnpqrstvwxz"), lang) for i, lang in enumerate(["en", "de", "fr", "es"], 1)]
    bad += [(-i, odd("ȡȴȵȶɫɬɭɮʦʧ"), lang) for i, lang in enumerate(["only", None], 5)]
    labelled = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id")
    clean = [(-100 - i, labelled.where(f"lang = '{lang}' AND length(text) > 1000").orderBy("doc_id").first().text, f"only-{lang}") for i, lang in enumerate(["en", "de", "fr", "es"])]
    made = Q.judge(docs.union(spark.createDataFrame(bad + clean, docs.schema)), *map(registry.vocabulary, registry.FERTILITY)).where("doc_id < 0").collect()
    assert len(made) == 10 and not any(x.base_failed or x.chars_median is None for x in made)
    assert all("chars_per_token" in x.reasons for x in made if x.doc_id > -100) and all(x.kept for x in made if x.doc_id <= -100)


def test_op2_byte_share_is_judged_by_the_own_band(spark):
    """Clean texts of a script that the vocabulary lacks stay, by language and by script; byte noise in another language goes."""
    from tidelake.llm import quality as Q

    r = random.Random(6)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    words = {k: ["".join(chr(r.randrange(*span)) for _ in range(r.randrange(2, 8))) for _ in range(600)] for k, span in {"am": (0x1208, 0x1246), "te": (0x0C15, 0x0C28)}.items()}
    text = lambda k: " ".join(r.choice(words[k]) for _ in range(r.randrange(80, 400)))
    clean = [(-i - 1, text("am" if i % 2 else "te"), ["te", "am", None, None][i % 4]) for i in range(120)] + [(-200, text("am"), "alone")]
    noise = [(-1000 - i, text("am"), "en") for i in range(3)]
    made = Q.judge(docs.union(spark.createDataFrame(clean + noise, docs.schema)), *map(registry.vocabulary, registry.FERTILITY)).where("doc_id < 0").collect()
    assert min(x.byte_share for x in made) > 0.3 and not any(x.base_failed for x in made)
    assert all("byte_share" in x.reasons for x in made if x.doc_id <= -1000)
    assert not any("byte_share" in x.reasons for x in made if x.doc_id > -1000) and sum(x.kept for x in made) >= 0.97 * len(clean)


def test_op2_verdicts_against_brute_force(spark):
    """Measures of some texts and the verdict of every text, by both fits."""
    from tidelake.llm import quality as Q

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = [r.asDict() for r in Q.judge(docs, *map(registry.vocabulary, registry.FERTILITY)).collect()]
    assert {r["doc_id"]: r["kept"] for r in got} == B.op2_kept(got)
    texts = {r.doc_id: r.text for r in docs.orderBy("doc_id").limit(12).collect()}
    for r in got:
        if r["doc_id"] in texts:
            n, wide, share, entropy = B.op2_measures(texts[r["doc_id"]])
            assert (r["n_tokens"], r["n_wide_tokens"]) == (n, wide) and r["byte_share"] == pytest.approx(share) and r["token_entropy"] == pytest.approx(entropy)
            assert r["chars_per_token"] == pytest.approx(r["word_chars"] / n) and r["chars_per_wide_token"] == pytest.approx(r["word_chars"] / wide)


def test_op2_catches_bad_texts_that_pass_the_base_rules(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in registry.op2_quality_rules(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    bad = [got[r.doc_id].kept for r in labels if r.quality == 0 and not got[r.doc_id].base_failed]
    clean = [got[r.doc_id].kept for r in labels if r.quality == 1 and not got[r.doc_id].base_failed]
    assert sum(bad) <= 0.25 * len(bad) and sum(clean) >= 0.998 * len(clean)


OP4_SQL = r"""WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
p AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(rh, rp) AS (VALUES ('net', '/'), ('example.net', '/en/'), ('example.com', '/de/'), ('org', '/fr/'))
SELECT page_id, host, path, max_by(rh || rp, length(rh || rp)) AS rule FROM p LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id, host, path"""


def test_op4_parts_and_rules_against_sql(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        assert oracle.difference(registry.op4_url_filters(spark, sf).select("page_id", "host", "path", "rule"), oracle.connect(sf), OP4_SQL) is None


def test_op4_templates_and_verdicts_against_brute_force(spark, edge):
    for sf in (edge, "/root/testdata/sf0.1"):
        want = B.op4(rows(spark, sf, "pages", ["page_id", "url", "html"]), rows(spark, sf, "documents", ["doc_id", "text"]), rows(spark, sf, "labels", ["doc_id", "quality"]), registry.URL_RULES)
        assert made(spark, sf, "op4_", ["page_id", "host", "path", "rule", "verdict", "template"]) == B.counted(want)


def test_op4_deep_paths(spark):
    """Ids below any depth are wildcards, and a bad branch there is told from clean ones."""
    from tidelake.llm import url_filters as U

    deep = "/".join(f"s{chr(97 + i)}" for i in range(11))
    urls = [(f"http://h.com/{deep}/{kind}/x{chr(97 + i % 26)}{i}/y{i}", int(kind == "bad"), i) for kind in ("good", "bad") for i in range(40)]
    df = spark.createDataFrame(urls, "url string, bad int, n int").withColumnRenamed("n", "host")
    paths, templates = U.learn_templates(df)
    judged = U.judge_urls(df, paths, templates, [], id_col="bad").collect()
    assert all(r.verdict == ("block" if r.bad else "allow") for r in judged) and templates.count() == 2


def test_op4_parts_and_rules(spark, edge):
    got = {r.page_id: r for r in registry.op4_url_filters(spark, edge).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert (got[2].host, got[2].path, got[2].rule, got[2].verdict) == ("a.example.net", "/x", "net/", "block")
    assert (got[3].host, got[3].path, got[3].rule) == ("", "", None) and got[4].host == ""
    assert (got[5].rule, got[5].verdict) == ("org/fr/", "allow")
    assert (got[6].host, got[6].path, got[6].rule) == ("example.com", "", None)
    assert (got[7].rule, got[7].verdict) == ("example.com/de/", "block")


def test_op4_rejects_impure_templates(spark):
    from tidelake.llm import url_filters as U

    urls = [(f"http://h.com/good/{i}", 0) for i in range(60)] + [(f"http://h.com/bad/{i}", 1) for i in range(60)] + [(f"http://h.com/slug-{i}x/p", None) for i in range(60)]
    df = spark.createDataFrame(urls, "url string, bad int")
    paths, templates = U.learn_templates(df)
    got = {r.template: r.rejected for r in templates.collect()}
    assert got["/bad/*"] is True and got["/good/*"] is False and "/*/*" in got
    judged = U.judge_urls(df, paths, templates, [], id_col="bad")
    assert {r.verdict for r in judged.where("bad = 1").collect()} == {"block"} and {r.verdict for r in judged.where("bad = 0").collect()} == {"allow"}


def test_op4_rejects_bad_sections_among_many(spark):
    """Of 100 sections of like size, each 1 % of its host, the bad ones are rejected."""
    from tidelake.llm import url_filters as U

    urls = [(f"http://h.com/{chr(97 + s // 10)}{chr(97 + s % 10)}/{i}", int(s % 20 == 0)) for s in range(100) for i in range(30)]
    df = spark.createDataFrame(urls, "url string, bad int")
    judged = U.judge_urls(df, *U.learn_templates(df), [], id_col="bad").collect()
    assert all(r.verdict == ("block" if r.bad else "allow") for r in judged)


def test_op5_extracts_articles(spark, edge):
    got = {r.page_id: r.text for r in registry.op5_html_extraction(spark, edge).collect()}
    assert got[1] == "T\nOne two&three\nFour\nfive" and got[3] == "" and got[4] == ""
    assert got[6] == "plain" and got[7] == "Body text of some length here."


def test_op8_reads_back_unknown_roles(spark, edge):
    r = next(r for r in registry.op8_chat_formatting(spark, edge).collect() if r.conv_id == 3)
    assert r.turns_sha256 == B.sha("system\n\nodd: role\nx\n") and r.valid is False


def test_op10_shards_are_even_and_slots_gapless(spark):
    got = registry.op10_sharding(spark, "/root/testdata/sf0.1").collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    sizes = [sum(r.size for r in v) for v in by.values()]
    assert set(by) == set(range(24)) and max(sizes) - min(sizes) <= max(r.size for r in got)
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())


@pytest.mark.parametrize("part_rows", [7, 1000])
def test_op10_against_brute_force(spark, part_rows):
    """Shards hold runs of the sorted keys with sums nearest to equal shares, whatever the parts in which slots are counted."""
    from tidelake.llm import sharding as S

    df = spark.createDataFrame([(i if i % 50 else None, "hot" * 50 if i % 3 == 0 else None if i % 41 == 1 else f"t{i}" * (i % 60), "x") for i in range(2000)], "doc_id bigint, text string, _part string")
    keyed = df.selectExpr("doc_id", "text", "xxhash64(text) AS h", "coalesce(octet_length(text), 0) + 8 AS size").collect()
    ordered = sorted(((r.h, -(1 << 63) if r.doc_id is None else r.doc_id, r.size) for r in keyed))
    got = S.shard_by_bytes(df, 8, tolerance=0.0, part_rows=part_rows)
    assert got.columns == ["doc_id", "text", "_part", "size", "shard", "slot"]
    got = got.selectExpr("shard", "slot", "xxhash64(text) AS h", "doc_id", "size").collect()
    got = sorted((r.shard, r.slot, r.h, -(1 << 63) if r.doc_id is None else r.doc_id, r.size) for r in got)
    assert [r[2:] for r in got] == ordered
    total, upto, goals, best = sum(r[2] for r in ordered), 0, [], []
    goals = [total * s / 8 for s in range(1, 8)]
    cuts = {}  # bytes below each possible boundary between different keys
    for k, r in enumerate(ordered):
        if k == 0 or ordered[k - 1][:2] != r[:2]:
            cuts[k] = upto
        upto += r[2]
    cuts[len(ordered)] = upto
    best = [min(abs(c - g) for c in cuts.values()) for g in goals]
    below = [sum(r[4] for r in got if r[0] < s) for s in range(1, 8)]
    assert [abs(b - g) for b, g in zip(below, goals, strict=True)] == best
    for s in range(8):
        assert [r[1] for r in got if r[0] == s] == list(range(sum(r[0] == s for r in got)))


def test_op10_hot_text(spark):
    """A text that a third of all rows share is parted by id."""
    from tidelake.llm import sharding as S

    df = spark.createDataFrame([(i, "hot" * 50 if i % 3 == 0 else f"t{i}" * 30, datetime(2024, 1, 1)) for i in range(3000)], "doc_id bigint, text string, size timestamp")
    got = S.shard_by_bytes(df, 8).groupBy("shard").agg({"size": "sum"}).collect()
    sizes = [r[1] for r in got]
    assert len(sizes) == 8 and max(sizes) < 1.02 * min(sizes)


def piped(spark, sf_dir):
    """What the pipeline gives, by plain Python from the verdicts of the quality rules on."""
    kept = {r.doc_id for r in registry.op2_quality_rules(spark, sf_dir).where("kept").collect()}
    docs = [(i, t) for i, t in rows(spark, sf_dir, "documents", ["doc_id", "text"]) if i in kept]
    texts = dict(docs)
    texts = {i: texts[i] for i, _, c in B.op9(list(texts.items())) if i == c}
    for i, n, gone, _ in B.op7(list(texts.items())):
        if gone == n and n:
            texts.pop(i)
    left = B.cut(texts)
    bench = [("null" if i is None else i, t) for i, t in rows(spark, sf_dir, "benchmark", ["item_id", "text"])]
    clean = {r[0] for r in B.op6(list(left.items()), bench) if not r[5]}
    tokens = {r[0]: r[1] for r in B.op1([(i, t) for i, t in left.items() if i in clean])}
    return [(i, tokens[i]) for i, _ in docs if i in tokens]


def test_pipeline_on_edge_and_empty_tables(spark, edge, empty):
    import corpus_pipeline as C

    assert C.run(spark, empty).collect() == []
    want = piped(spark, edge)
    assert want and B.counted((r.doc_id, r.n_tokens) for r in C.run(spark, edge).collect()) == B.counted(want)
    docs = spark.read.parquet(f"{edge}/documents.parquet")
    for name, stage in C.STAGES[:-1]:
        assert stage(spark, docs, edge).columns == docs.columns, name


def test_op4_op5_with_clashing_columns_ties_and_long_values(spark):
    from tidelake.llm import extraction as X
    from tidelake.llm import url_filters as U

    long = "/seg" * 3000
    page = "<article><p>" + "word " * 60_000 + "</p></article>"
    plain = [(1, f"http://h.org{long}", page), (2, None, None), (2, None, None), (3, "http://h.org/a", "<main>m</main>"), (4, "http://h.org/a", "<article>m</article>"), (None, "http://h.org/a", "")]
    df = spark.createDataFrame(plain, "page_id bigint, url string, html string")
    odd = df.selectExpr("page_id", "url", "html", "1 AS host", "2 AS path", "3 AS text", "4 AS gpath", "5 AS rejected", "6 AS template", "7 AS key", "8 AS n", "9 AS paths", "10 AS verdict", "11 AS _id")
    docs, labels = spark.createDataFrame([(1, "m", 1), (2, " m ", 2), (3, None, 3), (None, "", 4)], "doc_id bigint, text string, key int"), spark.createDataFrame([(1, 0, 5), (2, 1, 6), (3, None, 7), (None, 0, 8)], "doc_id bigint, quality int, key int")
    results = []
    for pages in (df, odd):
        labelled = U.label_pages(pages, docs, labels, [])
        assert B.counted((r.url, r.bad) for r in labelled.collect()) == B.counted([(plain[0][1], None), (None, None), (None, None), ("http://h.org/a", 1), ("http://h.org/a", 1), ("http://h.org/a", None)])
        judged = U.judge_urls(pages, *U.learn_templates(labelled), [])
        read = X.extract(pages, X.winning_paths(X.host_votes(pages)).cache())
        results.append((B.counted(judged.collect()), B.counted(read.collect())))
    assert results[0] == results[1] and sum(results[0][0].values()) == 6
    texts = Counter(t for (_, _, t), n in results[0][1].items() for _ in range(n))
    assert texts[("word " * 60_000).strip()] == 1 and texts["m"] == 2 and texts[""] == 3


@pytest.mark.parametrize("table", ["pages", "benchmark", "conversations"])
def test_other_tables_may_have_more_columns(spark, edge, tmp_path, table):
    """Columns of names that operators use change nothing."""
    import os

    for t in ("documents", "benchmark", "pages", "labels", "conversations"):
        if t != table:
            os.symlink(f"{edge}/{t}.parquet", tmp_path / f"{t}.parquet")
    names = ["_id", "key", "item", "len", "digest", "size", "host", "turns", "segments", "refers_to", "payload", "valid"]
    df = spark.read.parquet(f"{edge}/{table}.parquet")
    df.selectExpr("*", *(f"{i} AS {n}" for i, n in enumerate(names) if n not in df.columns)).write.parquet(str(tmp_path / f"{table}.parquet"))
    for name in {"pages": ["op3_warc", "op4_url_filters", "op5_html_extraction"], "benchmark": ["op6_benchmark_decontamination"], "conversations": ["op8_chat_formatting"]}[table]:
        assert B.counted(registry.queries()[name](spark, str(tmp_path)).collect()) == B.counted(registry.queries()[name](spark, edge).collect())
