"""URL filters: explicit rules, and a tree of path templates per host judged by labelled purity.

Learning works on the table of distinct (host, lexically generalised path), aggregated first, so a hot host or a hot path
is a few rows there. Level by level the segments below one (host, template so far) become the wildcard `*` unless they
have min_count urls and their labelled share of bad pages differs from that of their siblings
together (a z test): variable segments and statistically similar branches merge. The loop ends at the level that no branch reaches with
min_count urls; all below it are wildcards. A template is rejected if it has min_bad bad labels and its
share of them, smoothed towards the prior of all labels, is over max_bad.

A page's label (`label_pages`) is the verdict of the explicit rule that fits it, a weak label; else that of the labelled documents that
have the same words as its article.

Defined results: a null url or one without :// has host and path ""; a null label counts as unlabelled, and documents of equal words with
different labels count as bad; null and empty html or texts have no label; repeated rows are
judged each; an empty table gives an empty result. Other columns of the input are not returned, so they may have any name.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, join_counted, written

WILD = "*"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty without ://."""
    rx = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, rx, i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def general_path(path: Column) -> Column:
    """Segments with long hexadecimal ids become {x}; runs of digits become {n}."""
    path = F.regexp_replace(path, r"(?<=/)(?=[0-9a-fA-F-]*[0-9])[0-9a-fA-F-]{12,}(?=/|\z)", "{x}")
    return F.regexp_replace(path, r"[0-9]+", "{n}")


def words_key(text: Column) -> Column:
    """A digest of a text's words; null without words."""
    plain = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    return F.when(plain != "", F.md5(plain))


def article_key(html: Column) -> Column:
    """words_key of a page's first article (or of the whole page) without its level-one heading. Tags are cut off at `<` and `>`, so the time
    grows with the page's length whatever its markup; that is good enough to find equal texts."""
    inner = lambda x, rx, at, none: F.when(F.regexp_instr(x, F.lit(rx)) > 0, at(F.regexp_instr(x, F.lit(rx)))).otherwise(none)
    tail = inner(html, r"(?i)<article\b", lambda i: F.substr(html, i), html)
    body = inner(tail, r"(?i)</article\b", lambda i: F.substr(tail, F.lit(1), i - 1), tail)
    text = lambda x: F.when(F.rlike(x, F.lit(r"(?i)\A(h1|script|style)\b")), "").otherwise(F.substr(x, F.locate(">", x) + 1))
    plain = F.array_join(F.transform(F.split(body, "<"), text), " ")
    for sign, code in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"), ("\u00a0", "&nbsp;"), ("&", "&amp;")):
        plain = F.replace(plain, F.lit(code), F.lit(sign))
    return words_key(plain)


def label_pages(pages: DataFrame, docs: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url", html_col: str = "html",
                doc_id: str = "doc_id", text_col: str = "text", bad: Column | None = None) -> DataFrame:
    """url, bad (1, 0 or null), weak (a rule gave it) of each page. bad: of a row of labels, by default quality = 0."""
    bad = F.col("quality") == 0 if bad is None else bad
    told = labels.select(F.col(doc_id).alias("_id"), bad.cast("int").alias("_bad")).where("_bad IS NOT NULL")
    keyed = docs.select(F.col(doc_id).alias("_id"), words_key(F.col(text_col)).alias("key")).join(told, "_id").where("key IS NOT NULL")
    known = keyed.groupBy("key").agg(F.max("_bad").alias("content"))
    host, path = url_parts(F.col(url_col))
    rows = written(pages.select(F.col(url_col).alias("url"), (rule_of(host, path, rules)["action"] == "block").cast("int").alias("ruled"), article_key(F.col(html_col)).alias("key")), "page-keys")
    met = rows.where("ruled IS NULL").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    known = written(known.join(met, "key"), "text-labels")
    free = join_counted(rows.where("ruled IS NULL"), known, ["key"])
    return free.select("url", F.col("content").alias("bad"), F.lit(False).alias("weak")).unionByName(
        rows.where("ruled IS NOT NULL").select("url", F.col("ruled").alias("bad"), F.lit(True).alias("weak")))


def learn_templates(urls: DataFrame, url_col: str = "url", bad_col: str = "bad", min_count: int = 8,
                    z: float = 1.96, strength: float = 10.0, max_bad: float = 0.5, min_bad: int = 3) -> tuple[DataFrame, DataFrame]:
    """(paths, templates) of urls whose bad_col is 1, 0 or null (unlabelled).

    paths: host, gpath, n, template. templates: host, template, n_urls, n_labelled, n_bad, bad_rate, rejected."""
    host, path = url_parts(F.col(url_col))
    bad = F.col(bad_col)
    flat = urls.select(host.alias("host"), general_path(path).alias("gpath"), bad.cast("int").alias("bad"))
    tree = flat.groupBy("host", "gpath").agg(
        F.count(F.lit(1)).alias("n"), F.count("bad").alias("l"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b"))
    tree = written(tree.withColumns({"segments": F.split("gpath", "/"), "template": F.lit("")}), "url-tree")
    d = 1  # segment 0 is what stands before the first slash
    while True:
        seg = F.get("segments", F.lit(d))
        inner = tree.where(seg.isNotNull()).withColumn("segment", seg)
        branches = inner.groupBy("host", "template", "segment").agg(F.sum("n").alias("n"), F.sum("l").alias("l"), F.sum("b").alias("b"), F.count(F.lit(1)).alias("rows"))
        pools = branches.groupBy("host", "template").agg(F.sum("n").alias("pn"), F.sum("l").alias("pl"), F.sum("b").alias("pb"))
        if (pools.agg(F.max("pn")).first()[0] or 0) < min_count:
            break
        p = F.try_divide("pb", "pl")
        differs = F.abs(F.try_divide("b", "l") - p) > z * F.sqrt(p * F.try_divide(1 - p, F.col("l")))
        kept = branches.join(pools, ["host", "template"]).where((F.col("n") >= min_count) & F.coalesce(differs, F.lit(False))).select(
            "host", "template", "segment", F.lit(True).alias("literal"), "rows")
        named = F.coalesce(F.when(F.col("literal"), F.col("segment")), F.lit(WILD))
        tree = (  # a segment may hold most paths of a large host
            join_counted(tree.withColumn("segment", seg), written(kept, "url-kept"), ["host", "template", "segment"], n="rows")
            .withColumn("template", F.when(F.col("segment").isNull(), F.col("template")).otherwise(F.concat_ws("/", "template", named)))
            .select("host", "gpath", "n", "l", "b", "segments", "template")
        )
        tree = written(tree, "url-tree")  # each level reads the one above twice
        d += 1
    rest = F.repeat(F.lit("/" + WILD), F.greatest(F.size("segments") - d, F.lit(0)))
    paths = written(tree.select("host", "gpath", "n", "l", "b", F.concat("template", rest).alias("template")), "url-paths")
    prior = min(paths.agg(F.try_divide(F.sum("b") + 1, F.sum("l") + 2)).first()[0] or 0.0, max_bad)  # the prior alone rejects nothing
    rate = (F.col("n_bad") + F.lit(strength * prior)) / (F.col("n_labelled") + F.lit(strength))
    templates = paths.groupBy("host", "template").agg(
        F.sum("n").alias("n_urls"), F.sum("l").alias("n_labelled"), F.sum("b").alias("n_bad")
    ).withColumn("bad_rate", rate).withColumn("rejected", (F.col("bad_rate") > max_bad) & (F.col("n_bad") >= min_bad))
    return paths.select("host", "gpath", "n", "template"), templates


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest (action, host, path) rule that fits, as a struct of rule and action; else null."""
    found = None
    for action, h, p in sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), r[1:])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,action:string>")


def judge_urls(pages: DataFrame, paths: DataFrame, templates: DataFrame, rules: list[tuple[str, str, str]],
               id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict, template, template_rejected of each row: the rule's verdict, else the template's."""
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"), general_path(path).alias("gpath"))
    known = written(paths.join(templates.select("host", "template", "rejected"), ["host", "template"]), "url-verdicts")
    hit = rule_of(F.col("host"), F.col("path"), rules)
    return join_counted(rows, known, ["host", "gpath"]).withColumn("hit", hit).select(
        id_col, "host", "path", F.col("hit.rule").alias("rule"),
        F.coalesce("hit.action", F.when(F.col("rejected"), "block"), F.lit("allow")).alias("verdict"), "template", F.col("rejected").alias("template_rejected"))
