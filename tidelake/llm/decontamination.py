"""Benchmark decontamination by winnowing.

A fingerprint is the least k-gram hash of each run of `spread` grams; any shared span of window = k + spread - 1 words
holds a whole run in both texts, so both keep the same least gram: no shared window is missed. Documents' fingerprints
meet the benchmark's in a join (broadcast only if the benchmark's table is within a checked number of rows), and hits are
extended: every window around a common gram is compared with the benchmark's windows, word by word.

Items of fewer words than a window are one window of their own length; for these the gram is the whole item.

Defined results: null and empty texts have no words, are never hit and contaminate nothing; repeated rows of documents are
judged each; repeated benchmark rows count once by id, and a null item_id stands as the string "null"; an empty benchmark
hits nothing. All other columns pass through `decontaminate`; `contamination` returns the id and its own columns.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, fresh, written

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Most rows of a table that is broadcast, and most bytes of its columns that have no fixed size.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
_POS = 22  # bits of a fingerprint that hold the position, modulo 2**22


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z only) words; null has none."""
    ascii_only = F.length(text) == F.octet_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.array_remove(F.split(lowered, SEPARATORS), ""), F.array().cast("array<string>"))


def _small(table: DataFrame, wide: Column | None = None) -> DataFrame:
    """table, to be broadcast if its rows, and the bytes of its columns of no fixed size (wide), are within the bounds; else joined by shuffle."""
    n, size = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.lit(0) if wide is None else wide), F.lit(0))).first()
    return F.broadcast(table) if n <= BROADCAST_ROWS and size <= BROADCAST_BYTES else table


def _upto(n: Column, make) -> Column:
    """make(i) for i = 1 .. n; empty if n < 1."""
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), make)).otherwise(F.array().cast("array<bigint>"))


def gram(words: Column, i: Column, k: int) -> Column:
    """Hash of k words from i on, in the upper bits, and i modulo 2**22 below."""
    h = F.shiftleft(F.xxhash64(F.slice(words, i, F.lit(k))), _POS)
    return h.bitwiseOR(i.cast("long").bitwiseAND(F.lit((1 << _POS) - 1)))


def fingerprints(grams: str, spread: int) -> Column:
    """The winnowed ones of an array column of grams (as gram() packs them)."""
    return F.array_distinct(_upto(F.size(grams) - (spread - 1), lambda i: F.array_min(F.slice(grams, i, F.lit(spread)))))


def _fingerprinted(df: DataFrame, window: int, spread: int, out: str) -> DataFrame:
    k = window - spread + 1
    return df.withColumn("_grams", _all_grams("_words", k)).withColumn(out, fingerprints("_grams", spread)).drop("_grams")


def _all_grams(words: str, k: int) -> Column:
    """Every gram of k words."""
    return _upto(F.size(words) - (k - 1), lambda i: gram(F.col(words), i, k))


def _marked(marks: Column, length: int) -> Column:
    return F.transform(marks, lambda m: F.struct(F.lit(length).alias("len"), m.alias("m")))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, spread: int = 7, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", min_share: int = 20) -> DataFrame:
    """id, n_words, n_hit, items (sorted array of item ids as strings) of each row of docs, and contaminated:
    n_hit > 0 and min_share * n_hit >= n_words."""
    k = window - spread + 1
    items = written(
        benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), words_of(F.col(item_text)).alias("_words"))
        .where(F.size("_words") > 0), "bench")
    span = F.least(F.size("_words"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("_words") - span + 1)
    windows = items.withColumn("i", F.explode(starts)).select(
        span.alias("len"), F.array_join(F.slice("_words", F.col("i"), span), " ").alias("key"), "item").distinct()
    windows = written(windows, "bench-windows")
    short = sorted(r[0] for r in items.where(F.size("_words") < window).select(F.size("_words")).distinct().collect())  # under `window` numbers
    long_marks = _fingerprinted(items.where(F.size("_words") >= window), window, spread, "marks").select(
        F.lit(window).alias("len"), F.explode("marks").alias("m"))
    short_marks = items.where(F.size("_words") < window)
    marks = long_marks
    for n in short:
        marks = marks.unionByName(short_marks.where(F.size("_words") == n).select(F.lit(n).alias("len"), gram(F.col("_words"), F.lit(1), n).alias("m")))
    marks = written(marks.select("len", F.shiftright("m", _POS).alias("g")).distinct(), "bench-marks")

    base = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_t"), words_of(F.col(text_col)).alias("_words"))
    kinds = [_marked(F.col("_f"), window)] + [_marked(_all_grams("_words", n), n) for n in short]
    grams = _fingerprinted(base, window, spread, "_f").select("_id", "_t", F.explode(F.concat(*kinds) if short else kinds[0]).alias("x"))
    met = grams.select("_id", "_t", F.col("x.len").alias("len"), F.col("x.m").alias("m"), F.shiftright("x.m", _POS).alias("g")).join(_small(marks), ["len", "g"])
    spots = met.groupBy("_id", "_t").agg(F.collect_set(F.struct("len", F.col("m").bitwiseAND(F.lit((1 << _POS) - 1)).cast("int").alias("p"))).alias("spots"))
    spots = written(spots.withColumnsRenamed({"_id": "_sid", "_t": "_st"}), "doc-spots")

    n = F.size("_words")

    def around(s: Column) -> Column:
        """Possible windows (start, len) whose gram is at s.p; positions repeat every 2**22 words."""
        first, last = n - n + 1, n - s["len"] + 1
        at = F.filter(F.sequence(s["p"], F.greatest(n, s["p"]), F.lit(1 << _POS)), lambda p: (p >= 1) & (p <= n))
        reach = F.when(s["len"] == window, F.lit(window - k)).otherwise(F.lit(0))
        return F.flatten(F.transform(at, lambda p: F.transform(F.filter(F.sequence(p - reach, p), lambda i: (i >= first) & (i <= last)), lambda i: F.struct(i.alias("i"), s["len"].alias("len")))))

    spotted = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_t"), F.col(text_col).alias("_text")).join(
        _small(spots, 16 * F.size("spots")), F.col("_id").eqNullSafe(F.col("_sid")) & (F.col("_t") == F.col("_st")), "left"
    ).select("_id", "_t", words_of(F.col("_text")).alias("_words"), "spots")
    looked = spotted.select("_id", "_t", n.cast("long").alias("n_words"), F.when(F.col("spots").isNotNull(), F.transform(
        F.array_distinct(F.flatten(F.transform("spots", around))),
        lambda w: F.struct(w["i"].alias("i"), w["len"].alias("len"), F.array_join(F.slice("_words", w["i"], w["len"]), " ").alias("key")))).alias("tried"))
    looked = written(looked, "doc-windows")
    hits = looked.where(F.col("tried").isNotNull()).select("_id", "_t", "tried").distinct().select("_id", "_t", F.explode("tried").alias("w")).select(
        "_id", "_t", F.col("w.i").alias("i"), F.col("w.len").alias("len"), F.col("w.key").alias("key")).join(_small(windows, F.octet_length("key") + F.octet_length("item")), ["len", "key"])
    per_doc = hits.groupBy("_id", "_t").agg(
        F.array_sort(F.collect_set(F.struct("i", "len"))).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, x: F.struct(F.greatest(a["end"], x["i"] + x["len"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["i"] + x["len"] - F.greatest(x["i"], a["end"]))).alias("n")))
    per_doc = per_doc.select(F.col("_id").alias("_hid"), F.col("_t").alias("_ht"), covered["n"].cast("long").alias("n_hit"), "items")
    return looked.join(per_doc, F.col("_id").eqNullSafe(F.col("_hid")) & (F.col("_t") == F.col("_ht")), "left").select(
        F.col("_id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("_t").alias("text_hash"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(min_share) * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the rows that the benchmark contaminates, with all their columns."""
    own, text = (fresh(c, docs.columns) for c in ("_bad_id", "_bad_text"))
    bad = contamination(docs, benchmark, id_col=id_col, text_col=text_col, **options).where("contaminated").select(
        F.col(id_col).alias(own), F.col("text_hash").alias(text)).distinct()
    bad = written(bad, "contaminated")
    return docs.join(_small(bad, F.coalesce(F.octet_length(F.col(own).cast("string")), F.lit(0))), F.col(id_col).eqNullSafe(F.col(own)) & (F.xxhash64(F.col(text_col)) == F.col(text)), "left_anti")
