"""Quality rules: base counts of a text, and the fertility of public tokenisers with rejection bands.

A text's words are encoded each by two public vocabularies: pieces with byte fallback, and byte-level pairs made for many languages.
Measured are characters per token of both, the share of byte-fallback tokens and the entropy of the text's pieces. Bands are fitted per
language (per script where the language is null) over all texts that pass the base rules: medians and quartiles from counts of rounded
values, which are sums over the whole table, few rows at any size. A text is rejected if its characters per token lie outside a band
round the median that is wider for shorter texts, its entropy is far below its language's, or its byte share is above such a band round
the median byte share and over `max_bytes`.
Every band has a value, whatever its number of texts: its median and spread lean towards those of its script, and these
towards those of all texts, the more the fewer texts there are, and what is left unknown of the median widens the band. A
language's only text is so judged by its script, with room for how far languages differ. Defaults lean to keeping: a text
inside the bands stays.

Defined results: null and empty texts have no words and fail the base rules; each row is judged, repeats too; a null language is
judged by script; other columns of the input are not returned; an empty table gives an empty result.
"""
from __future__ import annotations

import unicodedata
from array import array
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import load_ranks
from .common import Words, row_slices, tidied, utf8_parts, written

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
CACHE = 150_000
STEP = 0.005  # to which measures are rounded for the bands
WORD_TOKENS = 3.0  # root of the byte tokens of a word, which fall back together
MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_tokens bigint, n_wide_tokens bigint, chars_per_token double, chars_per_wide_token double, byte_share double, token_entropy double"


@lru_cache(4)
def _vocabularies(pieces: str, pairs: str):
    """The piece model, which of its pieces are bytes, the byte-pair encoder, and the cache of words' tokens."""
    import public_tokenizers
    import sentencepiece
    import tiktoken

    model = sentencepiece.SentencePieceProcessor(model_file=pieces)
    wide = tiktoken.Encoding("wide", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(pairs), special_tokens={})
    return model, np.array([model.is_byte(i) for i in range(model.get_piece_size())]), wide, {}


def script_of(text: str) -> str:
    """The script most letters of a text belong to, by the first word of their Unicode names."""
    if text.isascii():
        return "LATIN" if any(map(str.isalpha, text)) else "NONE"
    names: Counter[str] = Counter()
    for c, n in Counter(text).items():
        if c.isalpha():
            names[unicodedata.name(c, "OTHER").split(" ")[0]] += n
    return min(names, key=lambda k: (-names[k], k)) if names else "NONE"


def _per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated_words(words: Words, window: int = 3) -> np.ndarray:
    """For each text, its words that stand in windows found twice or more in it."""
    n, rows = len(words.ids), len(words.counts)
    if n < window:
        return np.zeros(rows, np.int64)
    m = n - window + 1
    at = np.flatnonzero(words.doc[:m] == words.doc[window - 1 :])
    key, kinds = words.doc[at], int(words.ids.max()) + 1
    for j in range(window):  # numbers of equal beginnings, so equal windows of a text have one number
        key = np.unique(key * kinds + words.ids[at + j], return_inverse=True)[1]
    at = at[np.bincount(key)[key] > 1]
    covered = np.zeros(n, bool)
    for j in range(window):
        covered[at + j] = True
    return np.bincount(words.doc[covered], minlength=rows)


def token_measures(words: Words, pieces: str, pairs: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pieces, byte-fallback pieces, entropy of pieces in bits, byte-pair tokens) of each text. A word's byte-pair tokens are those it has
    after a blank."""
    model, is_byte, wide, cache = _vocabularies(pieces, pairs)
    rows = len(words.counts)
    keys, inverse = words.distinct, words.ids
    new = [w for w in keys if w not in cache]
    if new:
        if len(cache) + len(new) > CACHE:
            cache.clear()
            new = keys
        texts = [w.decode("utf-8", "replace") for w in new]
        made = ((array("I", x).tobytes(), len(wide.encode_ordinary(" " + t))) for x, t in zip(model.encode(texts, num_threads=1), texts, strict=True))
        cache.update(zip(new, made, strict=True))
    held = [cache[w] for w in keys]
    ids = [x for x, _ in held]
    size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    wide_size = np.fromiter((n for _, n in held), np.int64, len(held))[inverse]
    flat = np.frombuffer(b"".join(ids), np.uint32).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(size)])[:-1]
    count = size[inverse]
    place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    token = flat[np.repeat(begin[inverse], count) + place]
    doc = np.repeat(words.doc, count)
    n = np.bincount(doc, minlength=rows)
    odd = np.bincount(doc[is_byte[token]], minlength=rows)
    pair, times = np.unique(doc * len(is_byte) + token, return_counts=True)
    owner = pair // len(is_byte)
    p = times / n[owner]
    entropy = np.bincount(owner, weights=-p * np.log2(p), minlength=rows)
    return n, odd, entropy, np.bincount(words.doc, weights=wide_size, minlength=rows).astype(np.int64)


def measure(df: DataFrame, pieces: str, pairs: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, band (language, or script where it is null), script and MEASURES of each row."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            column, langs = batch.column(1), batch.column(2).to_pylist()
            raw, off = utf8_parts(column)
            for i, j in row_slices(off):
                part, o = raw[off[i] : off[j]], off[i : j + 1] - off[i]
                words = Words(part, o)
                data = part.tobytes()
                chars = _per_row(words.inside & ((part & 0xC0) != 0x80), o)
                dup = []
                for a, b in zip(o[:-1].tolist(), o[1:].tolist(), strict=True):
                    lines = [x for x in data[a:b].split(b"\n") if x.strip()]
                    dup.append(len(lines) - len(set(lines)))
                n, odd, entropy, wide = token_measures(words, pieces, pairs)
                safe = np.maximum(n, 1)
                script = [script_of(data[a:b].decode()) for a, b in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)]
                band = [x if x is not None else s for x, s in zip(langs[i:j], script, strict=True)]
                cols = [words.counts, chars, _per_row(_SYMBOL[part], o), dup, repeated_words(words), n, wide]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(band, pa.string()), pa.array(script, pa.string()), *(pa.array(x, pa.int64()) for x in cols), pa.array(chars / safe), pa.array(chars / np.maximum(wide, 1)), pa.array(odd / safe), pa.array(entropy, pa.float64())],
                    [id_col, "band", "script", *(x.split()[0] for x in MEASURES.split(", "))])

    lang = F.col(lang_col).cast("string") if lang_col in df.columns else F.lit(None).cast("string")
    return df.select(id_col, text_col, lang.alias("_lang")).mapInArrow(tidied(run), f"`{id_col}` {kind}, band string, script string, {MEASURES}")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _quartiles(values: DataFrame) -> DataFrame:
    """band, total, q1, q2, q3 of values(band, value), from counts of rounded values."""
    bins = values.groupBy("band", F.round(F.col("value") / STEP).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("band").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ranked = bins.withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(Window.partitionBy("band"))})
    cut = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("bin"))) * STEP
    return ranked.groupBy("band").agg(F.max("total").alias("total"), cut(0.25).alias("q1"), cut(0.5).alias("q2"), cut(0.75).alias("q3"))


def _beside(rows: DataFrame, bands: DataFrame) -> DataFrame:
    """rows with their band's columns; bands (a row for each language) is a written table."""
    return rows.join(F.broadcast(bands) if bands.count() <= 10_000 else bands, "band", "left")


def _spread() -> Column:
    return F.greatest((F.col("q3") - F.col("q1")) / 1.349, F.lit(STEP))


def _settled(own: DataFrame, between: tuple[float, float], strength: float, share: bool = False) -> DataFrame:
    """band with centre, unsure and spread of own(band, script, total, centre, noise, spread), a row for each band.

    A band's centre is drawn towards its script's and a script's towards that of all, with weights from the noise of a text,
    the texts besides the one judged, and how far languages of a script and scripts differ (`between`, as shares of the
    centre, or of 1 for a measure that is a share itself); unsure is the standard error that is left. Spreads count as `strength` texts of the wider group besides the own."""
    script, every = Window.partitionBy("script"), Window.partitionBy(F.lit(0))
    mean = lambda c, w: F.sum(F.col("total") * F.col(c)).over(w) / F.sum("total").over(w)
    rows = own.withColumns({"script_total": F.sum("total").over(script), **{f"script_{c}": mean(c, script) for c in ("centre", "noise", "spread")},
                            **{f"all_{c}": mean(c, every) for c in ("centre", "noise", "spread")}})
    lean = lambda n, c, wider: (F.col(n) * F.col(c) + strength * wider) / (F.col(n) + strength)

    def draw(n: str, c: str, noise: Column, wider: Column, variance: Column) -> tuple[Column, Column]:
        weight = (F.col(n) - 1) / (F.col(n) - 1 + noise * noise / variance)
        return weight * F.col(c) + (1 - weight) * wider, (1 - weight) * variance

    script_noise = lean("script_total", "script_noise", F.col("all_noise"))
    centre, variance = draw("script_total", "script_centre", script_noise, F.col("all_centre"), F.pow(between[1] * (F.lit(1.0) if share else F.col("all_centre")), 2))
    noise = lean("total", "noise", script_noise)
    centre, variance = draw("total", "centre", noise, centre, variance + F.pow(between[0] * (F.lit(1.0) if share else centre), 2))
    return rows.select("band", centre.alias("centre"), F.sqrt(variance).alias("unsure"), lean("total", "spread", lean("script_total", "script_spread", F.col("all_spread"))).alias("spread"))


def fit_bands(measured: DataFrame, between: tuple[float, float] = (0.1, 0.5), strength: float = 20.0) -> DataFrame:
    """band with median, unsure (the median's standard error) and spread of the four measures, for every band with a text that passes
    the base rules. The spreads of characters per token and byte share are those at one token (they fall with the root of a text's tokens)."""
    good = measured.where(~base_failed())
    most = F.max_by("script", F.struct("n", F.xxhash64("script").alias("h"))).alias("script")
    scripts = written(good.groupBy("band", "script").agg(F.count(F.lit(1)).alias("n")).groupBy("band").agg(most), "scripts")

    def quartiles(c: str) -> DataFrame:
        made = _quartiles(good.select("band", F.col(c).alias("value"))).select("band", "total", F.col("q2").alias("centre"), _spread().alias("noise"))
        return written(made, "medians")

    def settled(own: DataFrame, name: str, share: bool = False) -> DataFrame:
        made = _settled(own.join(scripts, "band"), between, strength, share)
        return made.select("band", F.col("centre").alias(f"{name}_median"), F.col("unsure").alias(f"{name}_unsure"), F.col("spread").alias(f"{name}_spread"))

    def at_one_token(c: str, tokens: str = "n_tokens") -> DataFrame:
        own = quartiles(c)
        off = _beside(good, own).select("band", ((F.col(c) - F.col("centre")) * F.sqrt(tokens)).alias("value"))
        return own.join(_quartiles(off).select("band", _spread().alias("spread")), "band")

    entropy = quartiles("token_entropy").withColumn("spread", F.col("noise"))
    made = settled(at_one_token("chars_per_token"), "chars").join(settled(entropy, "entropy"), "band")
    made = made.join(settled(at_one_token("chars_per_wide_token", "n_wide_tokens"), "wide"), "band")
    return made.join(settled(at_one_token("byte_share"), "bytes", share=True), "band")


def judge(df: DataFrame, pieces: str, pairs: str, width: float = 4.0, margin: float = 0.03, wide_width: float = 3.5, wide_margin: float = 0.01,
          entropy_width: float = 5.0, max_bytes: float = 0.3, id_col: str = "doc_id", **names) -> DataFrame:
    """measure(df) with base_failed, kept and the reasons of a rejection. pieces: a piece vocabulary with byte fallback; pairs: ranks of
    a byte-level one.

    Characters per token may differ from the median by margin * median + width * sqrt(spread ** 2 / tokens + unsure ** 2), and those of
    the second vocabulary by the like. Byte share may be over the median by the like, its spread at least that of whole words drawn at
    random, and up to max_bytes anywhere."""
    measured = written(measure(df, pieces, pairs, id_col=id_col, **names), "fertility")
    out = _beside(measured, written(fit_bands(measured), "bands")).withColumn("base_failed", base_failed())
    room = lambda spread, unsure, tokens="n_tokens": F.sqrt(F.pow(spread, 2) / F.greatest(F.col(tokens), F.lit(1)) + F.pow(F.col(unsure), 2))

    def far(measure: str, band: str, tokens: str, margin: float, width: float) -> Column:
        median = F.col(f"{band}_median")
        return F.abs(F.col(measure) - median) > margin * median + width * room(F.col(f"{band}_spread"), f"{band}_unsure", tokens)

    drawn = WORD_TOKENS * F.sqrt(F.col("bytes_median") * F.greatest(1 - F.col("bytes_median"), F.lit(0.0)))
    most = F.col("bytes_median") * (1 + margin) + width * room(F.greatest("bytes_spread", drawn), "bytes_unsure")
    flat = F.col("token_entropy") < F.col("entropy_median") - entropy_width * F.sqrt(F.pow("entropy_spread", F.lit(2)) + F.pow("entropy_unsure", F.lit(2)))
    reasons = F.array_compact(F.array(
        F.when(F.col("base_failed"), "base"), F.when(far("chars_per_token", "chars", "n_tokens", margin, width), "chars_per_token"),
        F.when(far("chars_per_wide_token", "wide", "n_wide_tokens", wide_margin, wide_width), "chars_per_wide_token"), F.when(flat, "token_entropy"),
        F.when(F.col("byte_share") > F.greatest(F.lit(max_bytes), most), "byte_share")))
    return out.withColumn("reasons", reasons).withColumn("kept", F.size("reasons") == 0)
