"""Substring dedup: spans of words that occur earlier in the corpus are removed.

A window is `window` consecutive words of one document; a word goes if a window that covers it starts earlier elsewhere
(smaller id, or the same document and an earlier start). Comparing each document with each reference shard grows with the
square of the corpus, so documents meet only the shards that can match:

1. Anchors. Each window's anchor is its k-gram of least hash, so equal windows have equal anchors. Windows in a row with
   the same anchor form a chunk (about one for eight words). A chunk equal to an earlier chunk is removed whole; most
   repeats end here. Equal means an equal 128-bit BLAKE2 digest of the words. Chunks are dealt by anchor and digest, so an
   anchor that stands in ever different chunks goes to many tasks; equal chunks of one batch are folded before the shuffle,
   so a passage that many documents share is a few rows. A task holds one row at a time.
2. Reference shards. Where one anchor stands in different chunks (the rims of passages, edits in near copies), the first
   of each different chunk makes the shard of that anchor. A suffix automaton over the words themselves is grown in document
   order; each chunk is streamed through it for matching statistics before it is added, and its maximal matches of `window`
   words or more are removed. A shard holds SHARD_CHUNKS chunks at most. Anchors with more (a very common passage among
   ever different neighbours) go another exact way, so that no task gathers them: digests of their windows, the first place
   of each from a grouped minimum, and a join back. Both ways remove the same words.

Defined results: null and empty texts have no words and nothing removed; the id names the document, and repeated rows of
one id (with one text) aren't earlier than each other; a null id sorts first. An empty table gives an empty result.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, digests, fresh, gram_hashes, mix, row_slices, tidied, utf8_parts, written

K = 6
#: Bits of a chunk's row that hold a place of the anchor in its window.
PLACE_BITS = 8
SHARD_CHUNKS = 256
#: Most keys of crowded anchors that are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 300_000
_LEAST = -(1 << 63)


def chunks_of(words: Words, window: int, k: int = K) -> tuple[np.ndarray, ...]:
    """(row, first window's start, last window's start, anchor, two halves of the digest) of each chunk; starts count words from the row's first."""
    n = len(words.hash)
    m = max(0, n - window + 1)
    valid = np.flatnonzero(words.doc[:m] == words.doc[n - m :])
    if not len(valid):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    g = gram_hashes(words.hash, k)
    spread = window - k + 1
    low = np.uint64((1 << PLACE_BITS) - 1)
    high = g & ~low
    best = high[:m].copy()
    for j in range(1, spread):
        np.minimum(best, high[j : j + m] | np.uint64(j), out=best)
    at = np.arange(m) + (best & low).astype(np.int64)
    at, doc = at[valid], words.doc[valid]
    new = np.ones(len(valid), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(valid)) - 1
    lo, hi = valid[first], valid[last]
    base = np.concatenate([[0], np.cumsum(words.counts)])[doc[first]]
    text, place = words.spaced()
    content = digests(text, place[lo], place[hi + window])
    return doc[first], lo - base, hi - base, g[at[first]].view(np.int64), content[:, 0], content[:, 1]


def _chunk_rows(window: int):
    """(key, c1, c2, id, span) of a batch's chunks; span: start << 9 | (last start - start) << 1 | known to be a repeat."""

    def run(batches):
        for batch in batches:
            ids = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
            raw, off = utf8_parts(batch.column(1))
            parts = []
            for i, j in row_slices(off):
                row, lo, hi, anchor, c1, c2 = chunks_of(Words(raw[off[i] : off[j]], off[i : j + 1] - off[i]), window)
                parts.append((anchor, c1, c2, ids[i + row], lo, hi - lo))
            if not parts:
                continue
            key, c1, c2, doc, lo, more = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((lo, doc, c2, c1, key))
            key, c1, c2, doc, lo, more = (x[order] for x in (key, c1, c2, doc, lo, more))
            again = np.zeros(len(doc), bool)
            again[1:] = (key[1:] == key[:-1]) & (c1[1:] == c1[:-1]) & (c2[1:] == c2[:-1])
            twin = np.zeros(len(doc), bool)
            twin[1:] = again[1:] & (doc[1:] == doc[:-1]) & (lo[1:] == lo[:-1])
            # a known repeat goes anywhere
            c1 = np.where(again, mix(doc.view(np.uint64) ^ lo.astype(np.uint64)).view(np.int64), c1)
            span = lo << PLACE_BITS + 1 | more << 1 | again
            yield pa.RecordBatch.from_arrays([pa.array(x[~twin]) for x in (key, c1, c2, doc, span)], ["key", "c1", "c2", "id", "span"])

    return run


def _sift(batches):
    """From chunks sorted by key, digest, id and start: (id, start, last, key, first) of all but the repeated rows of one place;
    first tells the first of each different chunk from its repeats."""
    before = None  # key, c1, c2 of the row before; id and start of the first that was equal to it
    for batch in batches:
        key, c1, c2, doc, span = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        if not len(key):
            continue
        known = (span & 1) == 1
        lo = span >> PLACE_BITS + 1
        same = np.zeros(len(key), bool)
        same[1:] = (key[1:] == key[:-1]) & (c1[1:] == c1[:-1]) & (c2[1:] == c2[:-1]) & ~known[1:] & ~known[:-1]
        if before is not None and not known[0]:
            same[0] = (int(key[0]), int(c1[0]), int(c2[0])) == before[:3]
        lead = np.maximum.accumulate(np.where(same, -1, np.arange(len(key))))
        led = lead >= 0
        head_doc, head_lo = np.where(led, doc[lead], before[3] if before else 0), np.where(led, lo[lead], before[4] if before else 0)
        twin = same & (doc == head_doc) & (lo == head_lo)
        before = (int(key[-1]), int(c1[-1]), int(c2[-1]), int(head_doc[-1]), int(head_lo[-1])) if not known[-1] else None
        keep = ~twin
        last = lo + (span >> 1 & (1 << PLACE_BITS) - 1)
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (doc, lo, last, key, ~same & ~known)], ["id", "start", "last", "key", "first"])


class SuffixAutomaton:
    """Of word sequences added one after another; matching statistics against all that were added."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.len = [-1], [0]

    def add(self, words) -> None:
        nxt, link, length = self.next, self.link, self.len
        last = 0
        for w in words:
            if (q := nxt[last].get(w)) is not None:  # a sequence added before begins so
                if length[q] == length[last] + 1:
                    last = q
                    continue
                last = self._clone(last, w, q)
                continue
            cur = len(nxt)
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p != -1 and w not in nxt[p]:
                nxt[p][w] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][w]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
            last = cur

    def _clone(self, p: int, w, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        c = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = c
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = c
            p = link[p]
        return c

    def matches(self, words) -> list[int]:
        """For each word, the length of the longest match that ends with it."""
        out, v, n = [], 0, 0
        for w in words:
            while v and w not in self.next[v]:
                v = self.link[v]
                n = self.len[v]
            if (to := self.next[v].get(w)) is not None:
                v, n = to, n + 1
            else:
                n = 0
            out.append(n)
        return out


class Shard:
    """The reference shard of one anchor."""

    def __init__(self, window: int):
        self.window, self.automaton = window, SuffixAutomaton()

    def spans(self, words: list) -> list[tuple[int, int]]:
        """Maximal spans of `words` that earlier chunks hold; then adds the chunk."""
        spans: list[tuple[int, int]] = []
        for end, n in enumerate(self.automaton.matches(words), 1):
            if n >= self.window:
                while spans and end - n <= spans[-1][1]:
                    n = max(n, end - spans.pop()[0])
                spans.append((end - n, end))
        self.automaton.add(words)
        return spans


def _match(window: int):
    """From rim chunks sorted by key, id and start: (id, start, end) of the spans that an earlier chunk of the key holds."""

    def run(batches):
        shard, of = None, None
        for batch in batches:
            ids, starts, ends = [], [], []
            for key, doc, start, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if key != of:
                    shard, of = Shard(window), key
                for a, b in shard.spans(text.split()):
                    ids.append(doc)
                    starts.append(start + a)
                    ends.append(start + b)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["id", "start", "end"])

    return run


def _windows(window: int):
    """(h1, h2, id, start) of each window of the chunks of crowded anchors; h1 and h2 are its digest."""

    def run(batches):
        for batch in batches:
            raw, off = utf8_parts(batch.column(3))
            ids, starts = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            for i, j in row_slices(off):
                words = Words(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                m = max(0, len(words.hash) - window + 1)
                at = np.flatnonzero(words.doc[:m] == words.doc[len(words.hash) - m :])
                first = np.concatenate([[0], np.cumsum(words.counts)])[words.doc[at]]
                text, place = words.spaced()
                made = digests(text, place[at], place[at + window])
                row = i + words.doc[at]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (made[:, 0], made[:, 1], ids[row], starts[row] + at - first)], ["h1", "h2", "id", "start"])

    return run


def _rim_texts(window: int):
    def run(batches):
        for batch in batches:
            keys, ids, starts, texts, crowded = [], [], [], [], []
            for doc, text, rims in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words = text.split()
                for r in rims:
                    keys.append(r["key"])
                    ids.append(doc)
                    starts.append(r["start"])
                    texts.append(b" ".join(words[r["start"] : r["last"] + window]))
                    crowded.append(r["crowded"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(texts, pa.binary()), pa.array(crowded, pa.bool_())],
                ["key", "id", "start", "words", "crowded"])

    return run


def _cut(batches):
    """From id, text, spans: id, counts and the words outside the spans, joined by one space."""
    for batch in batches:
        kept, n_words, n_removed, ids = [], [], [], batch.column(0)
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = (text or b"").split()
            n, at, out = len(words), 0, []
            for s in sorted((s["start"], s["end"]) for s in spans or ()):
                out += words[at : s[0]]
                at = max(at, s[1])
            out += words[at:]
            kept.append(b" ".join(out))
            n_words.append(n)
            n_removed.append(n - len(out))
        yield pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())], ["_id", "n_words", "n_removed", "kept"])


def removed_spans(docs: DataFrame, window: int, partitions: int) -> tuple[DataFrame, DataFrame]:
    """(docs dealt by id, spans to remove) of docs(_id bigint, _text string)."""
    chunks = docs.mapInArrow(tidied(_chunk_rows(window)), "key bigint, c1 bigint, c2 bigint, id bigint, span bigint")
    sifted = written(chunks.repartition("key", "c1").sortWithinPartitions("key", "c1", "c2", "id", "span").mapInArrow(
        tidied(_sift), "id bigint, start bigint, last bigint, key bigint, first boolean"), "chunks")
    # anchors of several different chunks; counts combine before the shuffle, whatever an anchor's number of chunks
    shards = written(sifted.where("first").groupBy(F.col("key").alias("ckey")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shards")
    few = F.broadcast(shards) if shards.count() <= BROADCAST_ROWS else shards
    rims = sifted.where("first").join(few, F.col("key") == F.col("ckey"))
    rims = rims.groupBy(F.col("id").alias("rid")).agg(F.collect_list(F.struct("key", "start", "last", (F.col("n") > SHARD_CHUNKS).alias("crowded"))).alias("rims"))
    dealt = docs.select("_id", F.col("_text").cast("binary").alias("_text")).repartition(partitions, "_id")
    texts = dealt.join(rims, F.col("_id") == F.col("rid")).select("_id", "_text", "rims").mapInArrow(
        tidied(_rim_texts(window)), "key bigint, id bigint, start bigint, words binary, crowded boolean")
    texts = written(texts.dropDuplicates(["key", "id", "start"]), "rims")
    matched = texts.where("NOT crowded").select("key", "id", "start", "words").repartition("key").sortWithinPartitions("key", "id", "start").mapInArrow(
        tidied(_match(window)), "id bigint, start bigint, end bigint")
    places = texts.where("crowded").select("key", "id", "start", "words").mapInArrow(tidied(_windows(window)), "h1 bigint, h2 bigint, id bigint, start bigint")
    places = written(places, "windows")
    firsts = places.groupBy(F.col("h1").alias("f1"), F.col("h2").alias("f2")).agg(F.min(F.struct("id", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = places.join(firsts, (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2"))).where(F.struct("id", "start") > F.col("first"))
    matched = matched.unionByName(later.select("id", "start", (F.col("start") + window).alias("end")))
    whole = sifted.where("NOT first").select("id", "start", (F.col("last") + window).alias("end"))
    return dealt, whole.unionByName(matched)


def dedup_substrings(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """id, n_words, n_removed, kept (the words that stay, joined by one space; string) of each row of docs."""
    if not K <= window < K + (1 << PLACE_BITS):
        raise ValueError(f"a window has {K} to {K + (1 << PLACE_BITS) - 1} words")
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST)).alias("_id"), F.col(text_col).alias("_text"))
    dealt, spans = removed_spans(base, window, n)
    per_doc = spans.groupBy(F.col("id").alias("sid")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    made = dealt.join(per_doc, F.col("_id") == F.col("sid"), "left").select("_id", "_text", "spans").mapInArrow(
        tidied(_cut), "_id bigint, n_words bigint, n_removed bigint, kept binary")
    return made.select(F.when(F.col("_id") != _LEAST, F.col("_id")).alias(id_col), "n_words", "n_removed", F.col("kept").cast("string").alias("kept"))


def without_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without repeated spans: a text that loses words is what stays, joined by one space; a row that loses all is dropped.
    All other columns pass through."""
    own, kept, gone = (fresh(c, docs.columns) for c in ("_cut_id", "_kept", "_gone"))
    cut = dedup_substrings(docs, window, id_col, text_col).where("n_removed > 0").select(
        F.col(id_col).alias(own), F.col("kept").alias(kept), (F.col("n_removed") == F.col("n_words")).alias(gone))
    cut = written(cut.dropDuplicates([own]), "cut")
    joined = docs.join(cut, F.col(id_col).eqNullSafe(F.col(own)), "left").where(~F.coalesce(F.col(gone), F.lit(False)))
    return joined.withColumn(text_col, F.coalesce(F.col(kept), F.col(text_col))).select(*[F.col(f"`{c}`") for c in docs.columns])
