"""Best-fit packing: token pieces into as few sequences of a fixed capacity as can be found, after a dominance reduction.

Documents become token ids with an end id; those over the capacity are cut into pieces of it. Packing needs the lengths only, and how
many pieces have each: a histogram of `capacity` numbers at any size of the corpus. On it

1. Martello and Toth's reduction fixes sets that dominate all others: the longest piece left, j, with (a) the piece that fills the
   sequence, or (b) the longest piece that fits, if no two fit beside j or if no two beside j are longer together, or (c) the two that are longest
   together, if any other two beside j are, one by one, no longer than these, or (d) nothing, if nothing fits. Some best packing holds such a
   set, so it is fixed for good, as many times as there are pieces for it; this repeats until nothing is fixed.
2. What is left is packed best-fit, longest first, all equal pieces in one step: groups of like sequences are filled, not single ones.

The plan is a table of slots (length, first rank, sequence, offset), whose number depends on the capacity, not on the corpus. Pieces are
ranked within their length: each partition numbers its own in passing, and sums of the partitions' counts shift the numbers. A
piece finds its slot by its rank, without a shuffle by length; so no length, however frequent, goes to one task.

Token ids are those of the whole text: words between ASCII white space, with A-Z lower-cased (which the vocabulary does itself), have ids of
their own, so each different word is encoded once and kept in a bounded cache; it goes through the public library, or straight to its merges where
the word has printable ASCII signs and Latin-1 letters only.

Defined results: a null or empty text is one piece of the end id; repeated rows are documents of their own, each packed; a null id stays
null; other columns of documents aren't returned by `token_pieces`, and pass through `pack`, whose own columns sequence_id and offset may not be there
before (ValueError); an empty table gives an empty result; a text of any length is encoded whole.
"""
from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, row_slices, tidied, utf8_parts, written

CAPACITY = 4096
CACHE = 600_000
_CACHED_BYTES = 48  # longer words are rare and encoded each time
_RANK_BITS = 44


#: The vocabulary's pattern, as it cuts lower-case words of printable ASCII signs and Latin-1 letters.
_PLAIN = re.compile("[!-~\u00df-\u00f6\u00f8-\u00ff]+")
_CAPITALS = re.compile("[\u00c0-\u00d6\u00d8-\u00de]")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")


def _byte_signs() -> dict[int, str]:
    """The sign that stands for each byte in byte-level vocabularies: its own if printable in Latin-1, else the next from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(own)))}


@lru_cache(2)
def _tokenizer(path: str):
    """The tokenizer, its merges by themselves, the signs of two-byte letters, and a cache of words' ids."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # a text that holds their strings holds ordinary text
    signs = _byte_signs()
    return t, t.model, {c: "".join(signs[b] for b in chr(c).encode()) for c in range(0xDF, 0x100)}, {}


def encode_distinct(words: list[bytes], path: str) -> list[bytes]:
    """The ids of each word, as packed 32-bit integers. Plain words go to the merges directly, which saves most of the time."""
    tokenizer, merges, letters, _ = _tokenizer(path)
    out, others = [b""] * len(words), []
    for i, w in enumerate(words):
        text = w.decode()
        if _CAPITALS.search(text):
            text = text.lower()
        if not _PLAIN.fullmatch(text):
            others.append(i)
            continue
        out[i] = array("I", [t.id for part in _PARTS.findall(text) for t in merges.tokenize(part if w.isascii() else part.translate(letters))]).tobytes()
    made = tokenizer.encode_batch_fast([words[i].decode() for i in others], add_special_tokens=False)
    for i, e in zip(others, made, strict=True):
        out[i] = array("I", e.ids).tobytes()
    return out


def encode_words(texts: list[bytes], path: str) -> list[bytes]:
    """The ids of each text, as packed 32-bit integers."""
    cache = _tokenizer(path)[-1]
    split = [t.lower().split() for t in texts]  # of bytes: A-Z and ASCII white space only
    seen = set().union(*split)
    unknown = [w for w in seen if w not in cache]
    if len(cache) + len(unknown) > CACHE:
        cache.clear()
        unknown = list(seen)
    now = dict(zip(unknown, encode_distinct(unknown, path), strict=True))
    cache.update((w, ids) for w, ids in now.items() if len(w) <= _CACHED_BYTES)
    known = cache if all(len(w) <= _CACHED_BYTES for w in now) else {**cache, **now}
    return [b"".join(map(known.__getitem__, words)) for words in split]


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece (from 0), start (the document's ids before it), length and token_ids (little-endian 32-bit binary) of each piece of `capacity` ids at most."""
    end = array("I", [end_id]).tobytes()
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, piece int, start bigint, length bigint, token_ids binary"

    def run(batches):
        for batch in batches:
            raw, off = utf8_parts(batch.column(1))
            for i, j in row_slices(off):
                part = raw[off[i] : off[j]].tobytes()
                at = (off[i : j + 1] - off[i]).tolist()
                ids = [x + end for x in encode_words([part[a:b] for a, b in zip(at, at[1:], strict=False)], path)]
                sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
                pieces = -(-sizes // capacity)
                row = np.repeat(np.arange(len(ids)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(capacity, sizes[row] - start)
                cut = [ids[r][4 * s : 4 * (s + n)] for r, s, n in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(i + row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(cut, pa.binary())],
                    [id_col, "piece", "start", "length", "token_ids"])

    return docs.select(id_col, text_col).mapInArrow(tidied(run), schema)


# --- the plan, from how many pieces have each length

Group = tuple[int, tuple[tuple[int, int], ...]]  # so many sequences, each of (length, times) in this order


def dominating(n: np.ndarray, room: int) -> list[int] | None:
    """The lengths, of those left (n: how many of each), that with a piece beside which `room` is left dominate all other choices; None if none is known to."""
    left = np.flatnonzero(n[: room + 1])
    if not len(left):
        return []
    longest = int(left[-1])
    least = np.repeat(left[:3], np.minimum(n[left[:3]], 3))[:3]
    if longest == room or len(least) < 2 or least[0] + least[1] > room:
        return [longest]
    if len(least) == 3 and least.sum() <= room:
        return None
    below = np.zeros(room + 1, np.int64)  # the longest of each length or less
    below[left] = left
    below = np.maximum.accumulate(below)
    first = left
    second = below[np.minimum(first, room - first)]
    alone = (second == first) & (n[first] < 2)
    second[alone] = below[first[alone] - 1]
    total = np.where(second > 0, first + second, 0)
    best = int(total.argmax())
    if longest >= total[best]:
        return [longest]
    b = int(second[total == total[best]][first[total == total[best]] == longest][0]) if (first[total == total[best]] == longest).any() else 0
    if not b:
        return None
    inner = left[(left > b) & (left < longest)]
    two = np.repeat(inner[:2], np.minimum(n[inner[:2]], 2))[:2]
    return [longest, b] if len(two) < 2 or two.sum() > room else None


def reduce_instance(counts: np.ndarray, capacity: int) -> tuple[list[Group], np.ndarray]:
    """(the groups that dominance fixes, how many pieces of each length are left)."""
    n, fixed, found = counts.copy(), [], True
    while found:
        found = False
        for j in np.flatnonzero(n)[::-1].tolist():
            while n[j]:
                n[j] -= 1
                with_j = dominating(n, capacity - j)
                n[j] += 1
                if with_j is None:
                    break
                content = tuple((x, [j, *with_j].count(x)) for x in dict.fromkeys([j, *with_j]))
                times = min(int(n[x]) // k for x, k in content)
                for x, k in content:
                    n[x] -= times * k
                fixed.append((times, content))
                found = True
    return fixed, n


def best_fit(counts: np.ndarray, capacity: int) -> list[Group]:
    """Groups of sequences that best-fit makes of these pieces, longest first."""
    groups: list[list[Group]] = [[] for _ in range(capacity + 1)]  # by the room that is left
    has = bytearray(capacity + 1)

    def put(room: int, group: Group) -> None:
        groups[room].append(group)
        has[room] = 1

    for x in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[x])
        while n:
            room = has.find(1, x)
            if room < 0:
                room, m, content = capacity, n, ()
            else:
                m, content = groups[room].pop()
                has[room] = bool(groups[room])
            each = min(room // x, n)
            times = min(m, n // each)
            put(room - each * x, (times, (*content, (x, each))))
            n -= times * each
            if room < capacity and m > times:
                put(room, (m - times, content))
    return [g for of in groups for g in of]


def plan(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """(slots, number of sequences). A slot: length << RANK_BITS | first rank, first sequence, pieces of this length in each sequence, offset of the first."""
    fixed, rest = reduce_instance(counts, capacity)
    used, slots, sequence = np.zeros(capacity + 1, np.int64), [], 0
    for times, content in fixed + best_fit(rest, capacity):
        offset = 0
        for x, each in content:
            slots.append((x << _RANK_BITS | int(used[x]), sequence, each, offset))
            used[x] += times * each
            offset += x * each
        sequence += times
    return np.array(sorted(slots), np.int64).reshape(-1, 4), sequence


# --- ranks and places

def pack(pieces: DataFrame, capacity: int = CAPACITY, length_col: str = "length") -> DataFrame:
    """pieces with sequence_id and offset (gapless from 0 in each sequence). Lengths are 1 to `capacity`."""
    if taken := {"sequence_id", "offset"} & {c.lower() for c in pieces.columns}:
        raise ValueError(f"columns clash with those that pack makes: {sorted(taken)}")
    spark, names = pieces.sparkSession, pieces.columns
    part, rank, n = (fresh(c, names) for c in ("_part", "_rank", "_n"))

    def number(batches):
        seen, own = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            length = batch.column(names.index(length_col)).to_numpy(zero_copy_only=False).astype(np.int64)
            if len(length) and (length.min() < 1 or length.max() > capacity):
                raise ValueError(f"lengths must be 1 to {capacity}")
            order = np.argsort(length, kind="stable")
            times = np.bincount(length, minlength=capacity + 1)
            ranks = np.empty(len(length), np.int64)
            ranks[order] = np.arange(len(length)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(seen, times)
            seen += times
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(length), own, np.int32)), pa.array(ranks)], [*names, part, rank])

    quoted = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    numbered = written(pieces.mapInArrow(tidied(number), f"{quoted}, `{part}` int, `{rank}` bigint"), "pieces")
    counts = written(numbered.groupBy(length_col, part).agg(F.count(F.lit(1)).alias(n)), "lengths")
    total = np.zeros(capacity + 1, np.int64)
    for length, rows in counts.groupBy(length_col).agg(F.sum(n)).collect():  # a number for each length
        total[length] = rows
    slots, _ = plan(total, capacity)
    shared = spark.sparkContext.broadcast(slots)
    before = Window.partitionBy(length_col).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    shifts = counts.withColumn(n, F.coalesce(F.sum(n).over(before), F.lit(0)))
    ranked = numbered.join(shifts, [length_col, part]).withColumn(rank, F.col(rank) + F.col(n)).select(*names, rank)

    def place(batches):
        slot = shared.value
        for batch in batches:
            length = batch.column(names.index(length_col)).to_numpy(zero_copy_only=False).astype(np.int64)
            key = length << _RANK_BITS | batch.column(len(names)).to_numpy(zero_copy_only=False)
            first, sequence, each, offset = slot[np.searchsorted(slot[:, 0], key, "right") - 1].T
            k = key - first
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence + k // each), pa.array(offset + k % each * length)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(tidied(place), f"{quoted}, sequence_id bigint, `offset` bigint")


def sequences(placed: DataFrame, ids_col: str = "token_ids") -> DataFrame:
    """sequence_id, n_pieces, token_ids (the pieces' ids in the order of their offsets) of packed pieces; a sequence holds `capacity` ids at most."""
    held = F.sort_array(F.collect_list(F.struct("offset", F.hex(ids_col).alias("ids"))))
    return placed.groupBy("sequence_id").agg(held.alias("held")).select(
        "sequence_id", F.size("held").cast("long").alias("n_pieces"), F.unhex(F.array_join(F.transform("held", lambda x: x["ids"]), "")).alias("token_ids"))
