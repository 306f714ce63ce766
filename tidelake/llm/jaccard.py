"""N-gram Jaccard join: documents whose sets of word shingles overlap by a share of their union, as components.

The order of shingles is rare-first by document frequency in 2**22 hash buckets, counted over all documents (any order
that is the same for all documents gives right results; the fixed number of buckets keeps the table at 16 MB at any size). Documents of
equal sets (digests of 128-bit hashes of all shingles) are one node. A node's prefix holds all that must meet any partner; prefixes
meet by shingle, in lists sorted by length. Length, positional and suffix filters act on pairs of a list (suffix: a document's shingle
counts between fixed pivots bound the overlap); each pair is verified once, by hashes and, before it counts as a link, by the words themselves.

Lists are never expanded into all pairs. First each list gives its neighbours in length and each member with the first,
of which each document keeps two; the links among these make components. Then each list gives its most central member (of
most shared prefix shingles: an original rather than its edited copies) with one member of each other component; at last
all pairs of different components, which is all that can change the result. All are verified: no link between components
is lost.

No long list needs one task. Frequent shingles, told by the bucket counts, are hot: their lists are dealt to several tasks for the first
links, central members are combined maxima, and for the last pairs a list is dealt as blocks of SPLIT members, each of which meets the members
outside the list's largest component (those are the only ones that can make a new link), a batch at a time. Other lists are bounded and searched whole.

Words are hashed with a secret key of the run (nobody can choose texts whose hashes are equal; by chance 64 bits of two shingles are, once
in 10**19 pairs); documents are one node by 128 bits for each shingle, and every other link is verified by words.

Defined results: null and empty texts have no shingles and link with nothing; each row is returned, with its own n_shingles and the
component of its own text: rows of one id with equal texts are one document, rows of one id (or of null) with different texts are several
documents of that id, which link only if their texts do; a null id sorts before all others; an empty table gives an empty result.
"""
from __future__ import annotations

import secrets

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, digests, gram_hashes, join_counted, mix, row_slices, tidied, utf8_parts, written

BUCKET_BITS = 22
BUCKETS = 1 << BUCKET_BITS
SLICE = 1 << 14  # buckets in one row of the table while it is summed
#: Most rows of a table of a few numbers that is broadcast (some 20 MB); larger ones are joined by shuffle.
BROADCAST_ROWS = 400_000
#: Tasks that share the pairs of one document, at least, and pairs for each more.
SALTS, SALT_PAIRS = 64, 50_000
#: Documents of a shingle's bucket over the median bucket that go to one task.
HOT = 1024
#: Members of a list that one task compares with others.
SPLIT = 512
PIVOTS = 64
#: Links that one task folds into a forest before the rounds of components.
FOREST_LINKS = 250_000
_LEAST = -(1 << 63)


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int, key: bytes, wide: bool = False) -> tuple[np.ndarray, ...]:
    """(row, hash) of the distinct shingles of each text, sorted by row and hash; wide: and 64 more bits of hash."""
    words = Words(raw, offsets, lower=True, key=key)
    valid = np.flatnonzero(words.doc[: max(0, len(words.ids) - k + 1)] == words.doc[k - 1 :])
    few = np.flatnonzero((words.counts > 0) & (words.counts < k))
    first = np.concatenate([[0], np.cumsum(words.counts)])[few]

    def shingles(h: np.ndarray) -> np.ndarray:
        whole = np.zeros(len(few), np.uint64)
        for size in np.unique(words.counts[few]).tolist():
            of = words.counts[few] == size
            whole[of] = gram_hashes(h, size)[first[of]]
        return np.concatenate([gram_hashes(h, k)[valid], whole])

    row, value = np.concatenate([words.doc[valid], few]), shingles(words.hash)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return (row[new], value[new], shingles(words.other)[order][new]) if wide else (row[new], value[new])


def _bucket(value: np.ndarray) -> np.ndarray:
    return (value >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def pivot_counts(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """For each text, its shingles between fixed pivots of the hash range; 255 stands for more, which keeps bounds valid."""
    n = np.bincount(row * PIVOTS + (value >> np.uint64(64 - 6)).astype(np.int64), minlength=rows * PIVOTS)
    return np.minimum(n, 255).astype(np.uint8).reshape(rows, PIVOTS)


def _survey(k: int, key: bytes):
    """kind 0: (id, set size, digest of the set in two halves, print of the text, counts between pivots) of each text; kind 1: (slice, counts) of the buckets at a
    partition's end."""

    def run(batches):
        seen = np.zeros(BUCKETS, np.uint32)

        def rows(kind, a, b, c, d, e, counts):
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(a), kind, np.int32)), *(pa.array(x, pa.int64()) for x in (a, b, c, d, e)), pa.array(counts, pa.binary())], ["kind", "a", "b", "c", "d", "e", "counts"])

        for batch in batches:
            ids, prints = (np.asarray(batch.column(x).to_numpy(zero_copy_only=False), np.int64) for x in (0, 2))
            raw, off = utf8_parts(batch.column(1))
            for i, j in row_slices(off):
                row, value, other = shingle_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], k, key, wide=True)
                at, times = np.unique(_bucket(value), return_counts=True)
                seen[at] += times.astype(np.uint32)
                size = np.bincount(row, minlength=j - i)
                ends = np.concatenate([[0], np.cumsum(size)]) * 16
                of = digests(np.stack([value, other], 1).tobytes(), ends[:-1], ends[1:])
                yield rows(0, ids[i:j], size, of[:, 0], of[:, 1], prints[i:j], [x.tobytes() for x in pivot_counts(row, value, j - i)])
        if seen.any():
            n = np.arange(BUCKETS // SLICE)
            small = np.uint8 if seen.max() < 1 << 8 else np.uint16 if seen.max() < 1 << 16 else np.uint32
            yield rows(1, n, n, n, n, n, [x.astype(small).tobytes() for x in seen.reshape(-1, SLICE)])

    return run


def _sum_slices(batches):
    """(slice, counts) summed over all partitions' rows of a slice."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for n, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            width = {SLICE: np.uint8, 2 * SLICE: np.uint16, 4 * SLICE: np.uint32}[len(counts)]
            total[n] = total.get(n, 0) + np.frombuffer(counts, width).astype(np.int64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int64()), pa.array([np.minimum(x, 0xFFFFFFFF).astype(np.uint32).tobytes() for x in total.values()], pa.binary())], ["a", "counts"])


def _need(n: np.ndarray, share: int) -> np.ndarray:
    """Least overlap that a set of n needs with any partner."""
    return -(-share * n // 100)


def hot_buckets(often: np.ndarray, hot: int) -> np.ndarray:
    """Tasks for the shingles of each bucket: one, and one more for each `hot` documents (or eight deviations of a usual bucket, if
    that is more) over the median bucket."""
    usual = float(np.median(often))
    return 1 + (np.maximum(often - usual, 0) // max(hot, 8 * usual**0.5)).astype(np.int64)


def _prefixes(k: int, share: int, counts, hot: int, key: bytes):
    """(token, salt, id, size << 32 | position) of each document's rare-first prefix; salt is -1 but for hot shingles."""

    def run(batches):
        often = counts.value
        tasks = hot_buckets(often, hot)
        for batch in batches:
            ids = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
            raw, off = utf8_parts(batch.column(1))
            for i, j in row_slices(off):
                row, value = shingle_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], k, key)
                order = np.lexsort((value, often[_bucket(value)], row))
                value = value[order]
                size = np.bincount(row, minlength=j - i)
                place = np.arange(len(row)) - np.concatenate([[0], np.cumsum(size)])[row]
                n = size[row]
                take = place <= n - _need(n, share)
                value, doc, n = value[take], ids[i + row[take]], n[take]
                many = tasks[_bucket(value)]
                salt = np.where(many > 1, (mix(doc.view(np.uint64)) % many.astype(np.uint64)).astype(np.int64), -1).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value.view(np.int64)), pa.array(salt), pa.array(doc), pa.array(n << 32 | place[take])], ["token", "salt", "id", "np"])

    return run


def _passes(n1, p1, n2, p2, share: int):
    """Length, index-prefix and positional filters on a shorter (1) and a longer (2) set that share the token at p1 and p2."""
    alpha = -(-share * (n1 + n2) // (100 + share))
    index = n1 - (-(-2 * share * n1 // (100 + share)))
    return (100 * n1 >= share * n2) & (p1 <= index) & (1 + np.minimum(n1 - p1, n2 - p2) - 1 >= alpha)


def _distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    new &= a != b
    return a[new], b[new]


def _lists(share: int):
    """From prefix rows sorted by token, salt, size and id: kind 0: the rows of lists of two and more, and kind 2: of salted lists; kind 1: pairs
    (a, b) of neighbours and of each member with the list's first. Holds two rows of a list."""

    def rows(kind, a, b, c):
        kind = np.full(len(a), kind) if isinstance(kind, int) else kind
        return pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), *(pa.array(x) for x in (a, b, c))], ["kind", "a", "b", "c"])

    def run(batches):
        held = [np.zeros(0, np.int64)] * 4  # the first and the last row so far of the list that is open
        for batch in batches:
            cols = [np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(held)]
            token, salt, doc, packed = cols
            old = len(held[0])
            if len(token) == old:
                continue
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])
            shared = salt >= 0
            shared[1:] |= ~new[1:]
            shared[:-1] |= ~new[1:]
            fresh = np.arange(len(token)) >= old
            if old == 1 and salt[0] < 0:
                fresh[0] = True  # alone till now
            out = shared & fresh
            if out.any():
                yield rows(np.where(salt[out] >= 0, 2, 0), token[out], doc[out], packed[out])
            first = np.maximum.accumulate(np.where(new, np.arange(len(token)), 0))
            held = [c[[first[-1], -1]] if first[-1] < len(token) - 1 else c[-1:] for c in cols]
            n, p = packed >> 32, packed & 0xFFFFFFFF
            here = np.flatnonzero(~new & (np.arange(len(token)) >= old))
            a, b = [], []
            for other in (here - 1, first[here]):
                ok = _passes(n[other], p[other], n[here], p[here], share)
                a.append(doc[other][ok])
                b.append(doc[here][ok])
            x, y = _distinct_pairs(np.concatenate(a), np.concatenate(b))
            if len(x):
                yield rows(1, x, y, x)

    return run


def _suffix_near(n, parts, u, v, share: int) -> np.ndarray:
    """Which pairs (u, v) the counts between pivots leave possible."""
    out = np.zeros(len(u), bool)
    for c in range(0, len(u), 1 << 14):
        x, y = u[c : c + (1 << 14)], v[c : c + (1 << 14)]
        both = n[x] + n[y]
        out[c : c + (1 << 14)] = np.abs(parts[x].astype(np.int16) - parts[y]).sum(1) <= both - 2 * -(-share * both // (100 + share))
    return out


def _ordered(u, v, n, p, share: int) -> np.ndarray:
    """Which pairs of rows u and v pass the filters, the shorter one first."""
    u, v = np.where(n[u] <= n[v], u, v), np.where(n[u] <= n[v], v, u)
    return _passes(n[u], p[u], n[v], p[v], share)


def _whole_lists(batches, width: int, pivots: bool = False):
    """Columns of complete runs of equal first column, a batch at a time; the last run waits for the next batch. For lists that aren't
    hot, which are bounded. width: columns of numbers; pivots: one more column of pivot counts, as a row of bytes each."""
    held = [np.zeros(0, np.int64)] * width + [np.zeros((0, PIVOTS), np.uint8)] * pivots
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(width)]
        if pivots:
            cols.append(utf8_parts(batch.column(width))[0].reshape(-1, PIVOTS))
        cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
        if not len(cols[0]):
            continue
        cut = int(np.searchsorted(cols[0], cols[0][-1], "left"))
        held = [c[cut:] for c in cols]
        if cut:
            yield [c[:cut] for c in cols]
    if len(held[0]):
        yield held


def _central(share: int):
    """From lists sorted by token, with components and centrality: (a, b, np of a, np of b) of the most central member of each list
    and the most central one of each other component, if they pass the filters."""

    def run(batches):
        for token, packed, doc, comp, central in _whole_lists(batches, 5):
            group = np.cumsum(np.concatenate([[True], token[1:] != token[:-1]]))
            order = np.lexsort((doc, -central, comp, group))
            lead = np.ones(len(order), bool)
            lead[1:] = (group[order[1:]] != group[order[:-1]]) | (comp[order[1:]] != comp[order[:-1]])
            chosen = order[lead]  # one of each component in a list
            chosen = chosen[np.lexsort((doc[chosen], -central[chosen], group[chosen]))]
            first = np.ones(len(chosen), bool)
            first[1:] = group[chosen[1:]] != group[chosen[:-1]]
            u = chosen[np.maximum.accumulate(np.where(first, np.arange(len(chosen)), 0))][~first]
            v = chosen[~first]
            ok = _ordered(u, v, packed >> 32, packed & 0xFFFFFFFF, share)
            u, v = u[ok], v[ok]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[u], doc[v], packed[u], packed[v])], ["a", "b", "x", "y"])

    return run


def _sketched(share: int):
    """From (a, b, np of a, np of b, counts of a, counts of b): the (a, b) that pass the filters."""

    def run(batches):
        for batch in batches:
            a, b, x, y = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            packed = np.concatenate([x, y])
            n, p = packed >> 32, packed & 0xFFFFFFFF
            u = np.arange(len(a))
            u = u[_ordered(u, u + len(a), n, p, share)]
            parts = np.concatenate([utf8_parts(batch.column(i))[0].reshape(-1, PIVOTS) for i in (4, 5)])
            u = u[_suffix_near(n, parts, u, u + len(a), share)]
            a, b = _distinct_pairs(a[u], b[u])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _meet(packed, doc, comp, parts, members: slice, probes: np.ndarray, share: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of different components of members (sorted by size) and probes that pass the filters, a block of probes at a time."""
    n, p = packed >> 32, packed & 0xFFFFFFFF
    got = []
    for i in range(0, len(probes), SPLIT):
        x = probes[i : i + SPLIT]
        low, high = np.searchsorted(n[members], [-(-share * n[x].min() // 100), 100 * n[x].max() // share + 1])
        y = np.arange(members.start + low, members.start + high)
        u, v = np.nonzero(comp[x][:, None] != comp[y][None, :])
        u, v = x[u], y[v]
        ok = _ordered(u, v, n, p, share)
        u, v = u[ok], v[ok]
        near = _suffix_near(n, parts, u, v, share)
        got.append(_distinct_pairs(doc[u[near]], doc[v[near]]))
    return got


def _pair_batch(got: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = _distinct_pairs(*(np.concatenate(x) for x in zip(*got, strict=True)))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _crossing(share: int):
    """From lists sorted by token and size, with components and pivot counts: pairs of different components that pass the filters. Those outside a
    list's largest component meet all members."""

    def run(batches):
        for token, packed, doc, comp, parts in _whole_lists(batches, 4, pivots=True):
            start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            got = []
            for s, e in zip(start.tolist(), [*start[1:].tolist(), len(token)], strict=True):
                kinds, where, times = np.unique(comp[s:e], return_inverse=True, return_counts=True)
                if len(kinds) > 1:
                    got += _meet(packed, doc, comp, parts, slice(s, e), s + np.flatnonzero(where != times.argmax()), share)
            if got:
                yield _pair_batch(got)

    return run


def _crossing_blocks(share: int):
    """The same of blocks of hot lists, sorted by token, unit, role (0: members of the block, 1: all outside the list's largest component), size and id.
    Holds a block's members; the others stream by."""

    def run(batches):
        held = [np.zeros(0, np.int64)] * 6 + [np.zeros((0, PIVOTS), np.uint8)]
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)] + [utf8_parts(batch.column(6))[0].reshape(-1, PIVOTS)]
            token, unit, role, packed, doc, comp, parts = cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
            if not len(token):
                continue
            start = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (unit[1:] != unit[:-1])]))
            first = start + np.add.reduceat((role == 0).astype(np.int64), start)  # of the others
            got = []
            for s, m, e in zip(start.tolist(), first.tolist(), [*start[1:].tolist(), len(token)], strict=True):
                if m > s:
                    got += _meet(packed, doc, comp, parts, slice(s, m), np.arange(m, e), share)
            held = [c[int(start[-1]) : int(first[-1])] for c in cols]
            if got:
                yield _pair_batch(got)

    return run


def _shingles(text: bytes, k: int) -> set[bytes]:
    """The shingles of a text as words."""
    words = text.lower().split()  # bytes: A-Z only, and the white space of the words' pattern
    return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {b" ".join(words)}


def _verified(k: int, share: int, key: bytes):
    """From texts sorted by leader, salt, member flag: (a, b) of the members that link with their leader."""

    def run(batches):
        leader, mine, mine_parts, mine_text, mine_words = None, None, None, b"", None
        for batch in batches:
            heads, docs, member = (batch.column(i).to_pylist() for i in (0, 2, 3))
            raw, off = utf8_parts(batch.column(4))
            text = raw.tobytes()
            a, b = [], []
            for i, j in row_slices(off):
                row, value = shingle_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], k, key)
                ends = np.searchsorted(row, np.arange(j - i + 1))
                for r in range(j - i):
                    own = value[ends[r] : ends[r + 1]]
                    parts = np.bincount((own >> np.uint64(58)).astype(np.int64), minlength=64)
                    if not member[i + r]:
                        leader, mine, mine_parts, mine_text, mine_words = heads[i + r], own, parts, text[off[i + r] : off[i + r + 1]], None
                        continue
                    if heads[i + r] != leader:
                        raise ValueError("a member came before its leader")
                    most = len(own) + len(mine)
                    alpha = -(-share * most // (100 + share))
                    if np.abs(parts - mine_parts).sum() > most - 2 * alpha:
                        continue
                    both = len(np.intersect1d(own, mine, assume_unique=True))
                    if 100 * both < share * (most - both):
                        continue
                    mine_words = mine_words or _shingles(mine_text, k)
                    words = _shingles(text[off[i + r] : off[i + r + 1]], k)
                    both = len(words & mine_words)
                    if 100 * both >= share * (len(words) + len(mine_words) - both):
                        a.append(leader)
                        b.append(docs[i + r])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def verify(pairs: DataFrame, docs: DataFrame, k: int, share: int, name: str, key: bytes) -> DataFrame:
    """The pairs (a, b) that link, each text sent once for each pair it is the later of. pairs: a written table; docs: _id, _text."""
    salt = F.pmod(F.xxhash64("b"), F.lit(max(SALTS, pairs.count() // SALT_PAIRS))).cast("int")
    salted = pairs.withColumn("salt", salt)
    roles = salted.select(F.col("b").alias("doc"), F.col("a").alias("leader"), "salt", F.lit(1).alias("member")).unionByName(
        salted.select(F.col("a").alias("doc"), F.col("a").alias("leader"), "salt", F.lit(0).alias("member")).distinct())
    roles = written(roles, f"{name}-roles")
    sent = docs.join(_small(roles), F.col("_id") == F.col("doc")).select("leader", "salt", "doc", "member", "_text").repartition("leader", "salt")
    sent = sent.sortWithinPartitions("leader", "salt", "member", "doc")
    return written(sent.mapInArrow(tidied(_verified(k, share, key)), "a bigint, b bigint").distinct(), name)


def _forest(batches):
    """Of a partition's links, those that join what the ones before left apart."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    for batch in batches:
        a, b = [], []
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                x, y = min(x, y), max(x, y)
                up[y] = x
                a.append(x)
                b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of all ids in links(a, b): the least id reachable. Large-star and small-star rounds, on what
    a forest of each part of the links leaves. links should be a written table."""
    def told(edges):
        r = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        return r[0], r[1]

    folded = links.select("a", "b").repartition(1 + links.count() // FOREST_LINKS).mapInArrow(tidied(_forest), "a bigint, b bigint")
    edges = written(folded.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "links")
    before = told(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u")
        edges = small.where("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(
            small_least.select("u", F.col("m").alias("v"))).distinct()
        edges = written(edges, "links")
        after = told(edges)
        if after == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = after
    raise RuntimeError("components did not settle")


def central_pairs(labelled: DataFrame, sketches: DataFrame, share: int) -> DataFrame:
    """(a, b): the most central member of each list of labelled(token, np, id, comp, hot) with that of each other component in it. Hot
    lists are combined, others searched whole."""
    ranked = labelled.join(sketches.select("sid", "central"), F.col("id") == F.col("sid")).select("token", "np", "id", "comp", "central", "hot")
    cold = ranked.where("NOT hot").drop("hot").repartition("token").sortWithinPartitions("token").mapInArrow(tidied(_central(share)), "a bigint, b bigint, x bigint, y bigint")
    first = lambda *c: F.max_by(F.struct(*c), F.struct("central", F.bitwise_not("id")))
    heads = written(ranked.where("hot").groupBy("token", "comp").agg(first("id", "np", "central").alias("h")).select("token", "comp", "h.*"), "heads")
    leads = heads.groupBy(F.col("token").alias("of")).agg(first("comp", "id", "np").alias("lead")).select("of", F.col("lead.comp").alias("lead_comp"), F.col("lead.id").alias("a"), F.col("lead.np").alias("x"))
    hot = heads.join(_small(written(leads, "leads")), F.col("token") == F.col("of")).where("comp != lead_comp").select("a", F.col("id").alias("b"), "x", F.col("np").alias("y"))
    sent = cold.unionByName(hot).distinct().join(sketches.select(F.col("sid").alias("sa"), F.col("counts").alias("ca")), F.col("a") == F.col("sa")).join(
        sketches.select(F.col("sid").alias("sb"), F.col("counts").alias("cb")), F.col("b") == F.col("sb"))
    return sent.select("a", "b", "x", "y", "ca", "cb").mapInArrow(tidied(_sketched(share)), "a bigint, b bigint")


def crossing_pairs(labelled: DataFrame, sketches: DataFrame, share: int) -> DataFrame:
    """(a, b): all pairs of different components in a list of labelled(token, np, id, comp, hot) that pass the filters."""
    row, size = ("np", "id", "comp"), F.shiftright("np", 32)
    full = labelled.join(sketches.select("sid", "counts"), F.col("id") == F.col("sid")).select("token", *row, "counts", "hot")
    cold = full.where("NOT hot").drop("hot").repartition("token").sortWithinPartitions("token", size, "id").mapInArrow(tidied(_crossing(share)), "a bigint, b bigint")
    hot = labelled.where("hot")
    kinds = hot.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("n"))
    lists = kinds.groupBy(F.col("token").alias("of")).agg(F.sum("n").alias("total"), F.max_by("comp", F.struct("n", "comp")).alias("largest"))
    sized = full.where("hot").join(_small(written(lists, "list-sizes")), F.col("token") == F.col("of"))
    units = F.ceil(F.col("total") / SPLIT).cast("int")
    members = sized.select("token", F.pmod(F.xxhash64("id"), units).cast("int").alias("unit"), F.lit(0).alias("role"), *row, "counts")
    others = sized.where("comp != largest").select("token", F.explode(F.sequence(F.lit(0), units - 1)).alias("unit"), F.lit(1).alias("role"), *row, "counts")
    dealt = members.unionByName(others).repartition("token", "unit").sortWithinPartitions("token", "unit", "role", size, "id")
    return cold.unionByName(dealt.mapInArrow(tidied(_crossing_blocks(share)), "a bigint, b bigint"))


def similarity_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, share: int = 80) -> DataFrame:
    """id, n_shingles, component_id of each row of docs; two documents link at 100 * intersection >= share * union."""
    spark = docs.sparkSession
    key = secrets.token_bytes(16)
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST)).alias("_id"), F.col(text_col).alias("_text"))
    print_ = -1 - F.conv(F.substring(F.sha2(F.concat(F.lit(key.hex()), F.coalesce("_text", F.lit(""))), 256), 1, 15), 16, 10).cast("long")
    survey = written(base.select("_id", "_text", print_).mapInArrow(tidied(_survey(k, key)), "kind int, a bigint, b bigint, c bigint, d bigint, e bigint, counts binary"), "survey")
    often = np.zeros((BUCKETS // SLICE, SLICE), np.uint32)
    slices = survey.where("kind = 1").select("a", "counts").repartition("a").mapInArrow(tidied(_sum_slices), "a bigint, counts binary")
    for n, part in slices.collect():  # 4 bytes for each of BUCKETS
        often[n] = np.frombuffer(part, np.uint32)
    often = often.reshape(-1)
    counts = spark.sparkContext.broadcast(often)
    sets = survey.where("kind = 0").select(F.col("a").alias("id"), F.col("b").alias("n"), "c", "d", "e", "counts", F.col("a").alias("real"))
    # an id of different texts: each of them is named by its print, so that none is taken for another
    several = written(sets.groupBy("real").agg(F.min("e").alias("lo"), F.max("e").alias("hi"), F.count(F.lit(1)).alias("rows")).where("lo < hi").select("real", "rows", F.lit(True).alias("several")), "several")
    if not several.isEmpty():
        sets = join_counted(sets, several, ["real"], n="rows").withColumn("id", F.when(F.col("several"), F.col("e")).otherwise(F.col("real"))).drop("several")
        base = join_counted(base, several.withColumnRenamed("real", "_id"), ["_id"], n="rows").select(F.when(F.col("several"), print_).otherwise(F.col("_id")).alias("_id"), "_text")
    nodes = sets.where("n > 0").groupBy("n", "c", "d").agg(F.min("id").alias("node"), F.min("real").alias("least"), F.count(F.lit(1)).alias("copies"))
    nodes = written(nodes, "nodes")
    # ids that only stand for copies of another node, or have no shingles, send no prefix
    idle = sets.join(nodes.where("copies > 1"), ["n", "c", "d"], "left").where("n = 0 OR (copies > 1 AND id != node)").select(F.col("id").alias("idle"))
    active = base.join(_small(written(idle.distinct(), "idle")), F.col("_id") == F.col("idle"), "left_anti")
    prefix = active.mapInArrow(tidied(_prefixes(k, share, counts, HOT, key)), "token bigint, salt int, id bigint, np bigint")
    size = F.shiftright("np", 32)
    lists = written(prefix.repartition("token", "salt").sortWithinPartitions("token", "salt", size, "id").mapInArrow(
        tidied(_lists(share)), "kind int, a bigint, b bigint, c bigint"), "lists")
    told = lists.where("kind = 1").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    best = told.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a"), F.min("a").alias("least"))
    tried = written(best.select("a", "b").unionByName(best.select(F.col("least").alias("a"), "b")).distinct(), "near-pairs")
    links = verify(tried, base, k, share, "near-links", key)
    found = components(links)
    rows = lists.where("kind != 1").select(F.col("a").alias("token"), F.col("c").alias("np"), F.col("b").alias("id"), (F.col("kind") == 2).alias("hot"))
    central = rows.groupBy("id").agg(F.count(F.lit(1)).alias("central"))
    sketches = sets.where("n > 0").select("id", "counts").dropDuplicates(["id"]).join(central, "id").select(F.col("id").alias("sid"), "counts", "central")
    sketches = _small(written(sketches, "sketches"))
    for candidates in (central_pairs, crossing_pairs):
        labelled = rows.join(_small(found.withColumnRenamed("id", "fid")), F.col("id") == F.col("fid"), "left").select(
            "token", "np", "id", F.coalesce("component", "id").alias("comp"), "hot")
        # a list of one component, as a large family's lists are by now, goes no further: minimum and maximum combine before the shuffle
        ends = labelled.groupBy(F.col("token").alias("mixed")).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("mixed")
        labelled = written(labelled.join(_small(written(ends, "mixed-lists")), F.col("token") == F.col("mixed"), "left_semi"), "mixed-rows")
        pairs = written(candidates(labelled, sketches, share).distinct().join(tried, ["a", "b"], "left_anti"), "crossing-pairs")
        more = verify(pairs, base, k, share, "crossing-links", key)
        tried = tried.unionByName(pairs)
        if not more.isEmpty():
            found = components(written(more.unionByName(found.select(F.col("id").alias("a"), F.col("component").alias("b"))), "all-links"))
    # a component is called by one of its nodes; its label is the least id of all its rows
    linked = nodes.join(found, F.col("node") == F.col("id"), "left").select("n", "c", "d", "node", "least", F.coalesce("component", "node").alias("of"))
    members = linked.where("of != node").groupBy("of").agg(F.min("least").alias("inner"), F.count(F.lit(1)).alias("rows"))
    heads = nodes.select(F.col("node").alias("of"), F.col("least").alias("head"))
    leasts = written(members.join(heads, "of").select("of", F.least("inner", "head").alias("first"), "rows"), "leasts")
    labels = join_counted(linked.drop("node"), leasts, ["of"], n="rows").select("n", "c", "d", F.coalesce("first", "least").alias("first"))
    real = lambda c: F.when(F.col(c) != _LEAST, F.col(c))
    return sets.join(labels, ["n", "c", "d"], "left").withColumn("first", F.coalesce("first", "real")).select(
        real("real").alias(id_col), F.col("n").alias("n_shingles"), real("first").alias("component_id"))
