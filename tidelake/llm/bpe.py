"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, offsets, decoding.

Pre-tokenisation uses no regular expression. Each code point gets a class (array lookup), white space and apostrophes a
finer one by looking at the next code points (array compares). The pattern is then a finite automaton over classes. Its
transition functions compose associatively, so the state before every code point comes from a blocked scan: functions
of all blocks side by side, a scan over the blocks' functions, then states inside all blocks side by side. A table of
(state, class) says where a slice starts. Slices go through a bounded cache of merged pieces.

Texts are scanned in runs of about half a million bytes, so memory doesn't depend on the number of texts; a longer text
is scanned alone. A slice of n bytes is merged with a heap in O(n log n).

Defined results: null and empty texts have no tokens; repeated rows are encoded each; an empty table gives an empty
result. `encode` keeps the named columns and adds its own, so a kept column may not have one of its names: it raises ValueError.
Decoding puts each token's bytes at its offset.
"""
from __future__ import annotations

import base64
import heapq
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import row_slices, tidied, utf8_parts

# classes of code points
LETTER, NUMBER, OTHER, SHORT2, SHORT3, GAP, LAST_BLANK, LAST_GAP = range(8)
# states: what the code point before was part of
NEW, IN_L, IN_N, IN_O, IN_GAP, BLANK, TAIL1, TAIL2 = range(8)
_STATES = 8
#: The contractions that the pattern names, by their letters after the apostrophe.
CONTRACTIONS_1 = "stmd"
CONTRACTIONS_2 = ("re", "ve", "ll")
#: White space by the Unicode property White_Space.
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_CHARS = 1 << 19
_BLOCK = 256
CACHE = 240_000


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, starts a slice) by class and state; classes 8 to 15 are 0 to 7 as the first of a text."""
    step, cut = np.zeros((16, _STATES), np.uint8), np.zeros((16, _STATES), bool)
    joins = {LETTER: (IN_L, (IN_L, BLANK)), NUMBER: (IN_N, (IN_N, BLANK)), OTHER: (IN_O, (IN_O, BLANK)), GAP: (IN_GAP, (IN_GAP,)),
             LAST_BLANK: (BLANK, ()), LAST_GAP: (NEW, ())}
    for cls in range(8):
        for state in range(_STATES):
            if state == TAIL2:
                to, starts = TAIL1, False
            elif state == TAIL1:
                to, starts = NEW, False
            elif cls in joins:
                to, without = joins[cls]
                starts = state not in without
            elif state in (IN_O, BLANK):  # an apostrophe inside a run of signs
                to, starts = IN_O, False
            else:
                to, starts = (TAIL1 if cls == SHORT2 else TAIL2), True
            step[cls, state], cut[cls, state] = to, starts
        step[cls + 8, :], cut[cls + 8, :] = step[cls, NEW], True
    return step, cut


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kind = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        first = unicodedata.category(chr(c))[0]
        if first == "L":
            kind[c] = LETTER
        elif first == "N":
            kind[c] = NUMBER
    kind[list(WHITE_SPACE)] = GAP
    return kind, *_automaton()


def _scan(cls: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The state before each code point, from state NEW."""
    n = len(cls)
    rows = -(-n // _BLOCK)
    padded = np.zeros(rows * _BLOCK, np.uint8)
    padded[:n] = cls
    grid = np.ascontiguousarray(padded.reshape(rows, _BLOCK).T)
    flat = step.reshape(-1)
    func = np.tile(np.arange(_STATES, dtype=np.uint8), (rows, 1))
    for j in range(_BLOCK):
        func = flat[(grid[j].astype(np.intp) * _STATES)[:, None] + func]
    if rows <= _BLOCK:
        start = np.empty(rows, np.uint8)
        s = NEW
        for i in range(rows):
            start[i] = s
            s = func[i, s]
    else:
        start = _scan_functions(func)
    out = np.empty((_BLOCK, rows), np.uint8)
    state = start
    for j in range(_BLOCK):
        out[j] = state
        state = flat[grid[j].astype(np.intp) * _STATES + state]
    return out.T.reshape(-1)[:n]


def _scan_functions(func: np.ndarray) -> np.ndarray:
    """The state before each block, by an inclusive doubling scan of the blocks' functions."""
    acc, shift = func.copy(), 1
    while shift < len(acc):
        acc[shift:] = np.take_along_axis(acc[shift:], acc[:-shift], axis=1)
        shift *= 2
    start = np.empty(len(acc), np.uint8)
    start[0], start[1:] = NEW, acc[:-1, NEW]
    return start


def slice_starts(codes: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Positions where slices start. codes: code points of texts that stand one after another; text_starts: where (non-empty) texts start."""
    kind, step, cut = _tables()
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    cls = kind[codes]
    first = np.zeros(n + 1, bool)
    first[text_starts] = True
    first[n] = True
    ends = first[1:]  # the last of its text
    gap = cls == GAP
    follow = np.zeros(n, bool)  # followed, in its text, by something else than white space
    follow[:-1] = ~gap[1:] & ~ends[:-1]
    last = gap & follow
    cls[last] = np.where(codes[last] == 32, LAST_BLANK, LAST_GAP)
    at = np.flatnonzero(codes == 39)
    if len(at):
        wide = np.concatenate([codes, np.zeros(2, codes.dtype)])
        inner1 = ~ends[at]
        inner2 = inner1 & ~ends[np.minimum(at + 1, n - 1)]
        a, b = wide[at + 1], wide[at + 2]
        three = np.zeros(len(at), bool)
        for x, y in CONTRACTIONS_2:
            three |= (a == ord(x)) & (b == ord(y))
        cls[at[three & inner2]] = SHORT3
        cls[at[np.isin(a, [ord(x) for x in CONTRACTIONS_1]) & inner1]] = SHORT2
    cls[first[:n]] += 8
    return np.flatnonzero(cut[cls, _scan(cls, step)])


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one slice: merge the pair of least rank, the leftmost first, until none has a rank."""
    if (whole := ranks.get(piece)) is not None:
        return (whole,)
    n = len(piece)
    end, after, before, alive = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop:  # one of the two has grown or gone
            continue
        alive[j] = False
        end[i], after[i] = stop, after[j]
        if after[j] < n:
            before[after[j]] = i
            if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    return tuple(ranks[piece[i : end[i]]] for i in range(n) if alive[i])


class _Cache(dict):
    """Slice -> its ids, packed as native 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", merge(piece.encode(), self.ranks)).tobytes()
        if len(piece) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(4)
def _encoder(path: str) -> tuple[_Cache, np.ndarray]:
    ranks = load_ranks(path)
    size = np.zeros(max(ranks.values()) + 1, np.uint32)
    for token, rank in ranks.items():
        size[rank] = len(token)
    return _Cache(ranks), size


def encode_texts(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, number of ids of each text)."""
    cache, _ = _encoder(path)
    joined = "".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    starts = slice_starts(codes, bounds[:-1][bounds[1:] > bounds[:-1]])
    cuts = [*starts.tolist(), len(joined)]
    pieces = [cache[joined[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
    ids = np.frombuffer(b"".join(pieces), np.uint32)
    upto = np.concatenate([[0], np.cumsum(sizes)])
    at = upto[np.searchsorted(starts, bounds)]
    return ids, np.diff(at)


def _cut(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """One binary or list for each count."""
    ends = np.concatenate([[0], np.cumsum(counts)])
    if pa.types.is_large_binary(kind):
        return pa.LargeBinaryArray.from_buffers(kind, len(counts), [None, pa.py_buffer(ends * 4), pa.py_buffer(np.ascontiguousarray(values.astype("<u4")))])
    return pa.LargeListArray.from_arrays(ends, pa.array(values.astype(np.int32))).cast(pa.list_(pa.int32()))


def encode(df: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), packed: bool = False, offsets: bool = True) -> DataFrame:
    """keep, n_tokens, token_ids and, if asked for, token_offsets (the byte in the text where each token starts).

    path: a rank file that every executor has. packed: ids and offsets as little-endian 32-bit binaries, else arrays."""
    if taken := {"n_tokens", "token_ids", "token_offsets"} & {c.lower() for c in keep}:
        raise ValueError(f"kept columns clash with those that encode makes: {sorted(taken)}")
    form = "binary" if packed else "array<int>"
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "n_tokens bigint", f"token_ids {form}"] + [f"token_offsets {form}"] * offsets)
    kind = pa.large_binary() if packed else pa.list_(pa.int32())

    def run(batches):
        _, width = _encoder(path)
        for batch in batches:
            column = batch.column(len(keep))
            _, off = utf8_parts(column)
            for i, j in row_slices(off, _CHARS):
                ids, counts = encode_texts([t or "" for t in column.slice(i, j - i).to_pylist()], path)
                out = [batch.column(k).slice(i, j - i) for k in range(len(keep))] + [pa.array(counts, pa.int64()), _cut(ids, counts, kind)]
                if offsets:
                    total = np.concatenate([[0], np.cumsum(width[ids], dtype=np.int64)])
                    base = np.repeat(off[i : j] - off[i], counts)
                    out.append(_cut(total[:-1] - base, counts, kind))
                if packed:
                    out = [c.cast(pa.binary()) if pa.types.is_large_binary(c.type) else c for c in out]
                yield pa.RecordBatch.from_arrays(out, [*keep, "n_tokens", "token_ids"] + ["token_offsets"] * offsets)

    return df.select(*keep, text_col).mapInArrow(tidied(run), schema)


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, bounds of rows) of a column of packed binaries or arrays; null counts as empty."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        raw, off = utf8_parts(column)
        return np.frombuffer(raw.tobytes(), "<u4").astype(np.int64), off // 4
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


@lru_cache(4)
def _vocabulary(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all tokens, where each starts there, its number of bytes)."""
    ranks, width = _encoder(path)[0].ranks, _encoder(path)[1].astype(np.int64)
    data = bytearray()
    start = np.zeros(len(width), np.int64)
    for token, rank in ranks.items():
        start[rank] = len(data)
        data += token
    return np.frombuffer(bytes(data), np.uint8), start, width


def place_tokens(ids: np.ndarray, offsets: np.ndarray, bounds: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of the rows' texts: each token's bytes are put at its offset in its text. Raises if tokens leave a gap or overlap."""
    data, start, width = _vocabulary(path)
    size = width[ids]
    before = np.concatenate([[0], np.cumsum(size)])
    ends = before[bounds]  # of the rows' texts, one after another
    at = offsets + np.repeat(ends[:-1], np.diff(bounds))
    if not np.array_equal(at, before[:-1]):
        raise ValueError("token offsets don't fit the tokens")
    inner = np.arange(before[-1]) - np.repeat(before[:-1], size)
    out = np.empty(before[-1], np.uint8)
    out[np.repeat(at, size) + inner] = data[np.repeat(start[ids], size) + inner]
    return out, ends


def decode(df: DataFrame, path: str, ids_col: str = "token_ids", offsets_col: str = "token_offsets", keep: tuple[str, ...] = ("doc_id",), out_col: str = "decoded") -> DataFrame:
    """keep and the bytes that the ids at their offsets (packed binaries or arrays; null: none) stand for."""
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), f"`{out_col}` binary"])

    def run(batches):
        for batch in batches:
            ids, bounds = _numbers(batch.column(len(keep)))
            offsets, told = _numbers(batch.column(len(keep) + 1))
            if not np.array_equal(bounds, told):
                raise ValueError("there must be an offset for each token")
            for i, j in row_slices(bounds, _CHARS):
                part = slice(bounds[i], bounds[j])
                data, ends = place_tokens(ids[part], offsets[part], bounds[i : j + 1] - bounds[i], path)
                made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(len(keep))), made.cast(pa.binary())], [*keep, out_col])

    return df.select(*keep, ids_col, offsets_col).mapInArrow(tidied(run), schema)
