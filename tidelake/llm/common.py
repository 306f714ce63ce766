"""What the corpus operators share: scratch tables and word scanning over Arrow buffers."""
from __future__ import annotations

import atexit
import ctypes
import uuid
from functools import cached_property, lru_cache
from hashlib import blake2b, shake_256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where scratch tables of a local session go when it names no folder.
LOCAL_DIR = "file:///tmp/checkpoints"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local session may leave it unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or LOCAL_DIR).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def drop() -> None:
        try:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        except Exception:  # the JVM may have ended before
            pass

    atexit.register(drop)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: it cuts the lineage and outlives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Of the rows a table is joined with, the share (one in so many) that makes a key's row one to broadcast.
HEAVY = 4096


def join_counted(rows: DataFrame, known: DataFrame, keys: list[str], how: str = "left", n: str = "n") -> DataFrame:
    """rows joined by `keys` (inner or left) with known, a written table with one row for each key, whose column n counts the rows it meets.

    Keys that meet one row in HEAVY or more, of which there are HEAVY at most, are broadcast; so no hot key's rows are sent to one task."""
    total = known.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) * HEAVY >= total
    heavy, light = F.broadcast(known.where(hot).drop(n)), known.where(~hot).drop(n)
    return rows.join(heavy, keys).unionByName(rows.join(heavy.select(keys), keys, "left_anti").join(light, keys, how))


def fresh(name: str, taken: list[str]) -> str:
    """name, or name with underscores, that no column in taken has (in any case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def tidied(run):
    """run (a function of Arrow batches) that gives freed memory back to the system when its partition ends, as a Python worker
    stays alive for other operators."""
    def outer(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return outer


# --- words of UTF-8 buffers, without a Python object for each word

_BLOCK = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty. offsets has one entry more than there are rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_slices(offsets: np.ndarray, most: int = _BLOCK):
    """Runs (first, last) of rows with about `most` bytes each; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


_LONG = 128  # bytes; longer words are rare and hashed one by one


@lru_cache(4)
def _coefficients(key: bytes) -> np.ndarray:
    """Random 64-bit numbers from the key: for the length and each 32-bit part of a word, for each of four sums."""
    return np.frombuffer(shake_256(key).digest(32 * (2 + _LONG // 4)), np.uint64).reshape(-1, 4)


def keyed_hashes(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, key: bytes) -> np.ndarray:
    """A 128-bit hash of each byte string, as two 64-bit numbers. Each 32 bits are the upper half of a sum of the string's 32-bit parts and its length
    times random coefficients: for two different strings chosen without the key they are equal by a chance of 2**-32, each for itself."""
    a, out = _coefficients(key), np.empty((len(starts), 4), np.uint64)
    padded = np.zeros(len(raw) + 4, np.uint8)
    padded[: len(raw)] = raw
    part_at = np.ndarray((len(raw) + 1,), "<u4", padded, strides=(1,))
    out[:] = a[0] + sizes.astype(np.uint64)[:, None] * a[1]
    at, step = np.flatnonzero(sizes <= _LONG), 0
    at = at[sizes[at] > 0]
    while len(at):
        left = np.minimum(sizes[at] - step, 4).astype(np.uint64)
        part = part_at[starts[at] + step].astype(np.uint64) & (np.uint64(0xFFFFFFFF) >> (np.uint64(32) - np.uint64(8) * left))
        out[at] += part[:, None] * a[2 + step // 4]
        step += 4
        at = at[sizes[at] > step]
    upper = out >> np.uint64(32)
    made = upper[:, ::2] << np.uint64(32) | upper[:, 1::2]
    for i in np.flatnonzero(sizes > _LONG):
        made[i] = np.frombuffer(blake2b(raw[starts[i] : starts[i] + sizes[i]], digest_size=16, key=key[:64]).digest(), np.uint64)
    return made


class Words:
    """Words [^\\x20\\x09-\\x0D]+ of some texts: starts and ends (bytes), doc (row), counts per row, ids.

    Words of these texts are equal if and only if their ids are: a dictionary numbers them. Between blocks, `hash` and `other` are the halves of a
    128-bit keyed hash of each word; whoever doesn't know the key can't choose words whose halves are equal."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lower: bool = False, key: bytes = b""):
        n = len(raw)
        if lower:
            raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
        inside = ~_SPACE[raw]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        self.raw, self.offsets, self.inside, self.key = raw, offsets, inside, key
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], before[1:] = True, ~inside[:-1]
            after[-1], after[:-1] = True, ~inside[1:]
        self.starts = np.flatnonzero(inside & (before | first[:n]))
        self.ends = np.flatnonzero(inside & (after | first[1 : n + 1])) + 1
        self.doc = np.searchsorted(offsets, self.starts, "right") - 1
        self.counts = np.bincount(self.doc, minlength=len(offsets) - 1)
        self.letters = raw[inside]
        self.at = np.concatenate([[0], np.cumsum(self.ends - self.starts)])  # where each word starts in letters

    @cached_property
    def _coded(self) -> pa.DictionaryArray:
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(self.at), pa.py_buffer(self.letters)]).dictionary_encode()

    @cached_property
    def ids(self) -> np.ndarray:
        return self._coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)

    @property
    def distinct(self) -> list[bytes]:
        """The word of each id."""
        return self._coded.dictionary.to_pylist()

    @cached_property
    def _hashes(self) -> np.ndarray:
        raw, off = utf8_parts(self._coded.dictionary)
        return keyed_hashes(raw, off[:-1], np.diff(off), self.key)

    @cached_property
    def hash(self) -> np.ndarray:
        return self._hashes[:, 0][self.ids]

    @cached_property
    def other(self) -> np.ndarray:
        return self._hashes[:, 1][self.ids]

    def joined(self, kept: np.ndarray) -> pa.Array:
        """Each text's kept words, joined by one space."""
        sizes, doc = (self.ends - self.starts)[kept], self.doc[kept]
        last = np.ones(len(doc), bool)
        last[:-1] = doc[1:] != doc[:-1]
        at = np.concatenate([[0], np.cumsum(sizes + ~last)])
        out = np.full(at[-1], 0x20, np.uint8)
        inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[np.repeat(at[:-1], sizes) + inner] = self.letters[np.repeat(self.at[:-1][kept], sizes) + inner]
        ends = at[np.searchsorted(doc, np.arange(len(self.counts) + 1))]
        return pa.LargeStringArray.from_buffers(len(self.counts), pa.py_buffer(ends), pa.py_buffer(out)).cast(pa.string())

    def spaced(self) -> tuple[bytes, np.ndarray]:
        """All words, one space after each, and where each starts there (one entry more than there are words)."""
        sizes = self.ends - self.starts
        at = np.concatenate([[0], np.cumsum(sizes + 1)])
        out = np.full(at[-1], 0x20, np.uint8)
        out[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)] = self.letters
        return out.tobytes(), at


def digests(text: bytes, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """128-bit BLAKE2 digests of text[first : stop], as pairs of 64-bit integers."""
    view = memoryview(text)
    out = b"".join([blake2b(view[a:b], digest_size=16).digest() for a, b in zip(first.tolist(), stop.tolist(), strict=True)])
    return np.frombuffer(out, np.int64).reshape(-1, 2)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive hashes (all start positions, over row bounds too)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9DDFEA08EB382D69) + h[j : j + n]
        out ^= out >> np.uint64(29)
    return mix(out)
