"""Histogram sort: shards of nearly equal bytes, found by counting and exchanged once.

The sort key of a row is (hash of the text, id), so equal texts stand together and the order is
otherwise a shuffle. Splitters are found by counting, exactly and over all rows, the bytes below
candidate boundaries: each round cuts only the intervals that still hold a splitter into 2**BITS
parts and sums the bytes of each part (one small grouped sum of at most shards * 2**BITS rows to the
driver), until each splitter's error is within the tolerance or its interval is a single key. Rows
are dealt to their shards by comparing keys with the splitters, and moved once; large shards are moved and numbered in parts, whose
splitters are found the same way.

Defined results: a null text has 0 bytes, a null id sorts first, rows with equal key (repeats) cannot be parted by a
splitter, an empty table gives an empty result. All other columns pass through; those named size, shard or slot are replaced.
"""
from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, written

BITS = 12
#: Rows that are numbered in one task, and most such parts of a shard.
PART_ROWS, MOST_PARTS = 500_000, 64
_TOP = 1 << 63


def _parts(key: str, level: int) -> Column:
    """The BITS-wide digit `level` of a 64-bit key in unsigned order (level 0 is the top)."""
    shift = max(0, 64 - BITS * (level + 1))
    width = min(BITS, 64 - BITS * level)
    flipped = F.col(key).bitwiseXOR(F.lit(-_TOP))
    return F.shiftrightunsigned(flipped, shift).bitwiseAND(F.lit((1 << width) - 1)).cast("int")


def _levels() -> int:
    return -(-64 // BITS)


def find_splitters(keys: DataFrame, shards: int, tolerance: float = 0.001) -> list[tuple[int, int]]:
    """Splitters (hash, id) so that shard s holds the keys from splitter s-1 on and below splitter s.

    keys: columns _h, _id (64-bit), _size. Only sums of candidate parts come to the driver."""
    total = keys.agg(F.sum("_size")).first()[0] or 0
    goals = [total * s / shards for s in range(1, shards)]
    slack = tolerance * total / shards
    # an open interval: prefix digits so far -> (bytes below it); each goal follows its own
    open_at: dict[tuple[int, ...], int] = {(): 0}
    where: list[tuple[int, ...]] = [()] * len(goals)
    done: dict[int, tuple[int, ...]] = {}
    columns = ["_h"] * _levels() + ["_id"] * _levels()
    for depth in range(2 * _levels()):
        wanted = sorted({where[g] for g in range(len(goals)) if g not in done})
        if not wanted:
            break
        digit = _parts(columns[depth], depth % _levels())
        inside = keys
        if depth:
            path = [_parts(columns[d], d % _levels()) for d in range(depth)]
            joined = F.concat_ws("/", *[p.cast("string") for p in path])
            inside = keys.withColumn("_path", joined).where(F.col("_path").isin(["/".join(map(str, w)) for w in wanted]))
        else:
            inside = keys.withColumn("_path", F.lit(""))
        found: dict[str, list[tuple[int, int]]] = {}
        for r in inside.groupBy("_path", digit.alias("_digit")).agg(F.sum("_size").alias("_size")).collect():
            found.setdefault(r["_path"], []).append((r["_digit"], r["_size"]))
        below_of: dict[tuple[int, ...], int] = {}
        for w in wanted:
            run, cuts = open_at[w], []
            for digit_value, size in sorted(found.get("/".join(map(str, w)), [])):
                cuts.append((digit_value, run, run + size))
                run += size
            for g in range(len(goals)):
                if g in done or where[g] != w:
                    continue
                digit_value, low, high = next((c for c in cuts if c[2] >= goals[g]), cuts[-1] if cuts else (0, run, run))
                if abs(low - goals[g]) <= slack:
                    done[g] = (*w, digit_value)
                elif abs(high - goals[g]) <= slack:
                    done[g] = (*w, digit_value + 1)
                elif depth == 2 * _levels() - 1:  # a single key: to the nearer side
                    done[g] = (*w, digit_value + (high - goals[g] < goals[g] - low))
                else:
                    where[g] = (*w, digit_value)
                    below_of[where[g]] = low
        open_at = below_of
    digits = [done.get(g, where[g]) for g in range(len(goals))]
    return [_key_of(d) for d in digits]


def _key_of(digits: tuple[int, ...]) -> tuple[int, int]:
    """The least (hash, id) whose digits are these; a digit may be one beyond its range and then carries over."""
    value = 0
    for d in range(2 * _levels()):
        width = min(BITS, 64 - BITS * (d % _levels()))
        value = (value << width) + (digits[d] if d < len(digits) else 0)
    value = min(value, (1 << 128) - 1)
    return (value >> 64) - _TOP, (value & ((1 << 64) - 1)) - _TOP


def shard_by_bytes(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.001, part_rows: int = PART_ROWS) -> DataFrame:
    """df with the new columns size, shard and slot (gapless from 0 in each shard, in key order). Law: bytes.

    Slots are counted inside parts of a shard, about part_rows rows each (at most MOST_PARTS a shard), and shifted by the rows of the parts before."""
    h, i, n, part = (fresh(c, df.columns) for c in ("_h", "_id", "_size", "_part"))
    text = F.col(text_col)
    keyed = df.withColumns({
        h: F.xxhash64(text),
        i: F.coalesce(F.col(id_col).cast("long"), F.lit(-_TOP)),
        n: F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8,
    })
    keys = written(keyed.select(F.col(h).alias("_h"), F.col(i).alias("_id"), F.col(n).alias("_size")), "shard-keys")  # text is read once, not once a round
    cuts = find_splitters(keys, shards, tolerance)
    parts = max(1, min(MOST_PARTS, -(-keys.count() // (shards * part_rows))))
    finer = find_splitters(keys, shards * parts, 0.5) if parts > 1 else []
    inner = [sorted({x for x in finer if bisect_right(cuts, x) == s} - set(cuts)) for s in range(shards)]

    def dealt(rows: DataFrame, hc: str, ic: str) -> DataFrame:
        shard = F.lit(0)
        for cut, key in cuts:
            shard = shard + F.when((F.col(hc) > cut) | ((F.col(hc) == cut) & (F.col(ic) >= key)), 1).otherwise(0)
        rows = rows.withColumn("shard", shard.cast("int"))
        place = F.lit(0)
        for s, own in enumerate(inner):
            if own:
                passed = F.filter(F.array(*(F.struct(F.lit(a).alias("h"), F.lit(b).alias("i")) for a, b in own)), lambda x: (x["h"] < F.col(hc)) | ((x["h"] == F.col(hc)) & (x["i"] <= F.col(ic))))
                place = F.when(F.col("shard") == s, F.size(passed)).otherwise(place)
        return rows.withColumn(part, place.cast("int"))

    counted = dealt(keys, "_h", "_id").groupBy("shard", part).agg(F.count(F.lit(1)).alias("_rows"))  # shards * MOST_PARTS rows at most
    before = Window.partitionBy("shard").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    shift, where, which = (fresh(c, df.columns) for c in ("_shift", "_in", "_of"))
    shifts = counted.select(F.col("shard").alias(which), F.col(part).alias(where), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias(shift))
    order = Window.partitionBy("shard", part).orderBy(h, i, n)
    numbered = dealt(keyed.withColumn("size", F.col(n)), h, i).withColumn("slot", (F.row_number().over(order) - 1).cast("long"))
    joined = numbered.join(F.broadcast(shifts), (F.col("shard") == F.col(which)) & (F.col(part) == F.col(where)))
    return joined.withColumn("slot", F.col("slot") + F.col(shift)).drop(h, i, n, part, shift, where, which)


def shard_of(key: tuple[int, int], splitters: list[tuple[int, int]]) -> int:
    """The shard of one key (for tests)."""
    return bisect_right(splitters, key)
