"""Conversation structure repair: the cheapest edits that give a conversation legal turns, by shortest paths.

A conversation's rows, in order, and the states of the role grammar make a layered graph: an arc keeps, re-roles or deletes the next row or
inserts an empty turn. Costs are small integers, so distances to the end come from Dial's bucket queue: nodes are settled bucket by
bucket, without a heap. The audit is the walk from the start over tight arcs (those that lie on a cheapest path) that always takes the
least letter, so it is the least of all cheapest audits. Letters: D delete, I insert, K keep, R re-role.

States: 0 nothing yet, 1 after a system turn, 2 after a user turn, 3 after an assistant turn; 0 and 3 may end. Roles count by their
first letter. Blank rows and rows whose role and text came before in the conversation must go; a truncated row (whose last sign that
isn't white space is none of . ! ?) that stays adds a cost.

Rows are sorted once by ranges of (conversation, turn, role, text). A conversation that lies inside a task's range is repaired there. One
that crosses ranges, or is longer than a fragment (LIMIT_ROWS rows, LIMIT_CHARS signs), is kept as fragments: repeated rows are found by
grouped minima of digests, each fragment gives its 4 by 4 matrix of distances between states, sums of these along the
conversation (a row of 16 numbers for a fragment) give the distances at each fragment's end, maps of states give the state at
each start, and then all fragments are walked side by side. So no task holds a long conversation; only its
digest, which is sequential by nature, is fed piece by piece in one task.

Defined results: null roles and texts count as one space, as null turns and ids do where they are written out; null turns come first;
rows of one turn are ordered by role and text; repeated rows are rows of their own, and faulty as repeats; a null id is a conversation
of its own; other columns aren't returned; an empty table gives an empty result; texts of any length are taken whole.
"""
from __future__ import annotations

from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, tidied, written

LIMIT_ROWS, LIMIT_CHARS = 4096, 1 << 22
RE_ROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
_BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: Per state: the letter and role of the turn that comes next and the state it leads to; a system turn may only come first.
NEXT = (("u", "user", 2), ("u", "user", 2), ("a", "assistant", 3), ("u", "user", 2))
#: Cost and turns that complete a conversation from each state.
TAIL = ((0, ()), (2 * INSERT, ("user", "assistant")), (INSERT, ("assistant",)), (0, ()))
_FAR = 1 << 60
_BLANK, _CUT = 1, 2  # of a row: must go, stays at a cost


def _arcs(state: int, letter: str, flag: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) of a row in a state, by the edits' letters."""
    out = [("D", DELETE, state)]
    if flag != _BLANK:
        extra = CUT if flag == _CUT else 0
        wanted, _, to = NEXT[state]
        if letter == wanted:
            out.append(("K", extra, to))
        elif state == 0 and letter == "s":
            out.append(("K", extra, 1))
        if letter != wanted:
            out.append(("R", RE_ROLE + extra, to))
    return out


#: (arcs into each state) of a row, by its letter and flag: (state before, cost).
_INTO = {(letter, flag): tuple(tuple((s, cost) for s in range(4) for _, cost, to in _arcs(s, letter, flag) if to == t) for t in range(4))
         for letter in ("s", "u", "a", "") for flag in (0, _BLANK, _CUT)}
_INSERTS_INTO = ((), (), (0, 1, 3), (2,))


def _known(letter: str) -> str:
    return letter if letter in ("s", "u", "a") else ""


def distances(letters: list[str], flags: list[int], ends: list[int]) -> list[list[int]]:
    """The cost from before each row (and after the last), in each state, to the end, whose costs by state are `ends`. Turns are inserted before rows only."""
    n = len(letters)
    dist = [[_FAR] * 4 for _ in range(n)] + [list(ends)]
    least = min(ends)
    buckets: list[list[tuple[int, int]]] = [[] for _ in range(1 + max(e - least for e in ends if e < _FAR))]
    for s, e in enumerate(ends):
        if e < _FAR:
            buckets[e - least].append((n, s))
    d = 0
    while d < len(buckets):
        for i, t in buckets[d]:  # grows by arcs without cost
            if dist[i][t] != d + least:
                continue
            arcs = [(i, s, INSERT) for s in _INSERTS_INTO[t]] if i < n else []
            if i:
                arcs += [(i - 1, s, cost) for s, cost in _INTO[_known(letters[i - 1]), flags[i - 1]][t]]
            for j, s, cost in arcs:
                to = d + cost
                if to + least < dist[j][s]:
                    dist[j][s] = to + least
                    while len(buckets) <= to:
                        buckets.append([])
                    buckets[to].append((j, s))
        buckets[d] = []
        d += 1
    return dist


def walk(letters: list[str], flags: list[int], dist: list[list[int]], state: int) -> tuple[str, int]:
    """(the least audit from `state` over tight arcs, the state after the last row)."""
    out, i, n = [], 0, len(letters)
    while i < n:
        here = dist[i][state]
        inserted = NEXT[state][2]
        for edit, cost, to in sorted([*_arcs(state, _known(letters[i]), flags[i]), ("I", INSERT, inserted)]):
            if cost + dist[i if edit == "I" else i + 1][to] == here:
                break
        out.append(edit)
        i += edit != "I"
        state = to
    return "".join(out), state


def repaired_turns(audit: str, roles: list[str], texts: list[str], state: int) -> list[tuple[str, str]]:
    """(role, text) of the turns that the edits leave, from the state before them."""
    out, i = [], 0
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        role, text = (NEXT[state][1], "") if edit == "I" else (roles[i], texts[i]) if edit == "K" else (NEXT[state][1], texts[i])
        out.append((role, text))
        state = 1 if edit == "K" and role[:1] == "s" else NEXT[state][2]
        i += edit != "I"
    return out


def illegal_pairs(letters: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:], strict=False))


def is_blank(text: str) -> bool:
    return not text.strip(_BLANKS)


def is_cut(text: str) -> bool:
    return text.rstrip(_BLANKS)[-1:] not in (".", "!", "?")


def _digest(conv, role: str, text: str) -> bytes:
    return blake2b("\0".join((repr(conv), str(len(role)), role, text)).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _turn_rows(turns: list[tuple[str, str]]) -> list[dict]:
    return [{"role": r, "text": t} for r, t in turns]


def turns_digest(turns, into=None, empty: bool = True):
    """(SHA-256 of role:text joined by newlines, whether nothing was fed so far); feeds `into` if given."""
    h = into or sha256()
    for role, text in turns:
        h.update(("" if empty else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        empty = False
    return h, empty


_TURNS = "array<struct<role:string,text:string>>"
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_KIND = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def _whole(roles: list[str], texts: list[str], turns: list) -> dict:
    """The result of a conversation that lies in one task."""
    letters, seen, flags, n = [r[:1] for r in roles], set(), [], [0, 0, 0]
    for role, text in zip(roles, texts, strict=True):
        fault = 0 if is_blank(text) else 1 if (role, text) in seen else 2 if is_cut(text) else 3
        seen.add((role, text))
        flags.append((_BLANK, _BLANK, _CUT, 0)[fault])
        if fault < 3:
            n[fault] += 1
    dist = distances(letters, flags, [c for c, _ in TAIL])
    audit, state = walk(letters, flags, dist, 0)
    made = repaired_turns(audit, roles, texts, 0) + [(r, "") for r in TAIL[state][1]]
    known = {t for t in turns if t is not None}
    return {"gaps": max(known) - min(known) + 1 - len(known) if known else 0, "blank": n[0], "duplicate": n[1], "truncated": n[2], "illegal": illegal_pairs(letters),
            "cost": dist[0][0], "audit": audit + "I" * len(TAIL[state][1]), "turns": _turn_rows(made), "sha": turns_digest(made)[0].hexdigest()}


def _read(limit_rows: int, limit_chars: int, conv_type: pa.DataType):
    """From rows sorted by conversation: results of whole conversations (frag null) and fragments of those that may go on elsewhere."""
    fields = [("conv", conv_type), ("frag", pa.int64()), *((c, pa.int64()) for c in _COUNTS), ("audit", pa.string()), ("turns", _KIND), ("sha", pa.string()),
              ("numbers", pa.list_(pa.int64())), ("digests", pa.binary())]
    schema = pa.schema(fields)

    def run(batches):
        part = TaskContext.get().partitionId() << 40
        at = 0  # rows so far
        held: tuple[list, list, list] = ([], [], [])  # turns, roles, texts of the conversation that is open
        of, chars, broken, out = None, 0, True, []  # broken: it began, or may have begun, before what is held

        def fragment() -> dict:
            turns, roles, texts = held
            return {"conv": of, "frag": part + at - len(roles), "turns": _turn_rows(list(zip(roles, texts, strict=True))), "numbers": turns,
                    "digests": b"".join(_digest(of, r, t) for r, t in zip(roles, texts, strict=True))}

        for batch in batches:
            for conv, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if held[0] and (conv != of or len(held[0]) >= limit_rows or chars >= limit_chars):
                    more = conv == of
                    out.append(fragment() if broken or more else {"conv": of, **_whole(held[1], held[2], held[0])})
                    held, chars, broken = ([], [], []), 0, more
                of = conv
                at += 1
                for column, value in zip(held, (turn, role, text), strict=True):
                    column.append(value)
                chars += len(text)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if held[0]:
            yield pa.RecordBatch.from_pylist([fragment()], schema=schema)

    return run


def _flags(texts: list[str], repeats) -> tuple[list[int], list[int]]:
    """(flags, faults counted) of a fragment's rows; repeats: the places of rows that came before."""
    again, flags, n = set(repeats or ()), [], [0, 0, 0]
    for i, text in enumerate(texts):
        fault = 0 if is_blank(text) else 1 if i in again else 2 if is_cut(text) else 3
        flags.append((_BLANK, _BLANK, _CUT, 0)[fault])
        if fault < 3:
            n[fault] += 1
    return flags, n


def _matrices(batches):
    """(conv, frag, matrix, letters, flags, counts of faults and illegal pairs) of fragments with the places of their repeats."""
    for batch in batches:
        out = []
        for conv, frag, turns, again in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            letters = [t["role"][:1] for t in turns]
            flags, n = _flags([t["text"] for t in turns], again)
            columns = [distances(letters, flags, [0 if s == t else _FAR for s in range(4)])[0] for t in range(4)]
            out.append((conv, frag, [columns[t][s] for s in range(4) for t in range(4)], letters, flags, [*n, illegal_pairs(letters)]))
        yield pa.RecordBatch.from_arrays([
            pa.array([x[0] for x in out], batch.column(0).type), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.list_(pa.int64())),
            pa.array([x[3] for x in out], pa.list_(pa.string())), pa.array([x[4] for x in out], pa.list_(pa.int64())), pa.array([x[5] for x in out], pa.list_(pa.int64()))],
            ["conv", "frag", "matrix", "letters", "flags", "counts"])


def _ends(batches):
    """From matrices sorted by conversation and fragment, last first: (frag, the cost to complete from each state at the fragment's end)."""
    of, ends = None, None
    for batch in batches:
        made = []
        for conv, matrix in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if (conv,) != of:
                of, ends = (conv,), [c for c, _ in TAIL]
            made.append(ends)
            ends = [min(min(matrix[4 * s + t] + ends[t] for t in range(4)), _FAR) for s in range(4)]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(made, pa.list_(pa.int64()))], ["frag", "ends"])


def _exits(batches):
    """(conv, frag, the state at the fragment's end by that at its start) of fragments with their ends' costs."""
    for batch in batches:
        made = []
        for letters, flags, ends in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
            dist = distances(letters, flags, ends)
            made.append([walk(letters, flags, dist, s)[1] for s in range(4)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.list_(pa.int64()))], ["conv", "frag", "exits"])


def _entries(batches):
    """From exits sorted by conversation and fragment: (frag, state at its start)."""
    of, state = None, 0
    for batch in batches:
        made = []
        for conv, exits in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if (conv,) != of:
                of, state = (conv,), 0
            made.append(state)
            state = exits[state]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(made, pa.int64())], ["frag", "entry"])


def _walked(batches):
    """(conv, frag, turns, audit, state at the end, cost from the start) of fragments with flags, ends and entries."""
    for batch in batches:
        out = []
        for conv, frag, turns, flags, ends, entry in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            roles, texts = [t["role"] for t in turns], [t["text"] for t in turns]
            letters = [r[:1] for r in roles]
            dist = distances(letters, flags, ends)
            audit, state = walk(letters, flags, dist, entry)
            out.append((conv, frag, _turn_rows(repaired_turns(audit, roles, texts, entry)), audit, state, dist[0][entry]))
        yield pa.RecordBatch.from_arrays([
            pa.array([x[0] for x in out], batch.column(0).type), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], _KIND),
            pa.array([x[3] for x in out], pa.string()), pa.array([x[4] for x in out], pa.int64()), pa.array([x[5] for x in out], pa.int64())],
            ["conv", "frag", "turns", "audit", "state", "cost"])


def _digested(conv_type: pa.DataType):
    """From walked fragments sorted by conversation and fragment: (conv, cost, audit, sha)."""

    def run(batches):
        of, h, empty, audit, cost, state = (None, None), None, True, [], 0, 0

        def done() -> pa.RecordBatch:
            tail = TAIL[state][1]
            turns_digest([(r, "") for r in tail], h, empty)
            return pa.RecordBatch.from_arrays([pa.array([of[0]], conv_type), pa.array([cost], pa.int64()), pa.array(["".join(audit) + "I" * len(tail)]), pa.array([h.hexdigest()])],
                                              ["conv", "cost", "audit", "sha"])

        for batch in batches:
            for i in range(batch.num_rows):
                conv, turns, piece, to, from_here = (batch.column(k)[i].as_py() for k in (0, 2, 3, 4, 5))
                if h is None or (conv, 1) != of:
                    if h is not None:
                        yield done()
                    of, h, empty, audit, cost = (conv, 1), sha256(), True, [], from_here
                h, empty = turns_digest([(t["role"], t["text"]) for t in turns], h, empty)
                audit.append(piece)
                state = to
        if h is not None:
            yield done()

    return run


def repair(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           limit_rows: int = LIMIT_ROWS, limit_chars: int = LIMIT_CHARS) -> tuple[DataFrame, DataFrame]:
    """(results, turns) of the conversations in df. Results: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, sha.
    Turns: conv, frag (null, or the order of the pieces of a long conversation), state (after the piece; null where whole) and turns (array of role and text, after repair)."""
    conv = df.schema[conv_col].dataType
    name = conv.simpleString()
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(role_col, F.lit(" ")).alias("role"),
                     F.coalesce(text_col, F.lit(" ")).alias("text"), F.monotonically_increasing_id().alias("tie"))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "tie"]
    arrow = df.sparkSession.createDataFrame([], f"conv {name}").toArrow().schema.field("conv").type
    schema = f"conv {name}, frag bigint, {', '.join(f'{c} bigint' for c in _COUNTS)}, audit string, turns {_TURNS}, sha string, numbers array<bigint>, digests binary"
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    read = written(ranged.mapInArrow(tidied(_read(limit_rows, limit_chars, arrow)), schema), "conversations")
    whole, open_ = read.where("frag IS NULL"), read.where("frag IS NOT NULL")

    # rows that came before: by the least place of each digest (of conversation, role and text)
    place = F.posexplode(F.sequence(F.lit(0), F.size("numbers") - 1)).alias("i", "i_")
    rows = open_.select("frag", "digests", place).select("frag", "i", F.expr("substring(digests, 16 * i + 1, 16)").alias("digest"))
    known = rows.groupBy("digest").agg(F.min(F.struct("frag", "i")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = join_counted(rows, written(known, "repeated-rows"), ["digest"], "inner").where(F.struct("frag", "i") > F.col("first"))
    repeats = written(later.groupBy("frag").agg(F.collect_list("i").alias("again")), "repeats")  # a fragment's rows at most

    shape = written(open_.select("conv", "frag", "turns").join(repeats, "frag", "left").select("conv", "frag", "turns", "again").mapInArrow(
        tidied(_matrices), f"conv {name}, frag bigint, matrix array<bigint>, letters array<string>, flags array<bigint>, counts array<bigint>"), "matrices")
    chain = lambda d, last_first=False: d.repartition("conv").sortWithinPartitions("conv", F.col("frag").desc() if last_first else "frag")
    ends = written(chain(shape.select("conv", "frag", "matrix"), True).mapInArrow(_ends, "frag bigint, ends array<bigint>"), "ends")
    known_ends = shape.select("conv", "frag", "letters", "flags").join(ends, "frag").select("conv", "frag", "letters", "flags", "ends")
    exits = known_ends.mapInArrow(tidied(_exits), f"conv {name}, frag bigint, exits array<bigint>")
    entries = written(chain(exits).mapInArrow(_entries, "frag bigint, entry bigint"), "entries")
    full = open_.select("conv", "frag", "turns").join(shape.select("frag", "flags").join(ends, "frag").join(entries, "frag"), "frag")
    walked = written(full.select("conv", "frag", "turns", "flags", "ends", "entry").mapInArrow(
        tidied(_walked), f"conv {name}, frag bigint, turns {_TURNS}, audit string, state bigint, cost bigint"), "walked")
    digested = chain(walked).mapInArrow(tidied(_digested(arrow)), f"conv {name}, cost bigint, audit string, sha string")

    # sums over a conversation's fragments; pairs of neighbouring fragments; numbers of turns
    edge = shape.select("conv", F.struct("frag", F.element_at("letters", 1).alias("a"), F.element_at("letters", -1).alias("z"), F.col("counts").alias("c")).alias("e"))
    edges = edge.groupBy("conv").agg(F.sort_array(F.collect_list("e")).alias("es"))  # a row of few numbers for each fragment
    seam = F.aggregate(F.sequence(F.lit(1), F.size("es")), F.lit(0).cast("long"), lambda acc, i: acc + F.when(
        (i < F.size("es")) & ~F.concat(F.element_at("es", i)["z"], F.element_at("es", F.least(i + 1, F.size("es")))["a"]).isin("su", "ua", "au"), 1).otherwise(0))
    total = lambda k: F.aggregate("es", F.lit(0).cast("long"), lambda acc, e: acc + e["c"][k])
    summed = edges.select("conv", total(0).alias("blank"), total(1).alias("duplicate"), total(2).alias("truncated"), (total(3) + seam).alias("illegal"))
    numbers = open_.select("conv", F.explode("numbers").alias("turn")).where("turn IS NOT NULL").distinct()
    gaps = numbers.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))
    same = lambda d, as_: d.withColumnRenamed("conv", as_)
    long = digested.join(same(summed, "s"), F.col("conv").eqNullSafe(F.col("s"))).join(same(gaps, "g"), F.col("conv").eqNullSafe(F.col("g")), "left")
    cols = ["conv", *_COUNTS, "audit", "sha"]
    results = whole.select(*cols).unionByName(long.withColumn("gaps", F.coalesce("gaps", F.lit(0).cast("long"))).select(*cols))
    return results, whole.select("conv", "frag", F.lit(None).cast("long").alias("state"), "turns").unionByName(walked.select("conv", "frag", "state", "turns"))


def damage(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of conversations, damaged by the check sum of each row's conversation and turn: lost, emptied, cut, repeated, re-roled."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    rows = df.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("_kind")).where("_kind != 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), twice.alias("_")).drop("_")
