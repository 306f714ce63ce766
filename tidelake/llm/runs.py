"""Periodic run detection: stretches of words that repeat with a period, by counting matches at every lag.

A run of period q is a longest stretch in which words q apart are equal, of at least `least` words and `times` periods, whose smallest
period is q. Word i matches at lag q if word i + q equals it; a run of length n needs n - q matches in a row.

1. Counting. For each text the matches at each lag up to a third (1 / times) of its words: frequent words by autocorrelation of
   their places through FFT, rounded to the exact integers; rare words by the differences of all pairs of their places, for all texts of
   a block in the same steps. A word is frequent if its pairs would cost more than a transform.
2. Scanning. Only lags with as many matches as a shortest run needs are compared word by word for islands of matches, and of the long ones only those where
   a sample of places, so close that a run must hold eight, has eight matches in a row. Islands that are long enough are runs; one with the bounds of a run of a smaller lag is that run again, at a multiple of its period.

Words are compared as themselves (they are numbered by a dictionary of a block's words), never by hashes.

Defined results: null and empty texts have no words and no runs; repeated rows are judged each; a null id stays null; other columns of the
input aren't returned unless kept; an empty table gives an empty result. A text is read whole; memory and time grow with n log n of
its words and the pairs of its rare words, of which there are some n^1.5 at most.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, fresh, row_slices, tidied, utf8_parts

LEAST, TIMES = 24, 3
#: Cost of a transform's point over that of a pair.
FFT_COST = 4
#: Words of a shortest run that are compared before all.
_SAMPLES = 8


def _autocorrelation(at: np.ndarray, most: int, n: int) -> np.ndarray:
    """For lags 0 to most, the pairs of places `at` (of n) that are so far apart."""
    size = 1 << int(n + most).bit_length()
    signal = np.zeros(size)
    signal[at] = 1.0
    f = np.fft.rfft(signal)
    return np.rint(np.fft.irfft(f.real**2 + f.imag**2, size)[: most + 1]).astype(np.int64)


def lag_counts(word: np.ndarray, counts: np.ndarray, times: int = TIMES) -> tuple[np.ndarray, np.ndarray]:
    """(matches, bounds): for each text (counts: its words, one text after another) the matches at lags 0 to its words / times."""
    first = np.concatenate([[0], np.cumsum(counts)])
    most = counts // times
    bounds = np.concatenate([[0], np.cumsum(most + 1)])
    matches = np.zeros(bounds[-1], np.int64)
    doc = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((word, doc))
    new = np.ones(len(order), bool)
    new[1:] = (word[order[1:]] != word[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(order)))
    n = counts[doc[order[start]]]
    heavy = size * size.astype(float) > 2 * FFT_COST * n * np.log2(n + 2)
    for s, k in zip(start[heavy].tolist(), size[heavy].tolist(), strict=True):
        d = doc[order[s]]
        matches[bounds[d] : bounds[d + 1]] += _autocorrelation(order[s : s + k] - first[d], int(most[d]), int(counts[d]))
    light = np.repeat(~heavy & (size > 1), size)
    place = order[light]
    group = np.repeat(np.arange(len(start)), size)[light]
    here = np.arange(len(place))
    step = 1
    while len(here):  # each place with the step-th next of its word, as long as it is near enough
        here = here[here + step < len(place)]
        here = here[group[here] == group[here + step]]
        if not len(here):
            break
        lag = place[here + step] - place[here]
        near = lag <= most[doc[place[here]]]
        here, lag = here[near], lag[near]
        if len(here):
            _tally(matches, bounds[doc[place[here]]] + lag)
        step += 1
    return matches, bounds


def _tally(matches: np.ndarray, at: np.ndarray) -> None:
    low = int(at.min())
    found = np.bincount(at - low)
    matches[low : low + len(found)] += found


def runs_of(word: np.ndarray, matches: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one text, by start and period. matches: by lag, as lag_counts gives them."""
    lags = np.arange(len(matches))
    need = np.maximum(least - lags, (times - 1) * lags)
    found: dict[tuple[int, int], int] = {}
    for q in (np.flatnonzero(matches[1:] >= need[1:]) + 1).tolist():
        if (step := int(need[q]) // _SAMPLES) > 1:  # a run has _SAMPLES matches in a row among each step-th word
            miss = np.flatnonzero(word[:-q:step] != word[q::step])
            if np.diff(miss, prepend=-1, append=-(-(len(word) - q) // step)).max() <= _SAMPLES:
                continue
        same = np.zeros(len(word) - q + 2, np.int8)
        same[1:-1] = word[q:] == word[:-q]
        edge = np.flatnonzero(np.diff(same))
        begin, end = edge[::2], edge[1::2] + q  # of the stretch, past its last word
        long = end - begin >= max(least, times * q)
        for s, e in zip(begin[long].tolist(), end[long].tolist(), strict=True):
            found.setdefault((s, e), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def find_runs(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), least: int = LEAST, times: int = TIMES) -> DataFrame:
    """keep, n_words, runs (array of start, length and period, by start and period) and collapsed: the words, joined by a space, that no
    run holds after its first period."""
    if taken := {"n_words", "runs", "collapsed"} & {c.lower() for c in keep}:
        raise ValueError(f"kept columns clash with those that find_runs makes: {sorted(taken)}")
    if times < 2 or least < 1:
        raise ValueError("a run has two periods at least, and a word")
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "n_words bigint", "runs array<struct<start:bigint,length:bigint,period:bigint>>", "collapsed string"])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in batches:
            raw, off = utf8_parts(batch.column(len(keep)))
            for i, j in row_slices(off):
                words = Words(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                first = np.concatenate([[0], np.cumsum(words.counts)])
                matches, bounds = lag_counts(words.ids, words.counts, times)
                gone = np.zeros(len(words.ids) + 1, np.int64)
                runs = []
                for d in range(j - i):
                    runs.append(runs_of(words.ids[first[d] : first[d + 1]], matches[bounds[d] : bounds[d + 1]], least, times))
                    for s, n, q in runs[-1]:
                        gone[first[d] + s + q] += 1
                        gone[first[d] + s + n] -= 1
                kept = np.cumsum(gone[:-1]) == 0
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(i, j - i) for k in range(len(keep))), pa.array(words.counts.astype(np.int64)),
                     pa.array([[{"start": s, "length": n, "period": q} for s, n, q in x] for x in runs], kind), words.joined(kept)],
                    [*keep, "n_words", "runs", "collapsed"])

    return df.select(*keep, text_col).mapInArrow(tidied(run), schema)


def plant_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with repeats in the texts of one document of ten, by the check sum of its id: from some word on, its words are those of a period. Other
    texts, and those of a null id, stay as they are."""
    check = F.crc32(F.col(id_col).cast("string"))
    words = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "[ \\t-\\r]+"), lambda w: w != "")
    h, w = fresh("_h", df.columns), fresh("_w", df.columns)
    g, n = F.expr(f"{h} div 10"), F.size(w).cast("long")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    from_a = F.transform(F.sequence(F.lit(0).cast("long"), n - a - 1), lambda i: F.get(F.col(w), (a + i % p).cast("int")))
    made = F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), from_a), " ")
    chosen = (F.col(h) % 10 == 0) & (n > 0)
    marked = df.withColumn(h, check).withColumn(w, F.when(F.col(h) % 10 == 0, words))
    return marked.withColumn(text_col, F.when(chosen, made).otherwise(F.col(text_col))).drop(h, w)
