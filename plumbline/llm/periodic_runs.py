"""Periodic runs: stretches of words that repeat with a period, found by recursive frequency splitting and a lag scan.

In a run of period q and at least MOST_OFTEN * q words every word stands MOST_OFTEN times or more. So a word that is
rarer than that within its segment is in no run, and splits the segment; the parts are counted anew, until nothing splits.
Only segments that were split are counted again, and most texts leave nothing over.

What survives is scanned for lags. For lags from P to 2P the blocks of P words at multiples of P are compared with the
blocks P to 2P words further on: a run of such a period is at least 4P long and holds such a block with its copy. Meetings of
neighbouring blocks are joined, and the stretch is extended on both sides by halving steps, so the scan takes
O(n log n) for a segment of n words whatever its words are. A stretch that a shorter period explains is that period's run.
All texts of a batch are taken at once, in numpy.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._shared import rows_out, slices

#: Words of the shortest run, and how often a run repeats its period at least.
LEAST, MOST_OFTEN = 6, 4
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())])
MIX, ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of blocks from those of their two halves."""
    h = (a ^ (b * MIX + (a << np.uint64(7)) + (a >> np.uint64(3)))) * ODD
    return h ^ (h >> np.uint64(32))


def _survivors(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, segment): the places that are left when no segment has a rare word, and the number of each place's segment."""
    n_ids = int(words.max()) + 1 if len(words) else 1
    at, segment, done, made = np.arange(len(words)), doc.astype(np.int64), [], 0
    while len(at):
        key = segment * n_ids + words[at]
        order = np.argsort(key, kind="stable")
        edge = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
        times = np.empty(len(at), np.int64)
        times[order] = np.repeat(np.diff(np.append(edge, len(at))), np.diff(np.append(edge, len(at))))
        kept = times >= MOST_OFTEN
        # segments that lose no word are stable
        split = np.zeros(int(segment[-1]) + 1, bool)
        split[segment[~kept]] = True
        changed = split[segment]
        if not changed.all():
            still, number = at[~changed], segment[~changed]
            _, number = np.unique(number, return_inverse=True)
            done.append((still, number + made))
            made += int(number[-1]) + 1
        kept &= changed
        at, segment = at[kept], segment[kept]
        if len(at):
            first = np.append(True, (np.diff(at) != 1) | (np.diff(segment) != 0))
            segment = np.cumsum(first) - 1
            long = np.bincount(segment) >= LEAST
            at, segment = at[long[segment]], segment[long[segment]]
    if not done:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at, segment = np.concatenate([x[0] for x in done]), np.concatenate([x[1] for x in done])
    long = np.bincount(segment) >= LEAST
    at, segment = at[long[segment]], segment[long[segment]]
    order = np.argsort(at)
    return at[order], segment[order]


def _scan(words: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """(start, length, period) of every run in segments that lie one after the other."""
    n = len(words)
    edge = np.append(True, np.diff(segment) != 0)
    size = np.diff(np.append(np.flatnonzero(edge), n))
    begin, end = np.repeat(np.flatnonzero(edge), size), np.repeat(np.flatnonzero(edge) + size, size)
    levels = [_pairs(words.astype(np.uint64), words.astype(np.uint64) + MIX)]
    found, P = [], 1
    while size.max() >= max(LEAST, MOST_OFTEN * P):
        # block i of P words against the block p words further on, both inside the segment
        anchor = np.flatnonzero(np.arange(n) % P == 0)
        anchor = anchor[end[anchor] - begin[anchor] >= max(LEAST, MOST_OFTEN * P)]
        block, lags = levels[-1], np.arange(P, 2 * P)
        at, lag = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        step = max(1, (1 << 20) // P)
        for k in range(0, len(anchor), step):
            a = anchor[k : k + step]
            other = a[:, None] + lags
            inside = other + P <= end[a][:, None]
            i, j = np.nonzero(inside & (block[a][:, None] == block[np.where(inside, other, 0)]))
            at.append(a[i])
            lag.append(lags[j])
        at, lag = np.concatenate(at), np.concatenate(lag)
        if len(at):
            order = np.lexsort((at, lag))
            at, lag = at[order], lag[order]
            new = np.append(True, (np.diff(lag) != 0) | (np.diff(at) != P) | (begin[at[1:]] != begin[at[:-1]]))
            lo, p = at[new], lag[new]
            hi = at[np.append(new[1:], True)] + P  # places lo..hi equal those p further on
            for k in range(len(levels) - 1, -1, -1):
                s = 1 << k
                other, same = hi + p, levels[k]
                ok = other + s <= end[lo]
                hi = hi + np.where(ok & (same[np.where(ok, hi, 0)] == same[np.where(ok, other, 0)]), s, 0)
                ok = lo - s >= begin[lo]
                lo = lo - np.where(ok & (same[np.where(ok, lo - s, 0)] == same[np.where(ok, lo - s + p, 0)]), s, 0)
            length = hi + p - lo
            good = length >= np.maximum(LEAST, MOST_OFTEN * p)
            found.append(np.stack([lo[good], length[good], p[good]], 1))
        P *= 2
        if size.max() >= max(LEAST, MOST_OFTEN * P):
            half = levels[-1]
            whole = np.zeros(n, np.uint64)
            whole[: n - P + 1] = _pairs(half[: n - P + 1], half[P // 2 : n - P + 1 + P // 2]) if n >= P else whole[:0]
            levels.append(whole)
    if not found:
        return np.empty((0, 3), np.int64)
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    return runs[np.append(True, (np.diff(runs[:, 0]) != 0) | (np.diff(runs[:, 1]) != 0))]  # of equal stretches the least period


def find(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Rows (place, length, period) of all runs of texts that lie one after the other; doc: the text's number at each place, not falling."""
    at, segment = _survivors(words, doc)
    if not len(at):
        return np.empty((0, 3), np.int64)
    runs = _scan(words[at], segment)
    runs[:, 0] = at[runs[:, 0]]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, texts in slices(batch.column(1).cast(pa.binary())):
            ids = defaultdict(count().__next__)
            each = [(t or b"").split() for t in texts]  # splits at the bytes 32 and 9 to 13, as WORD does
            n = np.fromiter(map(len, each), np.int64, len(each))
            words = np.fromiter((ids[w] for x in each for w in x), np.int64, int(n.sum()))
            base = np.append(0, np.cumsum(n))
            runs = find(words, np.repeat(np.arange(len(n)), n))
            owner = np.searchsorted(base, runs[:, 0], "right") - 1
            runs[:, 0] -= base[owner]
            cuts = np.searchsorted(owner, np.arange(len(n) + 1)).tolist()
            collapsed = []
            for k, x in enumerate(each):
                if cuts[k] < cuts[k + 1]:
                    gone = np.zeros(len(x) + 1, np.int64)
                    own = runs[cuts[k] : cuts[k + 1]]
                    np.add.at(gone, own[:, 0] + own[:, 2], 1)
                    np.add.at(gone, own[:, 0] + own[:, 1], -1)
                    x = [x[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
                collapsed.append(b" ".join(x))
            listed = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([pa.array(runs[:, i]) for i in range(3)], fields=list(RUN)))
            yield rows_out({"doc_id": batch.column(0).slice(a, b - a), "n_words": n, "runs": listed, "collapsed": pa.array(collapsed, pa.binary()).cast(pa.string())}, SCHEMA)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) per row: all runs by start, then period, and the words that no run repeats, joined by one space.

    A run is a stretch with smallest period q and at least max(6, 4 q) words that no neighbour extends keeping q; runs may
    overlap. `collapsed` drops what lies after the first q words of a run. Null, empty and blank texts have no words and no runs; repeated
    rows are judged each, a null id stays null. Only the id and the text are read, so other columns cannot clash; an empty table gives an empty
    result. Texts are judged whole, a very long one by itself in some hundred bytes a word; there is no shuffle.
    """
    kinds = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_found, kinds)


def digest(found: DataFrame) -> DataFrame:
    """One row per document: number of runs, the longest one (ties: smallest start, then period) and hashes of all runs and of the collapsed text."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r.length).alias("shorter"), r.start.alias("start"), r.period.alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))), "")
    top = found.withColumn("best", best)
    length = -F.col("best.shorter")
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        F.expr("(1000 * -best.shorter) div best.period").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words",
    )
