"""Periodic runs of words, found by recursive frequency splitting.

A run is a stretch of words in which words q apart are identical, q being its
smallest period, of at least `least` = 12 and 2q words, that no neighbouring
word extends keeping q.  In a run every word occurs at least twice.  So:

1. Within each segment (at first a whole text) the occurrences of every word are
   counted.  A word that occurs once there can be part of no run of the segment,
   so it splits the segment.  Pieces shorter than `least` words go, changed pieces
   are counted again, until no segment changes.
2. The segments left are scanned by lag: every stretch of words that equal the
   word p further on, for every lag p up to half of a segment.  Lags below 8 are
   compared word by word.  For lags of 2^k to 2^(k+1) - 1 a stretch holds at least
   2^k pairs, and so a whole aligned block of 2^(k-1) words: blocks are compared
   by hash with the windows 2^k to 2^(k+1) - 1 words further on, and each agreement
   is extended both ways over windows of halving length.
3. Of stretches with the same start and end the smallest period stays.  The words
   of what is found are compared once more; hashes only lead there.

All texts of a slice (some 4 MiB) are worked on at once.

Defined results: words are cut at ASCII white space and compared byte by byte.  A
null text is one without words.  Rows with a null or repeated doc_id are judged
row by row, so order, ties and repeated rows do not matter.  Empty tables give
empty results, other columns do not take part.  A very long text is searched
whole, with memory in proportion to it; a text is not split over tasks.  There is no
shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeaudit.llm.wordcodes import codes, slices, split_words

LEAST = 12
NEAR = 8  # lags below are compared word by word
BLOCK = 1 << 20  # comparisons of one step


def segments(code: np.ndarray, row: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the words of all segments in which every word occurs twice or more, and each one's segment."""
    at, segment = np.arange(len(code)), row.astype(np.int64)
    left: list[np.ndarray] = []
    while at.size:
        start = np.append(True, (segment[1:] != segment[:-1]) | (at[1:] != at[:-1] + 1))
        number = np.cumsum(start) - 1
        long = (np.bincount(number) >= least)[number]
        at, number = at[long], number[long]
        if not at.size:
            break
        _, which, n = np.unique(number * (int(code.max()) + 1) + code[at], return_inverse=True, return_counts=True)
        rare = n[which] < 2
        split = np.zeros(number[-1] + 1, bool)
        split[number[rare]] = True
        done = ~split[number]
        left.append(at[done])
        again = ~done & ~rare
        at, segment = at[again], number[again]
    found = np.sort(np.concatenate(left)) if left else at
    # A removed word always stands between two segments of one text.
    new = np.append(True, (found[1:] != found[:-1] + 1) | (row[found[1:]] != row[found[:-1]])) if found.size else np.empty(0, bool)
    return found, np.cumsum(new) - 1


def _window_hashes(x: np.ndarray, most: int, seed: int) -> list[np.ndarray]:
    """For every power of two up to `most`, a hash of the window of so many numbers from each place on."""
    drawn = np.random.default_rng(seed).integers(0, 2 ** 64, int(x.max()) + 1, dtype=np.uint64)
    out, size = [drawn[x]], 1
    while size * 2 <= min(most, len(x)):
        mixed = out[-1][:-size] * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(31)
        out.append((mixed + out[-1][size:]) * np.uint64(0xD6E8FEB86659FD93))
        size *= 2
    return out


def _extended(hashes: list[np.ndarray], a: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and one past the last place of the stretch around a whose numbers equal those p further on."""
    low, high = a.copy(), a.copy()
    for k in range(len(hashes) - 1, -1, -1):
        h, size = hashes[k], 1 << k
        go = np.flatnonzero(high + p < len(h))
        go = go[h[high[go]] == h[high[go] + p[go]]]
        high[go] += size
        go = np.flatnonzero((low >= size) & (low - size + p < len(h)))
        go = go[h[low[go] - size] == h[low[go] - size + p[go]]]
        low[go] -= size
    return low, high


def lag_scan(code: np.ndarray, segment: np.ndarray, least: int = LEAST, seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs; segments stand one after another in code."""
    none = np.empty(0, np.int64)
    if not code.size:
        return none, none, none
    # A word has another number in every segment, so that nothing agrees across segments.
    _, x = np.unique(segment * (int(code.max()) + 1) + code, return_inverse=True)
    size = np.bincount(segment)
    starts, lengths, periods = [], [], []

    def take(low: np.ndarray, high: np.ndarray, p: np.ndarray) -> None:
        good = (high - low >= p) & (high - low + p >= least)
        starts.append(low[good]), lengths.append((high - low + p)[good]), periods.append(p[good])

    # Of the runs of period q < NEAR at each place, the furthest end and its q: the stretches of lags q divides are the same runs.
    furthest, inside = np.zeros(len(x), np.int64), np.ones(len(x), np.int64)
    for p in range(1, min(NEAR, len(x))):
        edges = np.diff(np.concatenate([[False], x[:-p] == x[p:], [False]]).astype(np.int8))
        low, high = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        take(low, high, np.full(len(low), p))
        low, high = low[high - low >= NEAR], high[high - low >= NEAR] + p
        total = np.cumsum(high - low)
        if total.size:
            place = np.arange(total[-1]) + np.repeat(low - np.append(0, total[:-1]), high - low)
            end = np.repeat(high, high - low)
            place, end = place[end > furthest[place]], end[end > furthest[place]]
            furthest[place], inside[place] = end, p
    hashes = _window_hashes(x, int(size.max()), seed) if size.max() >= 2 * NEAR else []
    lag = NEAR
    while 2 * lag <= size.max():
        block = lag // 2
        anchors = np.arange(0, len(x) - block + 1, block)
        anchors = anchors[size[segment[anchors]] >= 2 * lag]
        h = hashes[block.bit_length() - 1]
        lags = np.arange(lag, 2 * lag)
        for i in range(0, len(anchors), max(1, BLOCK // lag)):
            some = anchors[i: i + max(1, BLOCK // lag)]
            there = some[:, None] + lags[None, :]
            same = (there < len(h)) & (h[some][:, None] == h[np.minimum(there, len(h) - 1)])
            which, p = np.nonzero(same)
            a = some[which]
            new = (lags[p] % inside[a] != 0) | (a + block + lags[p] > furthest[a])
            which, p = which[new], p[new]
            if which.size:
                low, high = _extended(hashes, some[which], lags[p])
                found = np.unique(np.stack([low, high, lags[p]]), axis=1)
                take(*found)
        lag *= 2
    start, length, period = np.concatenate(starts), np.concatenate(lengths), np.concatenate(periods)
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    first = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])) if start.size else np.empty(0, bool)
    start, length, period = start[first], length[first], period[first]
    for s, n, p in zip(start.tolist(), length.tolist(), period.tolist()):
        if not np.array_equal(x[s:s + n - p], x[s + p:s + n]):
            return lag_scan(code, segment, least, seed + 1)  # two windows with one hash: draw other hashes
    return start, length, period


def runs(code: np.ndarray, row: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (in the words of all rows), length and period of the runs of all rows, by start and period."""
    at, segment = segments(code, row, least)
    start, length, period = lag_scan(code[at].astype(np.int64), segment, least)
    start = at[start]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, runs (start, length and period, by start and period) and collapsed, for every row of docs.

    `collapsed` is the text's words, joined by one space, without those that some
    run holds after its first period.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 1):
                words, row = split_words(some.column(1))
                code, _ = codes(words)
                start, length, period = runs(code, row, least)
                depth = np.zeros(len(code) + 1, np.int64)
                np.add.at(depth, start + period, 1)
                np.add.at(depth, start + length, -1)
                kept = np.cumsum(depth[:-1]) == 0
                rows = np.arange(some.num_rows + 1)
                left = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[kept], rows), pa.int32()), words.filter(pa.array(kept)))
                first = np.searchsorted(row, rows)
                owner = row[start]
                found = pa.StructArray.from_arrays(
                    [pa.array(start - first[owner]), pa.array(length), pa.array(period)], names=["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, rows), pa.int32()), found),
                     pc.binary_join(left, " ")], names=["doc_id", "runs", "collapsed"])

    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    return texts.mapInArrow(
        scan, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
