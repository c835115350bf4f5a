"""Periodic runs of words, from maximal pairs.

Two places i < j of a document are a maximal pair of length n if the n words from each on are the same, the words before them differ
(or one has none) and so do the words behind. A run of period p and length L is the maximal pair of length L - p at the distance p, and
a maximal pair of length n at a distance p <= n is the run from i to j + n: nothing is left to extend. So all runs of `times` periods are
found by enumerating the maximal pairs whose distance is at most n / (times - 1).

They come out of the tree of LCP intervals over the sorted suffixes, bottom up: an interval holds the places of its suffixes in order,
and the smaller of two children is looked up in the larger one. Classes of equal left words are stretches of that order: of the places
within the distance around one, all but the first have the same word before them, since what repeats so closely is periodic. So one
look at the first place on each side tells whether a whole class pairs.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, arrow_map, slices, text_bytes, word_spans

RUN = "start bigint, length bigint, period bigint"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def word_codes(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """A number for each word of all rows, the words that the numbers stand for (binary), and where rows' words begin."""
    data, offsets = text_bytes(column)
    starts, ends, first = word_spans(data, offsets, SPACES[1])
    # words and what is between them by turns, so that nothing is copied
    edges = np.zeros(2 * len(starts) + 2, np.int64)
    edges[1:-1:2], edges[2:-1:2], edges[-1] = starts, ends, len(data)
    all_parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
    found = all_parts.dictionary_encode()
    return found.indices.to_numpy()[1::2].astype(np.int64), found.dictionary, first


def dense(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Numbers from 0 for pairs of numbers, in their order."""
    return np.unique(first * (int(second.max(initial=0)) + 1) + second, return_inverse=True)[1]


def repeated(key: np.ndarray) -> np.ndarray:
    """Which values come more than once."""
    return np.bincount(key)[key] > 1 if len(key) else np.zeros(0, bool)


def places(words: np.ndarray, first: np.ndarray, seed: int, ratio: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose next `seed` words come again in their row, with a number for row and words; only such as may belong to a maximal
    pair of length n >= seed and distance <= n / ratio.

    All places of such a pair's first n - seed + 1 words have their words again at its distance. So places fall that aren't in a stretch
    of neighbours as long as the distance to the next same words asks for."""
    n = len(words)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.arange(n)
    own = dense(row, words)
    again = repeated(own)
    whole = np.r_[0, np.cumsum(again)]
    at = at[: max(0, n - seed + 1)]
    at = at[(at + seed <= first[1:][row[: len(at)]]) & (whole[at + seed] - whole[at] == seed)]
    key = own[at]
    for k in range(1, seed):
        key = dense(key, words[at + k])
        some = repeated(key)
        at, key = at[some], key[some]
    order = np.argsort(key, kind="stable")
    ahead = np.full(len(at), n, np.int64)  # to the next place with these words
    same = key[order][1:] == key[order][:-1]
    ahead[order[:-1][same]] = np.diff(at[order])[same]
    live = ahead < n
    while True:
        spots, far = at[live], ahead[live]
        block = np.cumsum(np.r_[False, np.diff(spots) != 1])[: len(spots)]
        near = far <= (np.bincount(block)[block] + seed - 1) // ratio if len(block) else np.zeros(0, bool)
        if near.all():
            break
        live[np.flatnonzero(live)[~near]] = False
    if not live.any():
        return at[:0], key[:0]
    alive = np.zeros(int(key.max()) + 1, bool)
    alive[key[live]] = True
    keep = alive[key]
    return at[keep], np.unique(key[keep], return_inverse=True)[1]


def sorted_suffixes(at: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes that begin at the places `at` (ascending, of n), compared by keys, a key a place; where a place isn't in
    `at` every suffix differs. And how many keys each has in common with the one before it. Ranks are doubled."""
    m = len(at)
    where = np.full(n + 1, -1, np.int32)
    where[at] = np.arange(m)
    levels, step = [key.astype(np.int64)], 1
    while repeated(levels[-1]).any():
        ahead = where[np.minimum(at + step, n)]
        levels.append(dense(levels[-1], np.where(ahead >= 0, levels[-1][ahead], m + np.arange(m))))
        step *= 2
    order = np.argsort(levels[-1], kind="stable")
    shared = np.zeros(max(m - 1, 0), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        a, b = (where[np.minimum(at[x] + shared, n)] for x in (order[:-1], order[1:]))
        shared[(a >= 0) & (b >= 0) & (levels[j][a] == levels[j][b])] += 1 << j
    return order, np.r_[np.zeros(min(m, 1), np.int64), shared]


def maximal_pairs(spots: list[int], shared: list[int], left: dict[int, int], more: int, ratio: int) -> Iterator[tuple[int, int, int]]:
    """(i, distance, n) of the maximal pairs whose distance is at most n / ratio. spots: places in suffix order; shared: keys that each has
    in common with the one before it, 0 between groups; n is `more` words longer than these."""

    def merged(common: int, a: list[int], b: list[int]) -> list[int]:
        if len(a) > len(b):
            a, b = b, a
        n = common + more
        far = n // ratio
        for x in a:
            mid = bisect_left(b, x)
            if mid and x - b[mid - 1] <= far:
                i = b[bisect_left(b, x - far, 0, mid)]  # the others before x have x's left word
                if left[i] != left[x]:
                    found.append((i, x - i, n))
            if mid < len(b) and b[mid] - x <= far and left[b[mid]] != left[x]:  # and those behind x have one left word
                found.extend((x, j - x, n) for j in b[mid : bisect_right(b, x + far, mid)])
        if 8 * len(a) > len(b):
            return sorted(a + b)
        for x in a:
            b.insert(bisect_left(b, x), x)
        return b

    found: list[tuple[int, int, int]] = []
    open_: list[tuple[int, list[int]]] = []
    for k in range(1, len(spots) + 1):
        common, node = shared[k] if k < len(spots) else 0, [spots[k - 1]]
        while open_ and open_[-1][0] >= common and open_[-1][0]:
            was, before = open_.pop()
            node = merged(was, before, node)
            if was == common:
                break
        if common:
            open_.append((common, node))
        yield from found
        found.clear()


def runs_of(words: np.ndarray, first: np.ndarray, least: int = 6, times: int = 4) -> np.ndarray:
    """All runs of rows of words: row, start (in the row), length and period, a line each, by row, start and period."""
    ratio = times - 1
    seed = min(max(ratio * p, least - p) for p in range(1, least + 1))
    at, key = places(words, first, seed, ratio)
    if not len(at):
        return np.empty((0, 4), np.int64)
    order, shared = sorted_suffixes(at, key, len(words))
    begins = np.isin(at, first)
    left = dict(zip(at.tolist(), np.where(begins, -1 - at, words[at - 1]).tolist()))  # nothing before: unlike any other
    found = np.array([(i, n + d, d) for i, d, n in maximal_pairs(at[order].tolist(), shared.tolist(), left, seed - 1, ratio) if n + d >= least], np.int64).reshape(-1, 3)
    # a stretch with a period has its multiples too: the smallest counts
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
    found = found[new]
    row = np.searchsorted(first, found[:, 0], "right") - 1
    start = found[:, 0] - first[row]
    return np.c_[row, start, found[:, 1:]][np.lexsort((found[:, 2], start, row))]


def periodic_runs(docs: DataFrame, least: int = 6, times: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of docs: id, runs (array of start, length, period; by start, then period) and collapsed (binary): the words that no
    run holds behind its first period, joined by single spaces.

    Words are what is between space and the bytes 9 to 13, numbered from 0. A run is a stretch of words with smallest period q (words q apart
    are the same) of at least max(least, times * q) words that no word beside it extends; times is 2 at least. Nulls: a null text counts as
    empty and has no runs; a null id stays null. Repeated rows give repeated rows; other columns are not carried, whatever their
    names. An empty table gives an empty one. Texts of any length count whole, each in one task.
    """
    if times < 2 or least < 2:
        raise ValueError("a run has two periods and two words at least")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                codes, names, first = word_codes(part.column(1))
                found = runs_of(codes, first, least, times)
                drop = np.zeros(len(codes) + 1, np.int64)
                begin = first[found[:, 0]] + found[:, 1]
                np.add.at(drop, begin + found[:, 3], 1)
                np.add.at(drop, begin + found[:, 2], -1)
                keep = np.cumsum(drop)[:-1] == 0
                before = np.r_[0, np.cumsum(keep)]
                kept = pa.LargeListArray.from_arrays(before[first], names.take(pa.array(codes[keep])))
                collapsed = pc.binary_join(kept, pa.scalar(b" ", pa.large_binary())).cast(pa.binary())
                rows = pa.StructArray.from_arrays([pa.array(found[:, k]) for k in (1, 2, 3)], fields=list(_RUN))
                runs = pa.ListArray.from_arrays(np.searchsorted(found[:, 0], np.arange(len(part) + 1)).astype(np.int32), rows)
                yield pa.RecordBatch.from_arrays([part.column(0), runs, collapsed], [id_col, "runs", "collapsed"])

    return arrow_map(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")), run, f"`{id_col}` {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary")


def repeated_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and text of docs, where about every tenth text's words repeat from some word on: with h the crc32 of the decimal id (a null id: of
    nothing) and g = h // 10, in texts of n > 0 words with h % 10 == 0 each word i >= a becomes word a + (i - a) % p, where a = g % n and
    p = 1 + (n - a) // (3 + g % 8); their words are then apart by single spaces. Other texts are as they were, null ones null; bytes that
    aren't UTF-8 become the replacement character."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                marks = [zlib.crc32(b"" if x is None else str(x).encode()) for x in part.column(0).to_pylist()]
                chosen = np.flatnonzero(np.array(marks) % 10 == 0)
                texts = part.column(1).take(pa.array(chosen))
                codes, names, first = word_codes(texts)
                for k, h in enumerate(np.array(marks)[chosen].tolist()):
                    own = codes[first[k] : first[k + 1]]
                    if n := len(own):
                        g = h // 10
                        a = g % n
                        own[a:] = own[a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))]
                joined = pc.binary_join(pa.LargeListArray.from_arrays(first, names.take(pa.array(codes))), pa.scalar(b" ", pa.large_binary()))
                where = np.full(len(part), -1)
                where[chosen] = np.arange(len(chosen))
                changed = joined.cast(pa.large_string()).take(pa.array(where, mask=where < 0))
                yield pa.RecordBatch.from_arrays([part.column(0), pc.coalesce(changed, part.column(1).cast(pa.large_string())).cast(pa.string())], [id_col, "text"])

    return arrow_map(docs.select(F.col(f"`{id_col}`"), F.make_valid_utf8(F.col(f"`{text_col}`").cast("string")).alias("text")), run, f"`{id_col}` {kind}, text string")


def run_digests(docs: DataFrame, least: int = 6, times: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of docs: id, n_runs; start, length, period and exponent_milli of the longest run (the first of these, and of those the
    one of smallest period), null without runs; runs_sha256 of the lines start,length,period, and collapsed_sha256."""
    found = periodic_runs(docs, least, times, id_col, text_col)
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    told = found.select(F.col(f"`{id_col}`"), F.size("runs").cast("bigint").alias("n_runs"), longest.alias("w"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length = -F.col("w.shorter")
    milli = F.expr("(-1000 * w.shorter) div w.period")
    return told.select(F.col(f"`{id_col}`"), "n_runs", F.col("w.start").alias("start"), length.alias("length"), F.col("w.period").alias("period"), milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
