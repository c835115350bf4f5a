"""SimHash near-duplicates through forests of BK-trees.

Distinct fingerprints are cut into m bit blocks; fingerprints within the radius r agree on some m - r of them, so every
choice of m - r blocks deals the fingerprints into shards, and each link lies inside some shard. A shard is a BK-tree, its
children keyed by their integer Hamming distance to the parent; a search follows only edges within the radius. There are as
many shards as fingerprints or more, so each is built and searched in the task that receives it rather than broadcast. All trees of a task grow and are searched level by level, as arrays. A task yields
one link from each fingerprint to the smallest that it reaches; components then shrink to stars by joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, forget, record_batch, slices, written

_FP = pa.schema([("id", pa.int64()), ("fp", pa.int64())])
_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingle_hashes(text: str | None, width: int, seed: int) -> list[int]:
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and separators are space and bytes 9 to 13
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, seed)] if words else []
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-width] + 1]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist())]


def bit_counts(hashes: list[int]) -> np.ndarray:
    """In how many hashes each bit is set, the highest bit first."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        total += np.unpackbits(np.array(hashes[i : i + (1 << 16)], ">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return total


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64; a text without words has 0. As a signed 64-bit integer."""
    hashes = shingle_hashes(text, width, seed)
    return int(np.packbits(bit_counts(hashes) * 2 > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                yield record_batch(_FP, part.column(0).cast(pa.int64()), [fingerprint(t, width, seed) for t in part.column(1).to_pylist()])

    return arrow_map(docs.select(F.col(id_col).cast("bigint").alias("id"), text_col), run, "id bigint, fp bigint")


def blocks_for(n: int, radius: int) -> int:
    """How many blocks to cut 64 bits into, so that n spread-out fingerprints fill shards of a few dozen at most."""
    for m in range(radius + 1, radius + 4):
        if n >> (64 * (m - radius) // m) < 64:
            return m
    return radius + 4


def shard_keys(fp: Column, m: int, radius: int) -> Column:
    """An array of (choice of blocks, their bits): one shard key a choice."""
    edge = [64 * i // m for i in range(m + 1)]
    masks = [sum(((1 << (edge[i + 1] - edge[i])) - 1) << edge[i] for i in choice) for choice in combinations(range(m), m - radius)]
    signed = [x - (1 << 64) if x >> 63 else x for x in masks]
    return F.array(*[F.struct(F.lit(i).alias("choice"), fp.bitwiseAND(F.lit(x)).alias("bits")) for i, x in enumerate(signed)])


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints: 64-bit numbers, or rows of several."""
    bits = np.bitwise_count((a ^ b).view(np.uint64)).astype(np.int64)
    return bits if bits.ndim == 1 else bits.sum(1)


def edge_span(fp: np.ndarray) -> int:
    """One more than the largest distance: an edge's key is its parent times this, and the distance."""
    return 64 * (1 if fp.ndim == 1 else fp.shape[1]) + 1


def bk_forest(fp: np.ndarray, shard: np.ndarray, absorb: int = -1) -> tuple[np.ndarray, ...]:
    """One BK-tree a shard (members side by side). Returns each item's root, sorted edge keys with the child of each, and the items
    that a node took with that node. Items descend side by side: of those that reach the same place, the first becomes the child there
    and the others go on below it; an item that meets a node within `absorb` is taken by it and doesn't enter the tree."""
    root = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
    root = np.repeat(root, np.diff(np.r_[root, len(shard)]))
    item = np.flatnonzero(root != np.arange(len(fp)))
    at, span = root[item], edge_span(fp)
    none = np.zeros(0, np.int64)
    keys, children, taken, by = [none], [none], [none], [none]
    while len(item):
        d = distance(fp[item], fp[at])
        near = d <= absorb
        taken.append(item[near])
        by.append(at[near])
        item, edge = item[~near], (at * span + d)[~near]
        if not len(item):
            break
        order = np.argsort(edge, kind="stable")
        edge, item = edge[order], item[order]
        new = np.r_[True, edge[1:] != edge[:-1]]
        keys.append(edge[new])
        children.append(item[new])
        at = np.repeat(item[new], np.diff(np.r_[np.flatnonzero(new), len(item)]))[~new]
        item = item[~new]
    key, child = np.concatenate(keys), np.concatenate(children)
    order = np.argsort(key, kind="stable")
    return root, key[order], child[order], np.concatenate(taken), np.concatenate(by)


def bk_search(fp: np.ndarray, forest: tuple[np.ndarray, np.ndarray, np.ndarray], radius: int, batch: int = 1 << 15, items: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (item, node of its tree within the radius), for all items or those given. `batch` places are looked at side by side, the
    children of the last ones first, so that what waits is bounded by the trees' depth."""
    root, key, child = forest
    items, span = np.arange(len(fp)) if items is None else items, edge_span(fp)
    waiting = [(items, root[items])]
    while waiting:
        item, node = waiting.pop()
        if len(item) > batch:
            waiting.append((item[batch:], node[batch:]))
            item, node = item[:batch], node[:batch]
        d = distance(fp[item], fp[node])
        hit = (d <= radius) & (item != node)
        if hit.any():
            yield item[hit], node[hit]
        low = np.searchsorted(key, node * span + np.maximum(d - radius, 0))
        n = np.searchsorted(key, node * span + np.minimum(d + radius, span - 1), "right") - low
        if n.any():
            item = np.repeat(item, n)
            waiting.append((item, child[np.repeat(low - np.cumsum(n) + n, n) + np.arange(len(item))]))


def smallest_reached(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For items 0 to n - 1, the smallest item that each one's links reach."""
    label = np.arange(n)
    for a, b in links:
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label = label[label]
    return label


def _shard_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
        if not parts:
            return
        fp, *key = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((fp, *key))
        fp, key = fp[order], [k[order] for k in key]
        shard = np.cumsum(np.r_[0, np.any([k[1:] != k[:-1] for k in key], axis=0)])
        several = np.bincount(shard)[shard] > 1
        fp, shard = fp[several], shard[several]
        if len(fp):
            label = smallest_reached(len(fp), bk_search(fp, bk_forest(fp, shard)[:3], radius))
            a, b = fp, fp[label]
            pair = np.unique(np.stack([a[a != b], b[a != b]]), axis=1)
            yield record_batch(_LINK, np.maximum(*pair), np.minimum(*pair))

    return run


def components(links: DataFrame) -> DataFrame:
    """(a, b): each linked value and the smallest that it reaches, but for those that are the smallest themselves.

    links: (a, b) with a > b. Large-star and small-star steps alternate until nothing changes; each is a grouped minimum and a
    join, so that a value with very many links is pre-aggregated and its join can be split. Rows are written between rounds, and
    those of the round before deleted.
    """
    now = written(links.distinct(), "links")
    last = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == last or not seen[0]:
            return now
        last = seen
        both = now.union(now.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("low").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(down, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        further = written(small, "links")
        forget(now)
        now = further


def component_minima(each: DataFrame, links: DataFrame) -> DataFrame:
    """(own, least) for each row of each (own, first): the smallest `first` of all rows that links (a, b), of values of own, join. Only
    rows with a link are dealt by component."""
    star = components(links)
    members = star.select(F.col("a").alias("own"), F.col("b").alias("top")).union(star.select("b", "b").distinct())
    members = written(members.join(each, "own"), "members")
    least = members.groupBy("top").agg(F.min("first").alias("least"))
    told = members.select("own", "top").join(least, "top").select("own", F.struct("least").alias("told"))
    joined = each.join(told, "own", "left")
    return joined.select("own", F.when(F.col("told").isNotNull(), F.col("told.least")).otherwise(F.col("first")).alias("least"))


def dealt_shards(distinct: DataFrame, m: int, radius: int, hot: int) -> DataFrame:
    """(fp, choice, bits, choice2, bits2): fingerprints by all choices of m - radius of m blocks. Shards of over `hot` are dealt once more,
    by two of radius + 2 blocks of their other bits: linked fingerprints, which agree on all but radius bits, agree on two of these."""
    keyed = distinct.select("fp", F.explode(shard_keys(F.col("fp"), m, radius)).alias("k")).select("fp", "k.choice", "k.bits")
    many = keyed.groupBy("choice", "bits").count().where(F.col("count") > hot).select("choice", "bits", F.lit(True).alias("hot"))
    marked = written(keyed.join(many, ["choice", "bits"], "left"), "shards")
    edge = [64 * i // m for i in range(m + 1)]
    rows = []
    for i, choice in enumerate(combinations(range(m), m - radius)):
        free = [b for k in range(m) if k not in choice for b in range(edge[k], edge[k + 1])]
        cut = [free[len(free) * k // (radius + 2) : len(free) * (k + 1) // (radius + 2)] for k in range(radius + 2)]
        for j, pair in enumerate(combinations(cut, 2)):
            mask = sum(1 << b for part in pair for b in part)
            rows.append((i, j, mask - (1 << 64) if mask >> 63 else mask))
    masks = distinct.sparkSession.createDataFrame(rows, "choice int, choice2 int, mask bigint")  # (radius + 2) * (radius + 1) / 2 a choice
    again = marked.where("hot").join(F.broadcast(masks), "choice").select("fp", "choice", "bits", "choice2", F.col("fp").bitwiseAND(F.col("mask")).alias("bits2"))
    return marked.where("hot IS NULL").select("fp", "choice", "bits", F.lit(-1).alias("choice2"), F.lit(0).cast("bigint").alias("bits2")).union(again)


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4, seed: int = 42, blocks: int | None = None, hot: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of docs: id (bigint), fingerprint (16 lowercase hex digits), component_id.

    Two rows are linked if their fingerprints differ in at most `radius` bits; component_id is the smallest id that links reach.
    Nulls: a null text counts as empty; empty texts have fingerprint zero, linked like any other; a null id stays null, takes its
    component's id and never names one (a component of null ids alone has null). Equal texts share a fingerprint and so a
    component; repeated rows give repeated rows. Other columns are not carried, whatever their names. Empty tables give empty ones.
    Texts of any length count whole. blocks: into how many the bits are cut; hot: shards of more fingerprints are dealt once more.
    """
    prints = written(fingerprints(docs, width, seed, id_col, text_col), "prints")
    distinct = written(prints.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    shards = dealt_shards(distinct, blocks or blocks_for(distinct.count(), radius), radius, hot)
    links = arrow_map(shards.repartition("choice", "bits", "choice2", "bits2"), _shard_links(radius), "a bigint, b bigint")
    named = written(component_minima(distinct.withColumnRenamed("fp", "own"), links), "components")
    return prints.join(named.toDF("fp", "component_id"), "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
