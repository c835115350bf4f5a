"""SimHash near-duplicates at a Jaccard similarity of word shingles, through forests of BK-trees.

Two sets of similarity 0.8 differ in about 15 % of their SimHash bits, so no block of bits is sure to agree. Fingerprints of 256 bits
are therefore dealt into shards by many fixed choices of their bits: a pair misses all of them with a chance of MISS at 0.8, and less
above. Each shard is a BK-tree over the first 128 bits, children keyed by their integer Hamming distance to the parent; only edges
within the radius are followed. Candidates are verified on the whole shingle sets.

Candidates come in rounds, so that a large group of copies of one text doesn't make all of its pairs. First every set finds a partner
in each of its shards: the node of the tree within the radius that it meets on its way down (it then isn't put into the tree), or
the nearest other node; the nearest of all is verified. Then, twice, of the sets that verified links left apart, each gets its nearest
partner of another component, within the radius of all 256 bits. Last, the sets that are still apart bring their shingle hashes
with them into their shards, where they are joined by their rarest shingles: two similar sets have one of these in common, and so
early that what follows can hold enough shared ones. Sets of a large family of unlike texts begin with shingles of their own, so
few pairs are compared; only those that are similar come out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, arrow_map, broadcast_if_small, free_names, mixed, ngram_hashes, record_batch, slices, span_hashes, text_bytes, word_spans, written
from .simhash import bk_forest, bk_search, component_minima, components, distance

WORDS = 4  # of 64 bits in a fingerprint
#: Radii on the first 128 and on all 256 bits, over three standard deviations above the mean distance of sets of similarity 0.8 (for
#: sets of 4 and of 5 shingles, whose bits differ more often, about two).
RADIUS, WIDE_RADIUS = 32, 60
#: The chance that a bit differs at 0.8 (the angle between the sets over pi), with a standard deviation of 256 bits added.
DIFFERS, MISS = 0.174, 0.001
#: Fingerprints that are to share a shard by chance, and the fewest bits to deal them by.
SHARD, LEAST_BITS = 256, 11
_SEEDS = np.random.default_rng(6).integers(0, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_SETS = pa.schema([("id", pa.int64()), ("text", pa.string()), ("own", pa.int64()), ("fp", pa.binary())])
_KEYED = pa.schema([("key", pa.int64()), ("own", pa.int64()), ("fp", pa.binary())])
_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_SHARED = pa.schema([("key", pa.int64()), ("item", pa.int64()), ("partner", pa.int64()), ("far", pa.int64())])


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of all rows' shingles, ascending in each row, and where each row's begin. Words are lower-case (A-Z
    only), apart at space and bytes 9 to 13; a text of fewer words than width is one shingle, one without words none."""
    data, offsets = text_bytes(column)
    lowered = SPACES[0][data]
    starts, ends, first = word_spans(data, offsets, SPACES[1])
    words, size = span_hashes(lowered, starts, ends), np.diff(first)
    found, row = ngram_hashes(words, first, width)
    parts, rows = [found], [row]
    for n in range(1, width):
        found, row = ngram_hashes(words, first, n)
        short = size[row] == n
        parts.append(found[short] + np.uint64(n))
        rows.append(row[short])
    h, row = np.concatenate(parts), np.concatenate(rows)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    if len(h):
        new = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])]
        h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(column) + 1))


def wide_fingerprints(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of 8 * WORDS bytes a set, none of them empty: a bit is 1 if it is set in over half of the set's hashes, each
    mixed anew for every 64 bits. Bits are counted eight side by side in the bytes of one number, for 255 hashes at a time."""
    size = np.diff(first)
    runs = -(-size // 255)
    run = np.cumsum(runs) - runs
    begin = np.repeat(first[:-1], runs) + 255 * (np.arange(runs.sum()) - np.repeat(run, runs))
    out = np.zeros((len(size), 64 * WORDS), bool)
    for j, seed in enumerate(_SEEDS):
        v = mixed(h * seed)
        for b in range(8):
            lanes = np.add.reduceat((v >> np.uint64(b)) & np.uint64(0x0101010101010101), begin)
            counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), run, axis=0)
            out[:, 64 * j + b : 64 * j + 64 : 8] = counts * 2 > size[:, None]
    return np.packbits(out, axis=1, bitorder="little")


def marked_sets(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(id, text, own, fp) for each row: `own` names its shingle set (64 bits), fp is the set's fingerprint, empty for the empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                h, first = shingle_sets(part.column(1), width)
                size = np.diff(first)
                sums = np.r_[np.uint64(0), np.cumsum(mixed(h))]
                own = (sums[first[1:]] - sums[first[:-1]]).view(np.int64)
                some = np.flatnonzero(size)
                marks = [b""] * len(size)
                if len(some):
                    raw, n = wide_fingerprints(h, np.r_[first[:-1][some], len(h)]).tobytes(), 8 * WORDS
                    for k, i in enumerate(some.tolist()):
                        marks[i] = raw[n * k : n * k + n]
                yield record_batch(_SETS, part.column(0), part.column(1).cast(pa.string()), own, marks)

    return arrow_map(docs.select(F.col(id_col).cast("bigint").alias("id"), text_col), run, "id bigint, text string, own bigint, fp binary")


def bit_choices(n: int) -> np.ndarray:
    """Fixed choices of fingerprint bits, a row each: as many bits as leave about SHARD of n fingerprints in a shard by chance, and as
    many choices as keep the chance that similar sets agree on none below MISS."""
    bits = min(max(LEAST_BITS, math.ceil(math.log2(max(n, 1) / SHARD))), 40)
    count = math.ceil(math.log(MISS) / math.log(1 - (1 - DIFFERS) ** bits))
    rng = np.random.default_rng(bits)
    return np.stack([rng.choice(64 * WORDS, bits, replace=False) for _ in range(count)])


def as_numbers(column: pa.Array, words: int) -> np.ndarray:
    """Binary values of 8 * words bytes, a row each."""
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, words)


def shard_rows(each: DataFrame, choices: np.ndarray) -> DataFrame:
    """(key, own, fp): one row a set and choice; fp is cut to its first 128 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.uint64(1) << np.arange(choices.shape[1], dtype=np.uint64)
        for batch in batches:
            for i in range(0, len(batch), 2048):
                part = batch.slice(i, 2048)
                fp = as_numbers(part.column(1), WORDS)
                bits = np.unpackbits(fp.view(np.uint8), axis=1, bitorder="little")
                near = pa.array([x.tobytes() for x in fp[:, :2]], pa.binary())
                for t in range(0, len(choices), 64):
                    some = choices[t : t + 64]
                    key = mixed((bits[:, some] * place).sum(2, dtype=np.uint64) * np.uint64(1 << 12) + np.arange(t, t + len(some), dtype=np.uint64)).view(np.int64)
                    row = np.repeat(np.arange(len(part)), len(some))
                    yield record_batch(_KEYED, key.ravel(), part.column(0).take(pa.array(row)), near.take(pa.array(row)))

    return arrow_map(each.select("own", "fp"), run, "key bigint, own bigint, fp binary")


def _shards(batches: Iterator[pa.RecordBatch], words: int) -> tuple[np.ndarray, ...] | None:
    """Columns of all batches (key, own, fingerprints, and any more), ordered by key and then own, without shards of one."""
    parts = [b for b in batches if len(b)]
    if not parts:
        return None
    key, own = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in parts]) for i in range(2))
    fp = np.concatenate([as_numbers(b.column(2), words) for b in parts])
    more = [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in parts]) for i in range(3, parts[0].num_columns)]
    order = np.lexsort((own, key))
    shard = np.cumsum(np.r_[False, key[order][1:] != key[order][:-1]])
    order = order[np.bincount(shard)[shard] > 1]
    return tuple(x[order] for x in (key, own, fp, *more))


def nearest(fp: np.ndarray, hits: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Of each item with hits (item, other) the nearest other one, the first of equally near ones."""
    best = np.full(len(fp), np.iinfo(np.int64).max)
    for a, b in hits:
        np.minimum.at(best, a, distance(fp[a], fp[b]) * len(fp) + b)
    some = np.flatnonzero(best < np.iinfo(np.int64).max)
    return some, best[some] % max(len(fp), 1)


def _first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, item, partner, far): each set with its partner in a shard and the distance."""
    got = _shards(batches, 2)
    if not got or not len(got[0]):
        return
    key, own, fp = got
    root, edges, children, taken, by = bk_forest(fp, key, RADIUS)
    nodes = np.setdiff1d(np.arange(len(fp)), taken, assume_unique=True)
    a, b = nearest(fp, bk_search(fp, (root, edges, children), RADIUS, items=nodes))
    for x, y in ((taken, by), (a, b)):
        yield from _partners(key, own, fp, x, y)


def _partners(key: np.ndarray, own: np.ndarray, fp: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(a), 1 << 16):
        x, y = a[i : i + (1 << 16)], b[i : i + (1 << 16)]
        yield record_batch(_SHARED, key[x], own[x], own[y], distance(fp[x], fp[y]))


def best_pairs(found: DataFrame) -> DataFrame:
    """(a, b), a > b: each item with the nearest of its partners."""
    best = found.groupBy("item").agg(F.min(F.struct("far", "partner")).alias("m")).select("item", "m.partner")
    return best.select(F.greatest("item", "partner").alias("a"), F.least("item", "partner").alias("b")).distinct()


def _apart(threshold: float | None):
    """Of sets of one shard and of different labels: (key, item, partner, far) with the nearest of each within the wide radius, or with a
    threshold (a, b) for all whose shingle hashes (32 bits each, a column more) have that similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _shards(batches, WORDS)
        if not got or not len(got[0]):
            return
        key, own, fp, label, *sets = got
        shard = np.cumsum(np.r_[False, key[1:] != key[:-1]])
        # of each shard all labels but the most frequent one search: one of any two labels does
        order = np.lexsort((label, shard))
        edge = np.flatnonzero(np.r_[True, (shard[order][1:] != shard[order][:-1]) | (label[order][1:] != label[order][:-1])])
        size, of = np.diff(np.r_[edge, len(order)]), shard[order][edge]
        ranked = np.lexsort((size, of))
        main = np.zeros(len(of), bool)
        main[ranked[np.r_[of[1:] != of[:-1], True]]] = True  # of is ascending, so ranked has the largest of each shard last
        items = np.sort(order[~np.repeat(main, size)])
        if threshold is not None:
            edge = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])
            for i, end in zip(edge[:-1].tolist(), edge[1:].tolist()):
                own_items = items[np.searchsorted(items, i) : np.searchsorted(items, end)] - i
                a, b = alike_pairs(sets[0][i:end], label[i:end], own_items, threshold)
                if len(a):
                    a, b = own[i:end][a], own[i:end][b]
                    yield record_batch(_LINK, *np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1))
            return
        found = bk_search(fp, bk_forest(fp, key)[:3], WIDE_RADIUS, items=items)
        hits = ((a[apart], b[apart]) for a, b in found for apart in [label[a] != label[b]])
        yield from _partners(key, own, fp, *nearest(fp, hits))

    return run


def alike_pairs(sets: np.ndarray, label: np.ndarray, items: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places of sets (bytes of distinct 32-bit numbers, none empty) with a Jaccard similarity of threshold and different labels.
    items: the places that search, ascending: all but those of one label.

    Numbers are put in one order, the rarest first. Of two similar sets of n and m numbers the first shared one stands among the first
    n - ceil(threshold * n) + 1 of each, and from it on both hold as many as they have to share, threshold / (1 + threshold) * (n + m)."""
    arrays = [np.frombuffer(x, np.uint32) for x in sets.tolist()]
    size = np.fromiter(map(len, arrays), np.int64, len(arrays))
    names, token, df = np.unique(np.concatenate(arrays), return_inverse=True, return_counts=True)
    rank = np.empty(len(names), np.int64)
    rarest = np.lexsort((names, df))
    rank[rarest] = np.arange(len(names))
    owner = np.repeat(np.arange(len(arrays)), size)
    token = np.sort(owner * len(names) + rank[token]) % len(names)
    start = np.cumsum(size) - size
    place = np.arange(len(token)) - start[owner]
    some = (place < (size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1)[owner]) & (df[rarest][token] > 1)
    who, what, where = owner[some], token[some], place[some]
    mine = np.searchsorted(who, np.arange(len(arrays) + 1))
    by = np.argsort(what, kind="stable")
    first = np.searchsorted(what[by], np.arange(len(names) + 1))
    searches = np.zeros(len(arrays), bool)
    searches[items] = True
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for i in items.tolist():
        own = slice(mine[i], mine[i + 1])
        low, n = first[what[own]], first[what[own] + 1] - first[what[own]]
        entry = by[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
        other, at = np.unique(who[entry], return_index=True)  # at the first number that they share
        left = np.minimum(size[i] - np.repeat(where[own], n)[at], size[other] - where[entry][at])
        other = other[(label[other] != label[i]) & ~(searches[other] & (other > i)) & (left >= threshold / (1 + threshold) * (size[i] + size[other]) - 1e-9)]
        ranks = token[start[i] : start[i] + size[i]]
        for k in range(0, len(other), 4096):
            part = other[k : k + 4096]
            m = size[part]
            theirs = token[np.repeat(start[part] - np.cumsum(m) + m, m) + np.arange(m.sum())]
            spot = np.minimum(np.searchsorted(ranks, theirs), len(ranks) - 1)
            shared = np.add.reduceat((ranks[spot] == theirs).astype(np.int64), np.cumsum(m) - m)
            similar = part[shared >= threshold * (size[i] + m - shared) - 1e-9]
            found.append((np.full(len(similar), i), similar))
    none = np.empty(0, np.int64)
    return np.concatenate([none, *(a for a, _ in found)]), np.concatenate([none, *(b for _, b in found)])


def hashed_sets(texts: DataFrame, width: int) -> DataFrame:
    """(own, hashes) of (own, text): the set's shingle hashes cut to 32 bits, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                h, first = shingle_sets(part.column(1), width)
                raw = [np.unique((h[a:b] >> np.uint64(32)).astype(np.uint32)).tobytes() for a, b in zip(first.tolist(), first[1:].tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(raw, pa.binary())], ["own", "hashes"])

    return arrow_map(texts, run, "own bigint, hashes binary")


def verified(pairs: DataFrame, texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of at least threshold. texts: (own, text), a row a set."""
    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "ta", "b", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (p for q in slices(batch, 1) for p in slices(q, 3)):
                (x, fx), (y, fy) = shingle_sets(part.column(1), width), shingle_sets(part.column(3), width)
                keep = []
                for i in range(len(part)):
                    s, t = x[fx[i] : fx[i + 1]], y[fy[i] : fy[i + 1]]
                    shared = len(np.intersect1d(s, t, True)) if threshold * max(len(s), len(t)) <= min(len(s), len(t)) else 0
                    keep.append(shared > 0 and shared / (len(s) + len(t) - shared) >= threshold)
                yield record_batch(_LINK, part.column(0), part.column(2)).filter(pa.array(keep, pa.bool_()))

    return arrow_map(both, run, "a bigint, b bigint")


def _groups(docs: DataFrame, width: int, threshold: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Two tables: (id, text, own), a row a row of docs, and (own, least), a row a set: the first row of all sets that links join with
    it, as (no id, id, hash of the text)."""
    if threshold < 0.8:
        raise ValueError("the choices of bits cover similarities from 0.8 on")
    sets = written(marked_sets(docs, width, id_col, text_col), "sets")
    lead = F.struct(F.col("id").isNull().alias("none"), "id", text_mark(F.col("text")).alias("mark"))
    each = written(sets.groupBy("own").agg(F.min(lead).alias("first"), F.max("fp").alias("fp")), "each")
    some = each.where(F.length("fp") > 0)
    keyed = shard_rows(some, bit_choices(some.count()))
    ddl = "key bigint, item bigint, partner bigint, far bigint"
    shared = written(arrow_map(keyed.repartition("key"), _first_round, ddl), "shared")
    members = written(shared.select("key", F.explode(F.array("item", "partner")).alias("own")).distinct(), "members")
    # of each set the text of its first row
    named = written(each.join(members.select("own").distinct(), "own").select(F.col("own").alias("of"), "first", "fp"), "named")
    prints = named.select(F.col("of").alias("own"), "fp")
    one = (F.col("own") == F.col("of")) & F.col("id").eqNullSafe(F.col("first.id")) & (text_mark(F.col("text")) == F.col("first.mark"))
    texts = written(sets.join(broadcast_if_small(named.select("of", "first")), one).groupBy("own").agg(F.min("text").alias("text")), "texts")
    tried = written(best_pairs(shared), "pairs")
    links = written(verified(tried, texts, width, threshold), "links")
    for last in (False, False, True):
        star = written(components(links).toDF("own", "label"), "star")
        label = written(members.join(star, "own", "left").withColumn("label", F.coalesce("label", "own")), "labels")
        split = label.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("key")
        rest = label.join(split, "key").join(prints, "own").select("key", "own", "fp", "label")
        if last:
            rest = rest.join(alive, "key")
            rest = rest.join(hashed_sets(texts.join(written(rest.select("own").distinct(), "apart"), "own", "left_semi"), width), "own").select("key", "own", "fp", "label", "hashes")
            found = arrow_map(rest.repartition("key"), _apart(threshold), "a bigint, b bigint").distinct()
        else:
            near = written(arrow_map(rest.repartition("key"), _apart(None), ddl), "apart")
            found, alive = best_pairs(near), near.select("key").distinct()  # links only join labels: no other shard has pairs later
        more = written(found.join(tried, ["a", "b"], "left_anti"), "pairs")
        links = written(links.union(verified(more, texts, width, threshold)), "links")
        tried = tried.union(more)
    return sets, written(component_minima(each.select("own", "first"), links), "groups")


def text_mark(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def similar(docs: DataFrame, width: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of docs: id (bigint), component_id.

    Rows are linked if their sets of width-word shingles have a Jaccard similarity of at least threshold (0.8 or more: the choices
    of bits and the radii are made for that), or are equal, as those of texts without words are. component_id is the smallest id
    that links reach; a null id never names one, and a component of null ids alone has null. Nulls: a null text counts as empty.
    Repeated rows give repeated rows; texts of any length count whole; other columns are not carried, whatever their names. An
    empty table gives an empty one.
    """
    sets, groups = _groups(docs, width, threshold, id_col, text_col)
    named = groups.select("own", F.col("least.id").alias("component_id"))
    return sets.select("id", "own").join(named, "own").select(F.col("id").alias(id_col), "component_id")


def representatives(docs: DataFrame, width: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group that `similar` links: the one of smallest id, null last; of several with that id the one whose
    text has the smallest hash; of rows equal in id and text any one. All columns are kept, whatever their names."""
    sets, groups = _groups(docs, width, threshold, id_col, text_col)
    ident, mark, own = free_names(docs, "gone_id", "gone_mark", "own_mark")
    rows = sets.select("own", F.col("id").alias(ident), text_mark(F.col("text")).alias(mark))
    told = written(rows.join(groups, "own").select(ident, mark, (~F.col(ident).eqNullSafe(F.col("least.id")) | (F.col(mark) != F.col("least.mark"))).alias("gone")), "told")
    gone = written(told.where("gone").select(ident, mark).distinct(), "gone")
    marked = docs.withColumn(own, text_mark(F.col(f"`{text_col}`")))
    same = F.col(f"`{id_col}`").cast("bigint").eqNullSafe(F.col(ident)) & (F.col(own) == F.col(mark))
    left = marked.join(broadcast_if_small(gone), same, "left_anti")
    if not told.where("NOT gone").groupBy(ident, mark).count().where("count > 1").isEmpty():  # only then texts are dealt once more
        left = left.dropDuplicates([id_col, own])
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
