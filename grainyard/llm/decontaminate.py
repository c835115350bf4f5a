"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by their number of distinct shingles, in powers of two. An item of n shingles, need = ceil(threshold * n)
of which make a match, keeps a bottom-k MinHash: its k shingles of smallest hash. A document that holds `need` of the item's shingles
lacks n - need at most, and so holds k - (n - need) of any k. Each partition sets that bound (`least`: more sketch shingles to hit for
larger items) and with it k = n - need + least. Documents' shingle hashes are looked up among the sketches, pairs below their
partition's bound go, and the rest are verified by exact containment of the shingles themselves. No match is lost however long the
document is (with k independent minima of the document a short item inside a long one is mostly missed).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PLAIN, arrow_map, broadcast_if_small, free_names, ngram_hashes, record_batch, slices, span_hashes, text_bytes, word_spans, written

_ITEM = pa.schema([("no", pa.int64()), ("item_id", pa.int64()), ("text", pa.string()), ("width", pa.int32()), ("n", pa.int32()), ("need", pa.int32()), ("least", pa.int32()), ("sketch", pa.list_(pa.int64()))])
_HIT = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("text", pa.string()), ("hits", pa.list_(pa.int64()))])
_PAIR = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_shingles", pa.int32()), ("shared", pa.int32()), ("mark", pa.int64())])
_SPLIT = bytes(b + 32 if 65 <= b < 91 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-case runs (A-Z only) of ASCII letters and digits and of all non-ASCII characters."""
    return (text or "").encode().translate(_SPLIT).split()


def shingles(words: list[bytes], width: int) -> set[bytes]:
    return {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


def shingle_hashes(texts: pa.Array, widths: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each width, the hashes of all rows' shingles, and their rows. The width is part of the hash."""
    data, offsets = text_bytes(texts)
    starts, ends, first = word_spans(data, offsets, PLAIN[1])
    words = span_hashes(PLAIN[0][data], starts, ends)
    for w in widths:
        h, row = ngram_hashes(words, first, w)
        yield h + np.uint64(w), row


def partition_bound(n: int) -> int:
    """How many sketch shingles a document must hold of items in the partition of n: half the binary digits of its sizes."""
    return max(1, n.bit_length() // 2)


def sketched(items: DataFrame, threshold: float, width: int) -> DataFrame:
    """(no, item_id, text, width, n, need, least, sketch) of items (item_id, text); those without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no = TaskContext.get().partitionId() << 33
        for batch in batches:
            rows = []
            for key, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = words_of(text)
                if not words:
                    continue
                w = min(width, len(words))
                n = len(shingles(words, w))
                need = math.ceil(round(threshold * n, 9))
                least = min(need, partition_bound(n))
                h, _ = next(shingle_hashes(pa.array([text], pa.string()), [w]))
                rows.append((no, key, text, w, n, need, least, np.unique(h)[: n - need + least].view(np.int64)))
                no += 1
            if rows:
                yield record_batch(_ITEM, *zip(*rows))

    return arrow_map(items, run, "no bigint, item_id bigint, text string, width int, n int, need int, least int, sketch array<bigint>")


def _looked_up(own: DataFrame, keys, widths: list[int]) -> DataFrame:
    """Rows of own (id, text) that hold a shingle of the sketches: row, doc_id, text, hits (distinct hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, number = keys.value, TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, 1):
                h, row = (np.concatenate(x) for x in zip(*shingle_hashes(part.column(1), widths)))
                at = np.minimum(np.searchsorted(table, h), len(table) - 1)
                on = table[at] == h
                h, row = h[on], row[on]
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                new = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])][: len(h)]
                h, row = h[new], row[new]
                some, first = np.unique(row, return_index=True)
                if len(some):
                    hits = pa.ListArray.from_arrays(pa.array(np.r_[first, len(h)], pa.int32()), pa.array(h.view(np.int64)))
                    texts = part.column(1).take(pa.array(some)).cast(pa.string())
                    yield record_batch(_HIT, number + some, part.column(0).take(pa.array(some)), texts, hits)
                number += len(part)

    return arrow_map(own, run, "row bigint, doc_id bigint, text string, hits array<bigint>")


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns: doc_id, text, mark, item_id, item's text, width, n, need."""
    for batch in batches:
        rows, last, words = [], None, []
        for i in range(len(batch)):
            key, text, mark, item, asked, width, n, need = (c[i].as_py() for c in batch.columns)
            if text != last:
                words, last = words_of(text), text
            shared = len(shingles(words, width) & shingles(words_of(asked), width))
            if shared >= need:
                rows.append((key, item, n, shared, mark))
        yield record_batch(_PAIR, *(zip(*rows) if rows else [[]] * 5))


def _found(docs: DataFrame, items: DataFrame, threshold: float, width: int, most_bytes: int, id_col: str, text_col: str, item_id: str, item_text: str) -> DataFrame:
    """contaminations with `mark`, the hash of the document's text."""
    spark = docs.sparkSession
    texts = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.coalesce(item_text, F.lit("")).alias("text"))
    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    known = written(sketched(texts, threshold, width), "sketches")
    told = known.agg(F.coalesce(F.sum(F.size("sketch")), F.lit(0)).alias("n"), F.sort_array(F.collect_set("width")).alias("widths")).first()
    groups, found = told.n * 8 // most_bytes + 1, []
    for g in range(groups):
        some = known.where(F.pmod(F.xxhash64("no"), F.lit(groups)) == g)
        entries = some.select("no", "least", F.explode("sketch").alias("hash"))
        keys = np.sort(entries.select("hash").distinct().toArrow()["hash"].to_numpy().view(np.uint64))
        if not len(keys):
            continue
        shared = spark.sparkContext.broadcast(keys)
        hits = written(_looked_up(own, shared, list(told.widths)), "hits")
        shared.unpersist()
        pairs = hits.select("row", F.explode("hits").alias("hash")).join(entries, "hash").groupBy("row", "no").agg(F.count("*").alias("held"), F.first("least").alias("least")).where("held >= least")
        asked = some.select("no", "item_id", F.col("text").alias("asked"), "width", "n", "need")
        both = pairs.select("row", "no").join(hits.select("row", "doc_id", "text", F.xxhash64("text").alias("mark")), "row").join(asked, "no")
        found.append(arrow_map(both.select("doc_id", "text", "mark", "item_id", "asked", "width", "n", "need"), _verified, "doc_id bigint, item_id bigint, item_shingles int, shared int, mark bigint"))
    if not found:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, item_shingles int, shared int, mark bigint")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def contaminations(docs: DataFrame, items: DataFrame, threshold: float = 0.8, width: int = 5, most_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs (doc_id, item_id, item_shingles, shared): documents that hold at least `threshold` of an item's distinct shingles.

    Shingles have `width` words; an item of fewer words has all of them as its only shingle, looked for at that width. Items
    without a word match nothing. Nulls: null texts count as empty, null ids stay null. Repeated documents give repeated pairs;
    so do repeated items. Other columns are not carried, whatever their names. Empty tables give no pairs. Texts of any length are
    searched whole. Items are sketched in tasks; only the sketches' distinct hashes are broadcast, in groups of items whose
    sketches have `most_bytes` (measured first), a pass over the documents each and each broadcast freed after its pass.
    """
    return _found(docs, items, threshold, width, most_bytes, id_col, text_col, item_id, item_text).drop("mark")


def decontaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8, width: int = 5, most_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the rows that contain an item, all columns kept, whatever their names. Rows are told apart by id (null is an id)
    and text, so that of rows with one id only those with a match go. Empty tables: without items all rows stay."""
    found = _found(docs, items, threshold, width, most_bytes, id_col, text_col, item_id, item_text)
    hit_id, hit_mark, own = free_names(docs, "hit_id", "hit_mark", "own_mark")
    # written, so that its size is known and, while it is small, the documents aren't dealt out to join it
    hit = written(found.select(F.col("doc_id").alias(hit_id), F.col("mark").alias(hit_mark)).distinct(), "found")
    marked = docs.withColumn(own, F.xxhash64(text_col))
    same = F.col(id_col).cast("bigint").eqNullSafe(F.col(hit_id)) & (F.col(own) == F.col(hit_mark))
    return marked.join(broadcast_if_small(hit), same, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
