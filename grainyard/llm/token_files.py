"""Token-id output: canonical length-limited Huffman codes from global counts, in independent blocks.

A block holds the code bits of a run of documents in ascending id order, each from a whole byte on, and checkpoints: the bit
offset of every CHECKPOINT-th symbol of each document. A block knows its range of documents and its place (`at`, in ids) there. All stretches between checkpoints are decoded side by side, a table
look-up a symbol. The files are Parquet: `codebook` (one row: the code length of each id) and `blocks`.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, kept, record_batch, scratch_path, slices, text_bytes, written
from .pieces import PieceTable, check_special, cuts

MAX_BITS, CHECKPOINT = 16, 512
#: A block ends before it would hold more ids; a range of document ids is to have about RANGE_TOKENS, or more where that would make over MOST_RANGES.
BLOCK_TOKENS, RANGE_TOKENS, MOST_RANGES = 1 << 20, 1 << 22, 1 << 16
#: Bytes of text that are cut into pieces at a time.
SLICE_BYTES = 1 << 23
#: Places of so many ranges, 16 bytes each, are broadcast to readers; those of more are joined.
MOST_BROADCAST_RANGES = 1 << 20


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code with at most `most` bits (package-merge); 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << most:
        raise ValueError(f"{len(used)} symbols don't fit codes of {most} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.float64)
    level, kinds = leaf, [np.ones(len(leaf), bool)]
    for _ in range(most - 1):
        packed = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.r_[leaf, packed]
        at = np.argsort(both, kind="stable")
        level = both[at]
        kinds.append(at < len(leaf))
    take = 2 * len(leaf) - 2
    for kind in reversed(kinds):
        leaves = int(kind[:take].sum())
        lengths[order[:leaves]] += 1
        take = 2 * (take - leaves)
    return lengths


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes by id, and ids in the order of their codes: by length, then by id."""
    ids = np.flatnonzero(lengths)
    ids = ids[np.argsort(lengths[ids], kind="stable")]
    size = lengths[ids].astype(np.int64)
    width = int(size[-1]) if len(size) else 0
    upper = np.cumsum(1 << (width - size)) - (1 << (width - size))
    codes = np.zeros(len(lengths), np.uint32)
    codes[ids] = upper >> (width - size)
    return codes, ids


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each 16-bit window, the id that it begins with and its code's length."""
    _, ids = canonical(lengths)
    span = 1 << (MAX_BITS - lengths[ids].astype(np.int64))
    pad = (1 << MAX_BITS) - int(span.sum())
    return np.r_[np.repeat(ids, span), np.zeros(pad, np.int64)].astype(np.uint32), np.r_[np.repeat(lengths[ids], span), np.ones(pad, np.uint8)].astype(np.int64)


def encode(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of ids, padded to whole bytes, and the bit offset of every CHECKPOINT-th id."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    at = end - size
    value = codes[ids].astype(np.uint64) << (64 - size - (at & 31)).astype(np.uint64)
    n = int(end[-1]) // 32 + 2 if len(ids) else 0
    words = np.zeros(n + 1, np.uint64)
    words[:n] += np.bincount(at >> 5, (value >> np.uint64(32)).astype(np.float64), n).astype(np.uint64)
    words[1:] += np.bincount(at >> 5, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n).astype(np.uint64)
    return words.astype(">u4").tobytes()[: (int(end[-1]) + 7) // 8 if len(ids) else 0], at[::CHECKPOINT]


def decode(bits: np.ndarray, starts: np.ndarray, counts: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The ids of stretches that begin at the given bits and hold so many ids each, one stretch after the other."""
    out = np.empty(int(counts.sum()), np.uint32)
    order = np.argsort(-counts, kind="stable")
    at, left, to = starts[order].copy(), counts[order], (np.cumsum(counts) - counts)[order]
    data = np.r_[bits, np.zeros(8, np.uint8)].astype(np.uint32)
    window = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    symbol, size = table
    live = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), "left")  # stretches with more than k ids
    for k, n in enumerate(live.tolist()):
        p = at[:n]
        w = (window[p >> 3] >> (8 - (p & 7)).astype(np.uint32)) & np.uint32(0xFFFF)
        out[to[:n] + k] = symbol[w]
        p += size[w]
    return out


class Encoder:
    """Ids of pieces by the tokenizers library, for those that a table asks for.

    The library takes pieces one after the other as one text, where their borders are certain: where a piece that begins with one
    space and another character follows one that doesn't end in white space. The ids' own bytes then tell which piece they are of.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        check_special(list(special.values()))
        vocabulary = self.tokenizer.get_vocab()
        self.length = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)  # in bytes: a character is a byte
        for token, i in vocabulary.items():
            self.length[i] = len(special[i].encode()) if i in special else len(token)

    def make(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        runs, now, many = [], [], 0
        for t in texts:
            joins = now and many < 1 << 16 and t[0] == " " and len(t) > 1 and not t[1].isspace() and not now[-1][-1].isspace()
            if not joins:
                now, many = [], 0
                runs.append(now)
            now.append(t)
            many += len(t)
        found = [e.ids for i in range(0, len(runs), 4096) for e in self.tokenizer.encode_batch_fast(["".join(r) for r in runs[i : i + 4096]], add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(found), np.uint32, sum(map(len, found)))
        ends = np.cumsum(np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts)))
        reached = np.cumsum(self.length[ids])
        last = np.searchsorted(reached, ends)
        if len(texts) and (reached[last] != ends).any():
            raise ValueError("a token crosses the border of two pieces")
        return np.diff(last + 1, prepend=0), ids


def encoder(path: str) -> Encoder:
    """This worker's."""
    return kept(path, lambda: Encoder(path))


_IDS = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("crc", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])
_BLOCK = pa.schema([("bucket", pa.int32()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("places", pa.list_(pa.int64())), ("marks", pa.binary()), ("bits", pa.binary())])
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
_DDL = {pa.int64(): "bigint", pa.int32(): "int", pa.binary(): "binary", pa.list_(pa.int64()): "array<bigint>"}


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_DDL[f.type]}" for f in schema)


def token_ids(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str, slice_bytes: int) -> DataFrame:
    """(id, n, crc, ids, counts): each text's ids and the end id, as little-endian 16- or 32-bit integers by what they need, their
    number and checksum; and one row a task, with nothing but how often it met each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, counts = PieceTable(encoder(tokenizer).make), np.zeros(0, np.int64)  # the task's own: pieces are many, and a worker outlives it
        for batch in batches:
            for part in slices(batch, 1, slice_bytes):
                data, offsets = text_bytes(part.column(1))
                starts, first = cuts(data, offsets)
                rows = table.of(data, starts)
                edge = np.r_[0, np.cumsum(table.size[rows])][first]
                ids = np.insert(table.tokens(rows), edge[1:], end_id)
                edge += np.arange(len(edge))
                counts = summed(counts, np.bincount(ids))
                wide = ids.max(initial=0) >= 1 << 16
                mark, width, raw = (b"\0", 4, ids.astype("<u4").tobytes()) if wide else (b"", 2, ids.astype("<u2").tobytes())
                packed = [mark + raw[a:b] for a, b in zip((edge[:-1] * width).tolist(), (edge[1:] * width).tolist())]
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[a:b]) for a, b in zip((edge[:-1] * 4).tolist(), (edge[1:] * 4).tolist())]
                yield record_batch(_IDS, part.column(0).cast(pa.int64()), np.diff(edge), crc, packed, pa.nulls(len(part), pa.binary()))
        if len(counts):
            yield record_batch(_IDS, [None], [None], [None], [None], [counts.astype("<i8").tobytes()])

    return arrow_map(docs.select(F.col(id_col).cast("bigint").alias("id"), text_col), run, ddl(_IDS), keeps=True)


def summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum of two arrays of counts, the shorter one filled up with zeros."""
    out = np.zeros(max(len(a), len(b)), np.int64)
    out[: len(a)] = a
    out[: len(b)] += b
    return out


def unpacked(x: bytes) -> np.ndarray:
    """16-bit ids have an even number of bytes; 32-bit ones follow a zero byte."""
    return np.frombuffer(x, "<u4", offset=1) if len(x) % 2 else np.frombuffer(x, "<u2").astype(np.uint32)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", range_tokens: int = RANGE_TOKENS, slice_bytes: int = SLICE_BYTES) -> None:
    """Encode every text and write the ids under `path`, documents in ascending id order.

    A null text is empty (its only id is the end id); a null document id comes first; documents with equal ids stand side by
    side, shorter ones first, then by checksum, so that the files don't depend on the input's order. An empty table gives an
    empty codebook and no blocks. Other columns are not carried. Texts of any length are encoded whole: a long one makes a
    block of its own. Texts are cut into pieces for about slice_bytes of them at a time: more take more memory, less repeat work. Ranges of document ids, about range_tokens ids each, are what tasks write; repeated ids may fill several. The
    driver receives one count for each id of the vocabulary. More than 65,536 distinct ids don't fit codes of 16 bits: an error.
    """
    spark = docs.sparkSession
    found = written(token_ids(docs, tokenizer, end_id, id_col, text_col, slice_bytes), "ids")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total = summed(total, np.frombuffer(x, "<i8"))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["token", "n"])

    told = arrow_map(found.where("counts IS NOT NULL").select("counts"), tally, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    token, n = told["token"].to_numpy(), told["n"].to_numpy()
    counts = np.zeros(int(token.max()) + 1 if len(token) else 0, np.int64)
    counts[token] = n
    lengths = code_lengths(counts)
    codes, _ = canonical(lengths)
    spark.createDataFrame([(bytearray(lengths.tobytes()), MAX_BITS, CHECKPOINT)], "lengths binary, max_bits int, checkpoint int").write.parquet(f"{path}/codebook")
    shared = spark.sparkContext.broadcast((codes, lengths))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, lengths = shared.value
        bucket, at, rows, total = TaskContext.get().partitionId(), 0, [], 0

        def block() -> pa.RecordBatch:
            size = np.array([len(bits) for *_, bits in rows], np.int64)
            return record_batch(_BLOCK, [bucket], [at], [total], [[r[0] for r in rows]], [[r[1] for r in rows]], [(np.cumsum(size) - size).tolist()], [b"".join(r[2] for r in rows)], [b"".join(r[3] for r in rows)])

        for batch in batches:
            for key, n, x in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and total + n > BLOCK_TOKENS:
                    yield block()
                    at, rows, total = at + total, [], 0
                bits, marks = encode(unpacked(x), codes, lengths)
                rows.append((key, n, marks.astype("<i8").tobytes(), bits))
                total += n
        if rows:
            yield block()

    parts = max(1, min(int(counts.sum()) // range_tokens, MOST_RANGES))
    order = [F.asc_nulls_first("id"), F.asc("n"), F.asc("crc"), F.asc("_row")]  # rows that only _row tells apart are the same in the files
    ids = found.where("counts IS NULL").withColumn("_row", F.monotonically_increasing_id())
    dealt = ids.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", "n", "ids")
    arrow_map(dealt, blocks, ddl(_BLOCK)).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    shared.unpersist()


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """From the files alone: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (little-endian 32-bit ids)."""
    head = spark.read.parquet(f"{path}/codebook").first()
    if (head.max_bits, head.checkpoint) != (MAX_BITS, CHECKPOINT):
        raise ValueError("the files have other code lengths or checkpoints")
    lengths = np.frombuffer(bytes(head.lengths), np.uint8)
    kept = spark.read.schema(ddl(_BLOCK)).parquet(f"{path}/blocks")
    sums = written(kept.groupBy("bucket").agg(F.sum("n_tokens").alias("sum")), "ranges")  # a row a range of ids
    before = sums.select("bucket", (F.sum("sum").over(Window.orderBy("bucket")) - F.col("sum")).alias("before"))
    small = sums.count() <= MOST_BROADCAST_RANGES
    rows = kept.join(F.broadcast(before) if small else before, "bucket").select((F.col("before") + F.col("at")).alias("start"), "ids", "counts", "places", "marks", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(lengths)
        for batch in batches:
            for i in range(batch.num_rows):
                start, ids, counts, places, marks, bits = (c[i].as_py() for c in batch.columns)
                counts = np.array(counts, np.int64)
                stretches = -(-counts // CHECKPOINT)
                sizes = np.full(int(stretches.sum()), CHECKPOINT, np.int64)
                sizes[np.cumsum(stretches) - 1] = counts - (stretches - 1) * CHECKPOINT
                found = decode(np.frombuffer(bits, np.uint8), np.frombuffer(marks, "<i8") + np.repeat(np.array(places, np.int64) * 8, stretches), sizes, table)
                end = np.cumsum(counts)
                crc = [zlib.crc32(found[a:b].astype("<u4")) for a, b in zip((end - counts).tolist(), end.tolist())]
                yield record_batch(_READ, ids, start + end - counts, counts, crc)

    return arrow_map(rows, run, ddl(_READ))


def token_file_digests(docs: DataFrame, tokenizer: str, end_id: int = 0, range_tokens: int = RANGE_TOKENS) -> DataFrame:
    """Write the token files of docs to the shared folder and read them back."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer, end_id, range_tokens=range_tokens)
    return read_token_files(docs.sparkSession, path)
