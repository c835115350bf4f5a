"""Language-model scores by deleted interpolation.

Bigram, unigram and uniform estimates are mixed with weights that depend on how often the context occurs. The weights are
learnt by expectation-maximisation on the counts of one fold of the training documents, held out against counts from which
that fold is deleted.

Words are 64-bit hashes. The counts of the most frequent words, at most `max_words` (or `head`, if that is more), are broadcast as
sorted arrays. Pairs of two of the `head` most frequent words, and pairs whose count is known to be zero, stay in the task that reads them, so no key that is
dealt out can be hotter than the word of rank `head`. All other pairs of broadcast words go to buckets as packed arrays, once; a
bucket counts its pairs and scores them. Pairs with a word that isn't broadcast (rare words) meet the others of that word in its
bucket, which counts the word as well: those whose second word is rare by that word, then those whose first word is rare by that.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, arrow_map, crc_mod, mixed, record_batch, slices, span_hashes, text_bytes, word_spans, written

#: Stands for the hash of a text's end.
END = 0x1D8E4E27C47D124F
#: Kinds of blobs. RARE: pairs whose second word is rare, for its bucket; LINK: whose first word is, for that one's; KNOWN: rare pairs
#: with all of their counts.
HEAD, PAIRS, DOCS, PARTIAL, RARE, LINK, KNOWN = range(7)
BUCKET_PAIRS = 1 << 21
#: Entries that a task gathers before it deals them out, so that blobs stay large when there are many buckets; rare entries a bucket;
#: rows that one task puts together at the end.
HELD_PAIRS, RARE_PAIRS, HOME_ROWS = 1 << 19, 1 << 20, 250_000
_OUT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
_OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
_BLOB = "kind int, dest int, block bigint, blob binary"
_BLOB_ARROW = pa.schema([("kind", pa.int32()), ("dest", pa.int32()), ("block", pa.int64()), ("blob", pa.binary())])


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers, byte by byte of their items (the high bytes of small numbers cost nothing), compressed."""
    head = struct.pack(f"<B{len(arrays)}c{len(arrays)}q", len(arrays), *(a.dtype.char.encode() for a in arrays), *map(len, arrays))
    return zstandard.ZstdCompressor(1).compress(b"".join([head, *(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"" for a in arrays)]))


def unpack(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = data[0]
    kinds, sizes, at = data[1 : n + 1].decode(), struct.unpack_from(f"<{n}q", data, n + 1), 9 * n + 1
    out = []
    for kind, size in zip(kinds, sizes):
        kind = np.dtype(kind)
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size).T).view(kind).reshape(size))
        at += size * kind.itemsize
    return out


def steps(sorted_keys: np.ndarray) -> np.ndarray:
    """Sorted numbers as their differences; np.cumsum gives them back."""
    return np.diff(sorted_keys, prepend=sorted_keys.dtype.type(0))


def sequences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens with each text's end behind its words, the rows of tokens, and where rows begin (and one more)."""
    data, offsets = text_bytes(texts)
    starts, ends, first = word_spans(data, offsets, SPACES[1])
    h = span_hashes(SPACES[0][data], starts, ends)
    n = np.diff(first) + 1
    row = np.repeat(np.arange(len(n)), n)
    out = np.full(len(row), END, np.uint64)
    last = np.cumsum(n) - 1
    word = np.ones(len(row), bool)
    word[last] = False
    out[word] = h
    return out, row, np.r_[0, last + 1]


class Counts:
    """Counts by word id, a byte each but for those of the first words, which are above 255, and of texts' begins (the last id)."""

    def __init__(self, counts: np.ndarray, first: int, begin: int):
        self.high, self.low, self.begin = counts[:first].copy(), np.zeros(len(counts) + 2, np.uint8), begin
        self.low[:-2] = counts

    def __getitem__(self, ids: np.ndarray) -> np.ndarray:
        out = self.low[ids].astype(np.int64)
        first = ids < len(self.high)
        out[first] = self.high[ids[first]]
        out[ids == len(self.low) - 1] = self.begin
        return out


class Vocabulary:
    """Counts by word id, ids in the order of falling counts; id n is any other word, n + 1 the begin of a text. size, total and
    fold_total are of all training words; if they are all here (whole), any other word has the count 0, else it is rare."""

    def __init__(self, columns: list[np.ndarray], size: int, total: int, fold_total: int):
        """columns: hashes, counts and counts in the fold; taken from the list, so that they can go."""
        fold, counts, keys = (columns.pop() for _ in range(3))
        end = keys == np.uint64(END)
        docs, fold_docs = int(counts[end].sum()), int(fold[end].sum())
        self.n, self.size, self.total, self.fold_total, self.whole = len(keys), size, total, fold_total, len(keys) == size
        self.covered = int(counts.sum(dtype=np.int64))
        order = np.lexsort((keys, -counts)).astype(np.int32)
        first = int((counts > 255).sum())
        self.counts, self.fold = Counts(counts[order], first, docs), Counts(fold[order], first, fold_docs)
        del counts, fold
        keys = keys[order]
        del order
        self.at = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.at]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        seen, back = np.unique(hashes, return_inverse=True)
        if not self.n:
            return np.zeros(len(hashes), np.int64)
        place = np.minimum(np.searchsorted(self.keys, seen), self.n - 1)
        return np.where(self.keys[place] == seen, self.at[place], self.n).astype(np.int64)[back]


def bucket_of(count: np.ndarray) -> np.ndarray:
    """The context's frequency bucket: the number of binary digits of its count."""
    return np.frexp(count.astype(np.float64))[1].astype(np.int64)


def learn_weights(bucket: np.ndarray, n: np.ndarray, f: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Mixture weights (uniform, unigram, bigram) of the 64 buckets, by EM on n tokens with estimates f (a row each). One token is
    added to each weight of a bucket, so that none is zero, but for the bigrams of bucket 0: a context that never occurs has none."""
    some = np.ones((64, 3))
    some[0, 2] = 0
    weight = some / some.sum(1, keepdims=True)
    for _ in range(rounds if len(n) else 0):
        part = weight[bucket] * f
        part *= (n / part.sum(1))[:, None]
        new = np.stack([np.bincount(bucket, part[:, k], 64) for k in range(3)], 1) * some + some
        new /= new.sum(1, keepdims=True)
        if np.abs(new - weight).max() < 1e-6:
            break
        weight = new
    return weight


#: Estimates are summed up in cells of 1/8 octave; a cell keeps the means of their logarithms.
STEP = 8
_CELL = "bucket bigint, i1 bigint, i2 bigint, n double, s1 double, s2 double"


def cells(context: np.ndarray, pair: np.ndarray, word: np.ndarray, n: np.ndarray, total: int) -> pa.RecordBatch:
    """Held-out tokens (n) by their deleted counts, as rows of cells."""
    f1 = np.log2(np.maximum(word, 1) / max(total, 1))
    f2 = np.log2(np.maximum(pair, 1) / np.maximum(context, 1))
    i1 = np.where(word > 0, np.rint(f1 * STEP), -10_000).astype(np.int64)
    i2 = np.where(pair > 0, np.rint(f2 * STEP), -10_000).astype(np.int64)
    key, back = np.unique(np.stack([bucket_of(context), i1, i2]), axis=1, return_inverse=True)
    sums = [np.bincount(back.ravel(), x, key.shape[1]).astype(float) for x in (n, n * f1, n * f2)]
    return pa.RecordBatch.from_arrays([*(pa.array(k, pa.int64()) for k in key), *(pa.array(x, pa.float64()) for x in sums)], ["bucket", "i1", "i2", "n", "s1", "s2"])


def weights_of(rows: DataFrame, size: int) -> np.ndarray:
    """Mixture weights from rows of cells; at most 64 x (8 x 64)^2 cells reach the driver, whatever the input."""
    got = rows.groupBy("bucket", "i1", "i2").agg(F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2")).orderBy("bucket", "i1", "i2").toArrow()
    bucket, i1, i2, n, s1, s2 = (got[c].to_numpy() for c in ("bucket", "i1", "i2", "n", "s1", "s2"))
    if not size:  # nothing was learnt: all words are the unknown one
        return np.tile([1.0, 0.0, 0.0], (64, 1))
    f = np.stack([np.full(len(n), 1 / (size + 1)), np.where(i1 > -10_000, 2 ** (s1 / n), 0), np.where(i2 > -10_000, 2 ** (s2 / n), 0)], 1)
    return learn_weights(bucket, n, f)


def log_chance(weights: np.ndarray, context: np.ndarray, pair: np.ndarray, word: np.ndarray, total: int, size: int) -> np.ndarray:
    w = weights[bucket_of(context)]
    return np.log10(w[:, 0] / (size + 1) + w[:, 1] * word / max(total, 1) + w[:, 2] * pair / np.maximum(context, 1))


def _word_counts(docs: DataFrame) -> DataFrame:
    """(h, c, d): each training word's count and its count in the fold; each task's words are counted before they are dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def merged() -> list[np.ndarray]:
            h, c, d = (np.concatenate([x[k] for x in held]) for k in range(3))
            key, back = np.unique(h, return_inverse=True)
            return [key, np.bincount(back, c, len(key)).astype(np.int64), np.bincount(back, d, len(key)).astype(np.int64)]

        for batch in batches:
            for part in slices(batch, 1):
                h, row, _ = sequences(part.column(1))
                fold = (part.column(2).to_numpy() == 3)[row]
                key, back = np.unique(h, return_inverse=True)
                held.append([key, np.bincount(back, minlength=len(key)), np.bincount(back, fold, len(key)).astype(np.int64)])
                size += len(key)
                if size > 1 << 20:
                    held = [merged()]
                    size = len(held[0][0])
        if held:
            h, c, d = merged()
            for i in range(0, len(h), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)]) for x in (h.view(np.int64), c, d)], ["h", "c", "d"])

    return arrow_map(docs.where("part <> 2"), run, "h bigint, c bigint, d bigint").groupBy("h").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))


def _vocabulary(counted: DataFrame, most: int) -> Vocabulary:
    """All words if there are at most `most`; else those with at least as many occurrences as leave at most so many, and the end."""
    size, total, fold_total, top = counted.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum("d"), F.lit(0)), F.coalesce(F.max("c"), F.lit(0))).first()
    some = counted
    if size > most:
        by_count = counted.groupBy("c").agg(F.count("*").alias("n")).toArrow()  # sqrt(2 * total) rows at most
        c, n = (by_count[k].to_numpy() for k in ("c", "n"))
        order = np.argsort(-c)
        fit = int((np.cumsum(n[order]) <= most).sum())
        some = counted.where((F.col("c") >= int(c[order][fit - 1] if fit else top + 1)) | (F.col("h") == END))
    kind = "int" if top < 1 << 31 else "bigint"
    got = some.select("h", F.col("c").cast(kind), F.col("d").cast(kind)).toArrow()
    columns = [got["h"].to_numpy().view(np.uint64), got["c"].to_numpy(), got["d"].to_numpy()]
    del got
    pa.default_memory_pool().release_unused()
    return Vocabulary(columns, size, total, fold_total)


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Meanwhile Spark deletes a query's shuffle files at the query's end, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, old)


def lm_scores(docs: DataFrame, max_words: int = 8_000_000, head: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words of the whole text, A-Z in lower case, and one end. Rows with crc32(id as text) mod 7 = 2 are held out of
    all counts; those with 3 are also the fold that the weights are learnt on. base_score sums log10((c + 1) / (N + V + 1));
    score is the mixture's log10 probability, with all words never seen in training as one more word.
    Nulls: a null text counts as empty (one token, the end); a null id stays null and hashes as the empty text. Repeated rows give
    repeated rows; other columns are not carried. An empty table gives an empty one; without training rows all words are unknown.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), crc_mod(id_col, 7).cast("int").alias("part"))
    with _shuffles_deleted(docs.sparkSession):
        return _scores(rows, max_words, head)


def _scores(rows: DataFrame, max_words: int, head: int) -> DataFrame:
    sc = rows.sparkSession.sparkContext
    vocabulary = _vocabulary(written(_word_counts(rows), "words"), max(max_words, head))
    size, total, whole = vocabulary.size, vocabulary.total, vocabulary.whole
    text, n_rows = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    parts = int(text // (5 * BUCKET_PAIRS)) + 1
    homes = max(parts // 8, n_rows // HOME_ROWS) + 1
    rares = (total - vocabulary.covered) * 8 // 3 // RARE_PAIRS + 1  # two pairs a token, and a third more for texts that are held out
    shared = sc.broadcast(vocabulary)
    del vocabulary

    entries = _entries(rows, shared, head, parts, rares)
    heads = arrow_map(entries.where(F.col("kind") == HEAD), _head_counts(shared, head), "pair bigint, c bigint, d bigint").groupBy("pair").agg(F.sum("c").alias("c"), F.sum("d").alias("d")).toArrow()
    dense = np.zeros((2, (head + 1) * head), np.int64)
    dense[:, heads["pair"].to_numpy()] = heads["c"].to_numpy(), heads["d"].to_numpy()
    pairs = sc.broadcast(dense)
    mine = entries.where(F.col("kind").isin(HEAD, PAIRS, KNOWN))
    if not whole:
        links = entries.where(F.col("kind") == LINK).repartitionById(rares, F.col("dest"))
        mine = mine.union(written(arrow_map(links, _by_context(shared), _BLOB), "links"))
    weights = weights_of(arrow_map(mine, _held_out_cells(shared, pairs, head), _CELL), size)
    partial = arrow_map(mine, _partial_scores(shared, pairs, weights, head, parts, homes), _BLOB)
    infos = entries.where(F.col("kind") == DOCS).withColumn("dest", F.col("dest") % homes)
    return arrow_map(partial.union(infos).repartitionById(homes, F.col("dest")), _totals(total), _OUT)


def _spread(block: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(block.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _dealt(kind: int, to: np.ndarray, n: int, blocks: np.ndarray, owner: np.ndarray, *arrays: np.ndarray, key: bool = False) -> list[tuple]:
    """Rows of blobs, one a value of `to`: the blocks that occur in it, each entry's one (by its place among them), and the arrays.
    key: the first array is of sorted keys."""
    order = np.argsort(to.astype(np.uint16 if n <= 1 << 16 else np.int64), kind="stable")
    edge = np.searchsorted(to[order], np.arange(n + 1))
    out = []
    for b in np.flatnonzero(np.diff(edge)).tolist():
        at = order[edge[b] : edge[b + 1]]
        used, own = np.unique(owner[at], return_inverse=True)
        some = [a[at] for a in arrays]
        if key:
            some[0] = steps(some[0])
        out.append((kind, b, 0, pack(blocks[used], own.astype(np.uint16 if len(used) <= 1 << 16 else np.uint32), *some)))
    return out


def _together(blobs: list[bytes], key: bool = False) -> list[np.ndarray]:
    """Blobs of `_dealt` as one, blocks and owners first."""
    parts = [unpack(x) for x in blobs]
    if key:
        for p in parts:
            p[2] = np.cumsum(p[2])
    lead = np.cumsum([0, *(len(p[0]) for p in parts)])
    owner = np.concatenate([p[1].astype(np.uint32) + np.uint32(k) for p, k in zip(parts, lead)])
    return [np.concatenate([p[0] for p in parts]), owner, *(np.concatenate([p[k] for p in parts]) for k in range(2, len(parts[0])))]


def _entries(rows: DataFrame, shared, head: int, parts: int, rares: int) -> DataFrame:
    """Blobs of pairs: HEAD rows (pairs of head words, and pairs known not to occur in training), one PAIRS row a bucket, DOCS rows;
    of rare words KNOWN and LINK rows."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary: Vocabulary = shared.value
        v, block = vocabulary.n, TaskContext.get().partitionId() << 24
        held: list[tuple] = []
        rare: list[tuple] = []
        size = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            out = []
            if held:
                blocks, owner, key, doc, times, flag = _gathered(held)
                order = np.argsort(key, kind="stable")
                key = key[order]
                dest = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts
                out += _dealt(PAIRS, dest, parts, blocks, owner[order], key, doc[order], times[order], flag[order], key=True)
            if rare:
                blocks, owner, x, y, doc, times, mark = _gathered(rare)
                zero = np.zeros(len(x), np.int64)
                for kind, on, by in ((RARE, mark & 8 > 0, y), (LINK, mark & 8 == 0, x)):
                    out += _dealt(kind, _spread(by[on], rares), rares, blocks, *(a[on] for a in (owner, x, y, doc, times, mark, zero, zero)))
            held.clear()
            rare.clear()
            if out:
                yield record_batch(_BLOB_ARROW, *zip(*out))

        for batch in batches:
            for part in slices(batch, 1):
                h, row, first = sequences(part.column(1))
                word = vocabulary.ids(h)
                context = np.r_[v + 1, word[:-1]]
                context[first[:-1]] = v + 1
                remainder = part.column(2).to_numpy()
                flag = np.where(remainder == 2, 0, np.where(remainder == 3, 2, 1)).astype(np.uint8)
                c = vocabulary.counts[word]
                base = np.bincount(row, np.log10(c + 1), len(flag)) - np.diff(first) * np.log10(vocabulary.total + vocabulary.size + 1)
                ids = part.column(0)
                info = pack(ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), flag == 0, np.diff(first), np.bincount(row, c > 0, len(flag)).astype(np.int64), base)
                if not vocabulary.whole:
                    far = (word == v) | (context == v)
                    at = np.flatnonzero(far)
                    mark = (context[at] == v) * np.uint8(4) + (word[at] == v) * np.uint8(8)
                    x, y = np.where(mark & 4, h[at - 1], context[at].view(np.uint64)), np.where(mark & 8, h[at], word[at].view(np.uint64))
                    order = np.lexsort((mark, y, x, row[at]))
                    x, y, mark, doc = x[order], y[order], mark[order], row[at][order]
                    new = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (mark[1:] != mark[:-1]) | (doc[1:] != doc[:-1])]) if len(x) else order
                    times = np.diff(np.r_[new, len(x)]).astype(np.uint32)
                    rare.append((block, x[new], y[new], doc[new].astype(np.uint16), times, (mark[new] + flag[doc[new]]).astype(np.uint8)))
                    size += len(new)
                    context, word, row = context[~far], word[~far], row[~far]
                # one entry for each text and pair
                key = (context << 32) | word
                order = np.lexsort((row, key))
                key, row = key[order], row[order]
                new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])]) if len(key) else order
                times = np.diff(np.r_[new, len(key)]).astype(np.uint32)
                key, doc = key[new], row[new].astype(np.uint16)
                context, word = key >> 32, key & 0xFFFFFFFF
                place = np.where(context == v + 1, head, context)
                near = (place <= head) & ((place < head) | (context == v + 1)) & (word < min(head, v))
                never = (vocabulary.counts[word] == 0) | (vocabulary.counts[context] == 0)
                near &= ~never
                here = [a for m in (near, never) for a in (steps(key[m]), doc[m], times[m])]
                home = int(_spread(np.array([block]), parts)[0])  # the task that puts a block's scores together follows from it
                yield record_batch(_BLOB_ARROW, [HEAD, DOCS], [home, home], [block, block], [pack(*here, flag), info])
                far = ~(near | never)
                held.append((block, key[far], doc[far], times[far], flag[doc[far]]))
                size += len(held[-1][1])
                block += 1
                if size > HELD_PAIRS:
                    yield from flushed()
                    size = 0
        yield from flushed()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list[bytes]] = {}
        for batch in batches:
            for kind, dest, block, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if kind in (PAIRS, RARE):
                    found.setdefault((kind, dest), []).append(blob)
                else:
                    yield record_batch(_BLOB_ARROW, [kind], [dest], [block], [blob])
        for (kind, dest), blobs in found.items():
            if kind == PAIRS:
                blocks, owner, key, doc, times, flag = _together(blobs, key=True)
                order = np.argsort(key, kind="stable")
                out = [(PAIRS, dest, 0, pack(blocks, owner[order], steps(key[order]), doc[order], times[order], flag[order]))]
            else:
                blocks, owner, x, y, doc, times, mark, _, _ = _together(blobs)
                c, d = _sums(y, times, mark)
                both = mark & 4 > 0
                out = _dealt(LINK, _spread(x[both], rares), rares, blocks, *(a[both] for a in (owner, x, y, doc, times, mark, c, d)))
                if not both.all():
                    owner, x, y, doc, times, mark, c, d = (a[~both] for a in (owner, x, y, doc, times, mark, c, d))
                    vocabulary: Vocabulary = shared.value
                    before = [a[x.astype(np.int64)] for a in (vocabulary.counts, vocabulary.fold)]
                    out.append((KNOWN, dest, 0, _known(blocks, owner, x, y, doc, times, mark, *before, c, d)))
            blobs.clear()
            yield record_batch(_BLOB_ARROW, *zip(*out))

    dealt = arrow_map(rows, read, _BLOB).repartitionById(max(parts, rares), F.col("dest"))
    return written(arrow_map(dealt, gather, _BLOB), "pairs")


def _gathered(held: list[tuple]) -> list[np.ndarray]:
    """Blocks' entries in one: the blocks, each entry's one by its place, and the arrays."""
    owner = np.repeat(np.arange(len(held), dtype=np.uint32), [len(x[1]) for x in held])
    return [np.array([x[0] for x in held], np.int64), owner, *(np.concatenate([x[k] for x in held]) for k in range(1, len(held[0])))]


def _sums(key: np.ndarray, times: np.ndarray, mark: np.ndarray) -> list[np.ndarray]:
    """For each entry its key's training and fold counts."""
    seen, back = np.unique(key, return_inverse=True)
    return [np.bincount(back, times * on, len(seen)).astype(np.int64)[back] for on in (mark & 3 > 0, mark & 3 == 2)]


def _known(blocks, owner, x, y, doc, times, mark, cx, dx, cy, dy) -> bytes:
    """A blob of the distinct pairs (entries; counts of the first word, the second and the pair, in training and fold; whether the
    second word is rare) and of their entries."""
    order = np.lexsort((mark >> 2, y, x))
    x, y, times, mark = x[order], y[order], times[order], mark[order]
    first = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (mark[1:] >> 2 != mark[:-1] >> 2)])
    c, d = (np.add.reduceat(times.astype(np.int64) * on, first) for on in (mark & 3 > 0, mark & 3 == 2))
    return pack(blocks, np.diff(np.r_[first, len(x)]), *(a[order[first]] for a in (cx, dx, cy, dy)), c, d, mark[first] & 8 > 0, owner[order], doc[order], times)


def _by_context(shared):
    """KNOWN blobs from the LINK rows of all pairs that begin with a bucket's rare words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[bytes]] = {}
        for batch in batches:
            for dest, blob in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                found.setdefault(dest, []).append(blob)
        for dest, blobs in found.items():
            vocabulary: Vocabulary = shared.value
            blocks, owner, x, y, doc, times, mark, cy, dy = _together(blobs)
            blobs.clear()
            at = np.where(mark & 8, 0, y).astype(np.int64)
            cy, dy = (np.where(mark & 8, c, a[at]) for c, a in ((cy, vocabulary.counts), (dy, vocabulary.fold)))
            yield record_batch(_BLOB_ARROW, [KNOWN], [dest], [0], [_known(blocks, owner, x, y, doc, times, mark, *_sums(x, times, mark), cy, dy)])

    return run


def _head_counts(shared, head: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, dense = shared.value.n, np.zeros((2, (head + 1) * head), np.int64)
        for batch in batches:
            for blob in batch.column(3).to_pylist():
                key, doc, times, _, _, _, flag = unpack(blob)
                at = _head_place(np.cumsum(key), v, head)
                for k, on in enumerate((flag[doc] > 0, flag[doc] == 2)):
                    dense[k] += np.bincount(at[on], times[on], dense.shape[1]).astype(np.int64)
        at = np.flatnonzero(dense[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(dense[0, at]), pa.array(dense[1, at])], ["pair", "c", "d"])

    return run


def _head_place(key: np.ndarray, v: int, head: int) -> np.ndarray:
    context = key >> 32
    return np.where(context == v + 1, head, context) * head + (key & 0xFFFFFFFF)


def _by_key(key: np.ndarray, times: np.ndarray, flag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of a sorted bucket, their training and fold counts, and how many entries each has."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    if not len(key):
        return key, first, first, first
    times = times.astype(np.int64)
    return key[first], np.add.reduceat(times * (flag > 0), first), np.add.reduceat(times * (flag == 2), first), np.diff(np.r_[first, len(key)])


def _held_out_cells(shared, pairs, head: int):
    """Cells of the fold's tokens: a bucket reports all tokens of its pairs, a HEAD row those that it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary: Vocabulary = shared.value
        v, total = vocabulary.n, vocabulary.total - vocabulary.fold_total
        left = lambda ids: vocabulary.counts[ids] - vocabulary.fold[ids]
        for batch in batches:
            for kind, blob in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                if kind == KNOWN:
                    _, _, cx, dx, cy, dy, c, d, *_ = unpack(blob)
                    on = d > 0
                    yield cells((cx - dx)[on], (c - d)[on], (cy - dy)[on], d[on].astype(float), total)
                    continue
                if kind == PAIRS:
                    _, _, key, _, times, flag = unpack(blob)
                    key, c, d, _ = _by_key(np.cumsum(key), times, flag)
                    on = d > 0
                    yield cells(left(key[on] >> 32), (c - d)[on], left(key[on] & 0xFFFFFFFF), d[on].astype(float), total)
                    continue
                *here, flag = unpack(blob)
                for near, key, doc, times in ((True, *here[:3]), (False, *here[3:])):
                    on = flag[doc] == 2
                    key, n = np.cumsum(key)[on], times[on].astype(float)
                    count = (pairs.value[0] - pairs.value[1])[_head_place(key, v, head)] if near else np.zeros(len(key), np.int64)
                    yield cells(left(key >> 32), count, left(key & 0xFFFFFFFF), n, total)

    return run


def _partial_scores(shared, pairs, weights: np.ndarray, head: int, parts: int, homes: int):
    """PARTIAL rows: sums by text for the task that puts its block together; of rare words also of base_score and n_known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary: Vocabulary = shared.value
        v, total, size = vocabulary.n, vocabulary.total, vocabulary.size

        def score(key: np.ndarray, count: np.ndarray) -> np.ndarray:
            return log_chance(weights, vocabulary.counts[key >> 32], count, vocabulary.counts[key & 0xFFFFFFFF], total, size)

        def out(blocks: np.ndarray, owner: np.ndarray, doc: np.ndarray, *values: np.ndarray) -> pa.RecordBatch:
            seen, back = np.unique((owner.astype(np.int64) << 16) | doc, return_inverse=True)
            values = [np.bincount(back, x, len(seen)) for x in values]
            block, doc = blocks[seen >> 16], (seen & 0xFFFF).astype(np.uint16)
            to = _spread(block, parts) % homes
            order = np.argsort(to, kind="stable")
            edge = np.searchsorted(to[order], np.arange(homes + 1))
            some = np.flatnonzero(np.diff(edge)).tolist()
            return record_batch(_BLOB_ARROW, [PARTIAL] * len(some), some, [0] * len(some), [pack(*(x[at] for x in (block, doc, *values))) for at in (order[edge[b] : edge[b + 1]] for b in some)])

        for batch in batches:
            for kind, block, blob in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
                if kind == HEAD:
                    *here, flag = unpack(blob)
                    value = 0
                    for near, key, doc, times in ((True, *here[:3]), (False, *here[3:])):
                        key = np.cumsum(key)
                        count = pairs.value[0][_head_place(key, v, head)] if near else np.zeros(len(key), np.int64)
                        value = value + np.bincount(doc, score(key, count) * times, len(flag))
                    yield out(np.array([block]), np.zeros(len(flag), np.int64), np.arange(len(flag)), value)
                elif kind == PAIRS:
                    blocks, owner, key, doc, times, flag = unpack(blob)
                    distinct, c, _, n = _by_key(np.cumsum(key), times, flag)
                    yield out(blocks, owner, doc, np.repeat(score(distinct, c), n) * times)
                else:
                    blocks, n, cx, _, cy, _, c, _, rare, owner, doc, times = unpack(blob)
                    value = log_chance(weights, cx, c, cy, total, size), np.log10(cy + 1) * rare, (cy > 0) & rare
                    yield out(blocks, owner, doc, *(np.repeat(x, n) * times for x in value))

    return run


def _totals(train_tokens: int):
    """Sums the parts of each text's score. A partition's blocks are wholly its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        infos, partial = [], []
        for batch in batches:
            for kind, _, block, blob in zip(*(c.to_pylist() for c in batch.columns)):
                (infos if kind == DOCS else partial).append((block, blob))
        at = {}
        texts = 0
        rows = []
        for block, blob in infos:
            rows.append(unpack(blob))
            at[block] = texts
            texts += len(rows[-1][0])
        if not texts:
            return
        ids, null, held, n, known, base = (np.concatenate([r[k] for r in rows]) for k in range(6))
        score = np.zeros(texts)
        for _, blob in partial:
            block, doc, *values = unpack(blob)
            own, back = np.unique(block, return_inverse=True)
            place = np.array([at[b] for b in own.tolist()], np.int64)[back] + doc
            for whole, value in zip((score, base, known), values):
                whole += np.bincount(place, value, texts).astype(whole.dtype)
        for i in range(0, texts, 10_000):
            s = slice(i, i + 10_000)
            m = len(ids[s])
            yield record_batch(_OUT_ARROW, pa.array(ids[s], pa.int64(), mask=null[s]), held[s], n[s], known[s], np.full(m, train_tokens), base[s], score[s])

    return run

