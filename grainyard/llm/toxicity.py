"""Toxicity scores from subword-bag embeddings averaged into a linear softmax.

A word is itself and its character n-grams, each hashed to a row of an embedding table; a text is the average of the rows of
all its words' features; a linear softmax gives the chance of label 1. Table and softmax are trained together in numpy. An
unseen misspelling shares most n-grams with the word it stands for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from .common import SPACES, arrow_map, broadcast_if_small, crc_mod, mixed, ngram_hashes, written
from .wordbags import bag_sums, worker_table


_STOPS = bytes(b + 32 if 65 <= b < 91 else 32 if chr(b) in ",.;:\"()|" else b for b in range(256))


#: A longer word is cut into pieces of PIECE bytes that overlap by OVERLAP, so that each n-gram of OVERLAP + 1 lies in one.
PIECE, OVERLAP = 64, 3

#: Spans of more bytes are hashed one by one.
LONG = 64
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def feature_hashes(lowered: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes: its length, then eight bytes at a time mixed in, all spans side by side; XXH64 for spans
    of over LONG bytes. A choice of buckets for features; to tell spans apart see span_hashes."""
    padded = np.r_[lowered, np.zeros(8, np.uint8)]
    eight = np.ndarray(len(lowered) + 1, "<u8", padded, strides=(1,))  # those that begin at each byte
    size = ends - starts
    out = size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    live = np.flatnonzero((size > 0) & (size <= LONG))
    for k in range(0, LONG, 8):
        w = eight[starts[live] + k] & _KEEP[np.minimum(size[live] - k, 8)]
        out[live] = mixed(out[live] + w * np.uint64(0x9E3779B97F4A7C15))
        live = live[size[live] > k + 8]
        if not len(live):
            break
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = xxhash.xxh64_intdigest(padded[starts[i] : ends[i]])
    return out


def split_words(text: bytes) -> list[bytes]:
    """Lower-case words (A-Z only), apart at white space and at common punctuation; long ones in overlapping pieces."""
    words = text.translate(_STOPS).split()
    if max(map(len, words), default=0) <= PIECE:
        return words
    return [w[i : i + PIECE] for w in words for i in range(0, max(1, len(w) - OVERLAP), PIECE - OVERLAP)]


def word_features(words: list[bytes], buckets: int, shortest: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words' features, word by word, and where each word's begin. Words stand in < and >."""
    marked = [b"<" + w + b">" for w in words]
    data = np.frombuffer(b"".join(marked), np.uint8)
    first = np.r_[0, np.cumsum([len(w) for w in marked])].astype(np.int64)
    letters = SPACES[0][data].astype(np.uint64) + np.uint64(1)
    found, owner = [feature_hashes(data, first[:-1], first[1:])], [np.arange(len(words))]
    for n in range(shortest, longest + 1):
        h, row = ngram_hashes(letters, first, n)
        found.append(h + np.uint64(n))
        owner.append(row)
    h, owner = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return (h[order] % np.uint64(buckets)).astype(np.int64), np.searchsorted(owner[order], np.arange(len(words) + 1))


@dataclass
class SubwordBag:
    """buckets, n-gram lengths and width of the embeddings; table and head are learnt."""

    buckets: int = 1 << 16
    shortest: int = 3
    longest: int = OVERLAP + 1
    width: int = 4
    epochs: int = 10
    rate: float = 0.05
    seed: int = 7
    table: np.ndarray | None = None
    head: np.ndarray | None = None
    bias: np.ndarray | None = None
    logit: np.ndarray | None = None

    def fit(self, texts: list[str], labels: np.ndarray, batch: int = 64) -> SubwordBag:
        """Adam steps on the cross-entropy of the softmax, gradients reaching table and head alike."""
        rng = np.random.default_rng(self.seed)
        split = [split_words(t.encode()) for t in texts]
        vocab = {w: i for i, w in enumerate(dict.fromkeys(w for x in split for w in x))}
        words = list(vocab)
        parts = [word_features(words[i : i + 10_000], self.buckets, self.shortest, self.longest) for i in range(0, len(words), 10_000)]
        feature = np.concatenate([np.zeros(0, np.int32), *(f.astype(np.int32) for f, _ in parts)])
        size = np.concatenate([np.zeros(0, np.int64), *(np.diff(first) for _, first in parts)])
        first = np.cumsum(size) - size
        del words, parts
        bags = [np.unique(np.array([vocab[w] for w in x], np.int64), return_counts=True) for x in split]
        self.table = rng.normal(0, 0.1, (self.buckets, self.width)).astype(np.float32)
        self.head = rng.normal(0, 0.1, (self.width, 2)).astype(np.float32)
        rate = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.01
        self.bias = np.log(np.array([1 - rate, rate], np.float32))
        state = [np.zeros_like(x) for x in (self.table, self.table, self.head, self.head, self.bias, self.bias)]
        step = 0
        for _ in range(self.epochs if vocab else 0):
            order = rng.permutation(len(bags))
            for i in range(0, len(order), batch):
                step += 1
                take = order[i : i + batch]
                word = np.concatenate([bags[k][0] for k in take])
                times = np.concatenate([bags[k][1] for k in take])
                doc = np.repeat(np.arange(len(take)), [len(bags[k][0]) for k in take])
                n = np.maximum(np.bincount(doc, times * size[word], len(take)), 1)
                used, at = np.unique(word, return_inverse=True)
                begin = np.cumsum(size[used]) - size[used]
                rows = feature[np.arange(size[used].sum()) + np.repeat(first[used] - begin, size[used])]
                vectors = np.add.reduceat(self.table[rows], begin, axis=0) if len(rows) else np.zeros((0, self.width), np.float32)
                share = (times / n[doc]).astype(np.float32)
                mean = np.zeros((len(take), self.width), np.float32)
                for k in range(self.width):
                    mean[:, k] = np.bincount(doc, vectors[at, k] * share, len(take))
                z = mean @ self.head + self.bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                error = p.copy()
                error[np.arange(len(take)), labels[take]] -= 1
                error /= len(take)
                back = error @ self.head.T
                by_word = np.zeros((len(used), self.width), np.float32)
                for k in range(self.width):
                    by_word[:, k] = np.bincount(at, back[doc, k] * share, len(used))
                spread = np.repeat(by_word, size[used], axis=0)
                by_row = np.stack([np.bincount(rows, spread[:, k], self.buckets) for k in range(self.width)], 1).astype(np.float32)
                grow = np.sqrt(1 - 0.999**step) / (1 - 0.9**step) * self.rate
                for value, g, m, v in ((self.table, by_row, *state[:2]), (self.head, mean.T @ error, *state[2:4]), (self.bias, error.sum(0), *state[4:])):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    value -= grow * m / (np.sqrt(v) + 1e-7)
        self.logit = self.table @ (self.head[:, 1] - self.head[:, 0]) * np.float32(len(bags) > 0)
        return self

    def set_odds(self, sample: np.ndarray, whole: np.ndarray) -> SubwordBag:
        """Correct the bias for a sample drawn by label: from its counts of labels 0 and 1 to those of all rows."""
        if sample.all() and whole.all():
            self.bias = (self.bias + np.log(whole / whole.sum()) - np.log(sample / sample.sum())).astype(np.float32)
        return self

    def word_values(self, words: list[bytes]) -> np.ndarray:
        """For each word, the sum over its features of the logit that they add, and their number."""
        feature, first = word_features(words, self.buckets, self.shortest, self.longest)
        return np.stack([np.add.reduceat(self.logit[feature], first[:-1]) if len(words) else np.zeros(0), np.diff(first)], 1)

    def scores(self, sums: np.ndarray) -> np.ndarray:
        """Chances of label 1 from texts' sums of word_values."""
        z = sums[:, 0] / np.maximum(sums[:, 1], 1) + (self.bias[1] - self.bias[0])
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def labelled_sample(marks: DataFrame, docs: DataFrame, most: int, id_col: str, text_col: str, most_labels: int = 1000) -> tuple[list[str], list]:
    """Texts and labels of at most `most` documents of each label: the bound on what trains.

    marks: (id, label). The ids of smallest hash are taken for each label, in one pass over all, and only their texts are read; of
    rows with one id the least text counts. Null ids and labels are left out. More than most_labels labels are an error.
    """
    marks = marks.toDF("id", "label").where("id IS NOT NULL AND label IS NOT NULL").distinct().withColumn("h", F.xxhash64(F.lit("train"), "id"))
    counts = marks.groupBy("label").agg(F.count("*").alias("n")).limit(most_labels + 1).collect()
    if len(counts) > most_labels:
        raise ValueError(f"more than {most_labels} labels")
    sizes = docs.sparkSession.createDataFrame(counts, StructType([StructField("_label", marks.schema["label"].dataType), StructField("_n", LongType())]))
    # hashes spread evenly, so the smallest lie among those under a share of four times as many: few rows of a label meet in a task
    near = (F.col("h") / 2.0**64 + 0.5) * F.col("_n") < 4.0 * most + 100
    few = marks.join(F.broadcast(sizes), F.col("label") == F.col("_label")).where(near).select("id", "label", "h")
    ranked = few.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("h", "id"))).where(F.col("k") <= most)
    picked = ranked.select("id", "label", "h")  # at most `most` rows of each of most_labels labels
    own = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))
    got = own.join(F.broadcast(picked), own["_id"] == picked["id"]).groupBy("h", "id", "label").agg(F.min("_text").alias("text")).orderBy("h", "id", "label").toArrow()
    return got["text"].to_pylist(), got["label"].to_pylist()


def train_toxicity(docs: DataFrame, labels: DataFrame, most: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> SubwordBag:
    """Fit on at most `most` documents of each label, then set to the labels' odds among all rows. Rows of labels with null id or
    label are left out; of several labels of one document the largest holds. Without labelled rows, as for empty tables, every score
    is the least chance (0.01). Training takes whole texts of any length; null ones count as empty."""
    marks = labels.where(F.col("toxic").isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max("toxic").cast("int").alias("_toxic"))
    marks = broadcast_if_small(written(marks, "marks"))  # a row a labelled document; while they are few, the documents' ids aren't dealt
    marks = written(docs.select(F.col(id_col).alias("_own")).join(marks, F.col("_id") == F.col("_own")).select("_id", "_toxic").distinct(), "labelled")
    texts, y = labelled_sample(marks, docs, most, id_col, text_col)
    count = dict(marks.groupBy("_toxic").count().collect())
    return SubwordBag().fit(texts, np.array(y, np.int64)).set_odds(np.bincount(np.array(y, np.int64), minlength=2), np.array([count.get(0, 0), count.get(1, 0)]))


def toxicity_scores(docs: DataFrame, model: SubwordBag, threshold: float = 0.3, text_col: str = "text", score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= threshold, else 0) as last columns.

    A null or empty text, and one of separators alone, gets the model's prior. Texts of any length count whole, words of any length
    too. All columns of docs are kept as they are; columns named like the new ones are replaced. Repeated rows and ties get equal
    scores; an empty table gives an empty one. The model (a few MB, set by its buckets) is broadcast.
    """
    kept = docs.drop(score_col, predicted_col)
    place = kept.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(replace(model, table=None, head=None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        table = worker_table([model.logit, model.bias], model.word_values, 2)
        for batch in batches:
            for part, sums in bag_sums(batch, place, split_words, table):
                score = model.scores(sums)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*part.schema.names, score_col, predicted_col])

    fields = [*kept.schema.fields, StructField(score_col, DoubleType()), StructField(predicted_col, IntegerType())]
    return arrow_map(kept, run, StructType(fields), keeps=True)


def held_in(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows that models may learn from: crc32(id as text) mod 4 is not 2."""
    return docs.where(crc_mod(id_col, 4) != 2)
