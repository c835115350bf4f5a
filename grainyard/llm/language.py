"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's bytes (letters and all non-ASCII bytes, one space for all between them) in both directions and labels
every position; a document's probabilities are the means over all its positions. The state is carried on from word to word. So that
the stretches of a long text can be read side by side, it is read in windows of CORE positions, and each direction starts MARGIN
positions before the first that it labels. It is trained in numpy by backpropagation through time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import arrow_map, slices
from .toxicity import labelled_sample

CORE, MARGIN = 224, 24
_LETTER = regex.compile(r"\p{L}")
#: A-Z to lower case, and all other ASCII characters but letters to a space.
_LETTERS = bytes(b + 32 if 65 <= b < 91 else b if 97 <= b < 123 or b > 127 else 32 for b in range(256))


def letters(text: str | None) -> bytes:
    return b" ".join((text or "").encode().translate(_LETTERS).split())


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes as rows of a matrix (zeros behind), and lengths."""
    size = np.array([len(w) for w in words], np.int64)
    x = np.zeros((len(words), int(size.max(initial=1))), np.int64)
    x[np.arange(x.shape[1]) < size[:, None]] = np.frombuffer(b"".join(words), np.uint8)
    return x, size


def turned(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Each row's first `size` entries in reverse; doing it twice gives x."""
    at = np.arange(x.shape[1])
    return np.take_along_axis(x, (np.where(at < size[:, None], size[:, None] - 1 - at, at)).reshape(x.shape[:2] + (1,) * (x.ndim - 2)), 1)


@dataclass
class ByteGRU:
    """width: units a direction; weights holds, for each direction, byte -> gates (update, reset, new), state -> gates; then the softmax."""

    langs: list[str]
    width: int = 8
    seed: int = 11
    weights: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self) -> None:
        rng, h = np.random.default_rng(self.seed), self.width
        scale = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        self.weights = self.weights or [scale(256, 3 * h), scale(h, 3 * h), scale(256, 3 * h), scale(h, 3 * h), scale(2 * h, len(self.langs)), np.zeros(len(self.langs), np.float32)]

    def states(self, x: np.ndarray, size: np.ndarray, table: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
        """The state behind each position, and what the way back needs."""
        n = self.width
        h = np.zeros((len(x), n), np.float32)
        out, kept = np.zeros((len(x), x.shape[1], n), np.float32), []
        for t in range(x.shape[1]):
            gates, on = table[x[:, t]], (t < size)[:, None]
            turned_h = h @ turn
            z, r = sigmoid(gates[:, :n] + turned_h[:, :n]), sigmoid(gates[:, n : 2 * n] + turned_h[:, n : 2 * n])
            new = np.tanh(gates[:, 2 * n :] + r * turned_h[:, 2 * n :])
            kept.append((h, z, r, new, turned_h[:, 2 * n :], on))
            h = np.where(on, (1 - z) * new + z * h, h)
            out[:, t] = h
        return out, kept

    def back(self, x: np.ndarray, turn: np.ndarray, d_out: np.ndarray, kept: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the byte table and the state's weights from those of the states."""
        n = self.width
        d_table, d_turn = np.zeros((256, 3 * n), np.float32), np.zeros_like(turn)
        dh = np.zeros((len(x), n), np.float32)
        for t in reversed(range(x.shape[1])):
            h, z, r, new, fed, on = kept[t]
            dh = dh + d_out[:, t]
            d_new = dh * (1 - z) * (1 - new * new) * on
            d_z = dh * (h - new) * z * (1 - z) * on
            d_r = d_new * fed * r * (1 - r)
            through = np.concatenate([d_z, d_r, d_new * r], 1)
            d_turn += h.T @ through
            np.add.at(d_table, x[:, t], np.concatenate([d_z, d_r, d_new], 1))
            dh = np.where(on, dh * z, dh) + through @ turn.T
        return d_table, d_turn

    def probabilities(self, x: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Each position's probabilities of the languages, the states under them, and both directions' records."""
        table, turn, table_b, turn_b, head, bias = self.weights
        y = turned(x, size)
        ahead, kept = self.states(x, size, table, turn)
        behind, kept_b = self.states(y, size, table_b, turn_b)
        both = np.concatenate([ahead, turned(behind, size)], 2)
        z = both @ head + bias
        p = np.exp(z - z.max(2, keepdims=True))
        return p / p.sum(2, keepdims=True), both, (y, kept, kept_b)

    def gradients(self, x: np.ndarray, size: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Cross-entropy, averaged over weighted positions, and its gradients."""
        p, both, (y, kept, kept_b) = self.probabilities(x, size)
        on = (np.arange(x.shape[1]) < size[:, None]) * weight[:, None]
        total, n = on.sum(), self.width
        loss = -(np.log(np.take_along_axis(p, label[:, None, None], 2)[..., 0] + 1e-30) * on).sum() / total
        d = p.copy()
        np.put_along_axis(d, label[:, None, None], np.take_along_axis(d, label[:, None, None], 2) - 1, 2)
        d = (d * (on / total)[..., None]).astype(np.float32)
        d_both = d @ self.weights[4].T
        first = self.back(x, self.weights[1], d_both[..., :n], kept)
        second = self.back(y, self.weights[3], turned(d_both[..., n:], size), kept_b)
        return float(loss), [*first, *second, np.einsum("btk,btl->kl", both, d), d.sum((0, 1))]

    def fit(self, texts: list[str], langs: np.ndarray, steps: int = 400, batch: int = 128, length: int = 64, rate: float = 0.02) -> ByteGRU:
        """Adam steps on windows from all texts, as many of each language, drawn from all places of its texts alike."""
        rng = np.random.default_rng(self.seed)
        whole = [b" ".join(x for t, given in zip(texts, langs) if given == lang and (x := letters(t))) for lang in self.langs]
        known = [k for k, x in enumerate(whole) if x]
        if not known:
            return self
        moments = [(np.zeros_like(w), np.zeros_like(w)) for w in self.weights]
        for step in range(1, steps + 1):
            label = rng.choice(known, batch)
            size = np.array([len(whole[k]) for k in label])
            start = (rng.random(batch) * np.maximum(size - length + 1, 1)).astype(np.int64)
            x, size = padded([whole[k][i : i + length] for k, i in zip(label.tolist(), start.tolist())])
            _, grads = self.gradients(x, size, label, np.ones(batch, np.float32))
            pace = rate * min(1.0, 2 * (1 - step / (steps + 1))) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for w, g, (m, v) in zip(self.weights, grads, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= (pace * m / (np.sqrt(v) + 1e-7)).astype(np.float32)
        return self

    def reading(self, x: np.ndarray, table: np.ndarray, turn: np.ndarray, head: np.ndarray) -> np.ndarray:
        """What one direction adds to the languages' logits: positions, languages, windows. x: bytes, a row a position, a column a
        window. Windows lie side by side in memory, so that each step is a few operations on long rows."""
        n = self.width
        half = np.r_[np.full(2 * n, 0.5), np.ones(n)].astype(np.float32)[:, None]  # sigmoid(x) = (1 + tanh(x / 2)) / 2
        table, turn = np.ascontiguousarray(table.T) * half, np.ascontiguousarray(turn.T) * half
        h = np.zeros((n, x.shape[1]), np.float32)
        states = np.empty((len(x), *h.shape), np.float32)
        fed, gates = np.empty((2, 3 * n, x.shape[1]), np.float32)
        for row, state in zip(x, states):
            np.matmul(turn, h, out=fed)
            np.take(table, row, axis=1, out=gates, mode="clip")
            both = gates[: 2 * n]
            both += fed[: 2 * n]
            np.tanh(both, out=both)
            both *= 0.5
            both += 0.5
            new = fed[2 * n :]
            new *= both[n:]
            new += gates[2 * n :]
            np.tanh(new, out=new)
            np.subtract(h, new, out=state)
            state *= both[:n]
            state += new
            h = state
        return np.matmul(np.ascontiguousarray(head.T), states)

    def pooled(self, data: np.ndarray, offsets: np.ndarray, batch: int = 2048) -> np.ndarray:
        """For each text of letters (data from one offset to the next) the sums of the languages' probabilities over its positions."""
        table, turn, table_b, turn_b, head, bias = self.weights
        size = np.diff(offsets)
        windows = -(-size // CORE)
        doc = np.repeat(np.arange(len(size)), windows)
        core = offsets[doc] + CORE * (np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows))
        past = np.minimum(core + CORE, offsets[doc + 1])
        first, last = np.maximum(core - MARGIN, offsets[doc]), np.minimum(past + MARGIN, offsets[doc + 1])
        total = np.zeros((len(size), len(self.langs)))
        order = np.argsort(last - first, kind="stable")
        for i in range(0, len(order), batch):
            w = order[i : i + batch]
            n = last[w] - first[w]
            at = np.arange(n.max())[:, None]
            ahead = self.reading(data[np.minimum(first[w] + at, last[w] - 1)], table, turn, head[: self.width])
            behind = self.reading(data[np.maximum(last[w] - 1 - at, first[w])], table_b, turn_b, head[self.width :])
            z = ahead + np.take_along_axis(behind, np.maximum(n - 1 - at, 0)[:, None, :], 0) + bias[:, None]
            z -= z.max(1, keepdims=True)
            p = np.exp(z, out=z)
            p /= p.sum(1, keepdims=True)
            on = (at >= core[w] - first[w]) & (at < past[w] - first[w])
            np.add.at(total, doc[w], np.einsum("tkb,tb->bk", p, on.astype(np.float32)))
        return total


def train_language(docs: DataFrame, most: int = 150, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", width: int = 8) -> ByteGRU:
    """Fit on at most `most` documents of each language (those with the smallest hashes of their ids), on their whole texts of any
    length. Rows with null id, text or lang teach nothing, and of repeated ids the least text; without any row, as for an empty table,
    the model has no language. width: units a direction."""
    docs = docs.where(F.col(text_col).isNotNull())
    texts, langs = labelled_sample(docs.select(id_col, lang_col), docs, most, id_col, text_col)
    return ByteGRU(sorted(set(langs)), width).fit(texts, np.array(langs))


def languages(docs: DataFrame, model: ByteGRU, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (the pooled probability of lang_pred, 0 to 1) as last columns.

    A text that is null, or without any letter, gets `und` and 0, as does every text if the model knows no language. Of equal
    chances the alphabetically first language wins. Other columns stay; columns named lang_pred or score are replaced.
    Equal texts, in repeated rows too, get equal results up to rounding; texts of any length are read whole; an empty table gives an
    empty one. The model is a few KB and broadcast.
    """
    kept = docs.drop("lang_pred", "score")
    place = kept.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, place):
                texts = part.column(place).to_pylist()
                none = [not model.langs or t is None or not _LETTER.search(t) for t in texts]
                read = [b"" if no else letters(t) for no, t in zip(none, texts)]
                offsets = np.r_[0, np.cumsum([len(x) for x in read])].astype(np.int64)
                chance = model.pooled(np.frombuffer(b"".join(read), np.uint8), offsets) / np.maximum(np.diff(offsets), 1)[:, None]
                best = chance.argmax(1) if model.langs else np.zeros(len(texts), int)
                pred = ["und" if no else model.langs[k] for no, k in zip(none, best)]
                score = [0.0 if no else min(1.0, round(float(c[k]), 6)) for no, c, k in zip(none, chance, best)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*part.schema.names, "lang_pred", "score"])

    fields = [*kept.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    return arrow_map(kept, run, StructType(fields))
