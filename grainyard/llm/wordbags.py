"""Cutting texts into words whose values a worker keeps, for models that see a text as a bag of words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from .common import kept, slices


class WordTable:
    """Rows of numbers by word: asks `make` for missing words in bulk and starts anew beyond `most` words."""

    def __init__(self, make: Callable[[list[bytes]], np.ndarray], width: int, most: int = 1 << 19):
        self.make, self.most = make, most
        self.place: dict[bytes, int] = {}
        self.rows = np.zeros((1 << 12, width), np.float32)

    def of(self, words: list[bytes]) -> np.ndarray:
        """The words' rows' places in self.rows."""
        place = self.place
        new = list(dict.fromkeys(w for w in words if w not in place))
        if len(place) + len(new) > self.most and place:
            place.clear()
            new = list(dict.fromkeys(words))
        if new:
            n = len(place)
            while n + len(new) > len(self.rows):
                self.rows = np.r_[self.rows, np.zeros_like(self.rows)]
            for i in range(0, len(new), 1 << 15):
                part = new[i : i + (1 << 15)]
                self.rows[n + i : n + i + len(part)] = self.make(part)
            place.update(zip(new, range(n, n + len(new))))
        return np.fromiter(map(place.__getitem__, words), np.int64, len(words))


def worker_table(weights: list[np.ndarray], make: Callable[[list[bytes]], np.ndarray], width: int) -> WordTable:
    """This worker's table for the model with these weights; it outlives the task, and goes when another model or operator comes."""
    return kept(hash(tuple(w.tobytes() for w in weights)), lambda: WordTable(make, width))


def bag_sums(batch: pa.RecordBatch, text: int, split: Callable[[bytes], list[bytes]], table: WordTable) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batch, each with the sum of its rows' words' numbers. A long text's words are taken in runs."""
    for part in slices(batch, text):
        words = [split(t.encode()) if t else [] for t in part.column(text).to_pylist()]
        flat = [w for x in words for w in x]
        owner = np.repeat(np.arange(len(words)), [len(x) for x in words])
        total = np.zeros((len(words), table.rows.shape[1]))
        for i in range(0, len(flat), 1 << 16):
            at = table.of(flat[i : i + (1 << 16)])  # may grow or replace the rows
            rows = table.rows[at]
            own = owner[i : i + (1 << 16)]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            total[own[first]] += np.add.reduceat(rows, first, axis=0, dtype=np.float64)
        yield part, total
