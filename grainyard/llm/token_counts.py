"""Token counts by rank-synchronous array merging.

Pre-tokens stand one after the other in one array of symbols. In each round every pre-token's lowest-ranked pair is merged
at all its places at once; the symbols that survive all rounds are counted. A merge can only make pairs of higher rank, so
this gives what merging one pair at a time gives.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import pre_tokenizers

from .common import arrow_map, slices, text_bytes
from .pieces import Known, PieceTable, check_special, cuts

NONE = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself where printable, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Merger:
    """A byte-level BPE vocabulary as sorted arrays: pair -> rank, and the symbol that each rank makes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError(f"{path}: not a plain byte-level BPE vocabulary")
        ids = model["vocab"]
        self.special = sorted(check_special([t["content"] for t in spec["added_tokens"]]), key=len, reverse=True)
        self.split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.specials = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.of_char = np.zeros(512, np.int64)
        self.of_char[[ord(c) for c in byte_symbols()]] = [ids[c] for c in byte_symbols()]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.base = max(ids.values()) + 1
        keys = np.array([ids[a] * self.base + ids[b] for a, b in pairs], np.int64)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.known = Known(self.counts, 300_000)
        self.makes = np.array([ids[a + b] for a, b in pairs], np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], NONE)

    def count(self, words: list[str]) -> np.ndarray:
        """How many symbols each word, a character a byte, ends with."""
        size = np.array([len(w) for w in words], np.int64)
        left = size.copy()
        symbols, owner = self.of_char[np.frombuffer("".join(words).encode("utf-16-le"), "<u2")], np.repeat(np.arange(len(words)), size)
        while len(symbols) > 1:
            rank = self.ranks(symbols[:-1], symbols[1:])
            rank[owner[:-1] != owner[1:]] = NONE
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            low = np.minimum.reduceat(np.r_[rank, NONE], starts)
            merges = low < NONE
            if not merges.any():
                break
            group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(symbols)]))
            hit = np.r_[(rank == low[group[:-1]]) & merges[group[:-1]], False]
            # of places side by side (a a a) every second one is merged, from the left
            run = np.flatnonzero(hit & ~np.r_[False, hit[:-1]])
            place = np.flatnonzero(hit)
            taken = place[(place - run[np.searchsorted(run, place, "right") - 1]) % 2 == 0]
            symbols[taken] = self.makes[rank[taken]]
            np.subtract.at(left, owner[taken], 1)
            keep = merges[group]  # a word without any pair to merge is done
            keep[taken + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return left

    def make(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text one number, how many tokens it has, from the pre-tokens that the library cuts; a special string is one token."""
        parts: list[list[str]] = []
        extra: list[int] = []
        for t in texts:
            plain = [t] if self.specials is None or not any(s in t for s in self.special) else self.specials.split(t)
            extra.append(len(plain) - 1)
            parts.append([x for p in plain for x, _ in self.split(p)])
        self.known.fill({x for p in parts for x in p})
        totals = np.array([n + sum(map(self.known.__getitem__, p)) for n, p in zip(extra, parts)], np.uint32)
        return np.ones(len(texts), np.int64), totals

    def counts(self, words: list[str]) -> list[int]:
        runs = range(0, len(words), 50_000)
        return [n for i in runs for n in self.count(words[i : i + 50_000]).tolist()]


_counters: dict[str, PieceTable] = {}


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of docs: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    tokenizer: path of a byte-level BPE .json file that every executor can open. Nulls: a null text counts as empty (0 and 0);
    a null id stays null. Repeated rows give repeated rows; other columns are not carried. An empty table gives an empty one.
    Very long texts are counted whole; pieces that recur are counted once a worker.
    """
    types = docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"`{id_col}` {types}, n_bytes bigint, n_tokens bigint, over_limit boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _counters:
            _counters[tokenizer] = PieceTable(Merger(tokenizer).make)
        table = _counters[tokenizer]
        for batch in batches:
            for part in slices(batch, 1, 1 << 23):
                data, offsets = text_bytes(part.column(1))
                starts, first = cuts(data, offsets)
                total = np.r_[0, np.cumsum(table.tokens(table.of(data, starts)).astype(np.int64))]
                tokens = np.diff(total[first])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    return arrow_map(docs.select(id_col, text_col), run, schema)
