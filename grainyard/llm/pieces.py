"""Cutting texts where the byte-level pattern always cuts, so that work on a piece can be kept and used again.

A single space between two non-space characters starts a pre-token, and a single line feed between two is one, whatever stands
around them; a pre-token also starts at each of , . ; : ! ? behind an ASCII letter or digit. Nothing is cut elsewhere. A `PieceTable` knows
pieces by their bytes and asks for the tokens of new ones in bulk.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), *range(28, 33)]] = True
#: Marks that end a run of letters or digits. No special string may hold one of them, or white space.
MARKS = ",.;:!?"
_MARK, _PLAIN = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(MARKS.encode())] = True
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
#: White space of more than one byte, by first byte: the bytes that follow.
_WIDE = {0xC2: [b"\x85", b"\xa0"], 0xE1: [b"\x9a\x80"], 0xE2: [*(bytes([0x80, b]) for b in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), b"\x81\x9f"], 0xE3: [b"\x80\x80"]}


class Known(dict):
    """Values of strings; `fill` asks for the missing ones in bulk. Beyond `most` it starts anew."""

    def __init__(self, make: Callable[[list[str]], list[Any]], most: int):
        self.make, self.most = make, most

    def fill(self, keys: set[str]) -> None:
        new = [k for k in keys if k not in self]
        if len(self) + len(new) > self.most and self:
            self.clear()
            new = list(keys)
        if new:
            self.update(zip(new, self.make(new)))


def check_special(strings: list[str]) -> list[str]:
    if any(c in MARKS or c.isspace() for s in strings for c in s):
        raise ValueError(f"special strings with white space or one of {MARKS} are cut")
    return strings


def white(data: np.ndarray) -> np.ndarray:
    """Which bytes are part of white space."""
    out, more = _SPACE[data], np.r_[data, np.zeros(2, np.uint8)]
    for lead, rest in _WIDE.items():
        at = np.flatnonzero(data == lead)
        for tail in rest:
            found = at[np.all([more[at + 1 + k] == b for k, b in enumerate(tail)], axis=0)]
            for k in range(len(tail) + 1):
                out[found + k] = True
    return out


def cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all pieces, and for each row (and one more) the index of its first piece. Empty rows have none."""
    start = np.zeros(len(data) + 1, bool)
    if len(data) > 2:
        solid = ~white(data)
        alone = np.flatnonzero(((data[1:-1] == 32) | (data[1:-1] == 10)) & solid[:-2] & solid[2:]) + 1
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        alone = alone[~edge[alone] & ~edge[alone + 1]]
        start[alone] = True
        start[alone[data[alone] == 10] + 1] = True
        start[1:-1] |= _MARK[data[1:]] & _PLAIN[data[:-1]]
    start[offsets] = True
    start = np.flatnonzero(start[:-1])
    return start, np.searchsorted(start, offsets)


class PieceTable:
    """Tokens of pieces, found by the pieces' own bytes."""

    def __init__(self, make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 1 << 20, most_bytes: int = 1 << 26):
        """make: how many tokens each new string has, and all their tokens one after the other. So many pieces, or bytes of them, are kept; beyond, the table starts anew."""
        self.make, self.most, self.most_bytes = make, most, most_bytes
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.bytes, self.used = 0, 0
        self.size, self.at = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.flat = np.zeros(1 << 14, np.uint32)

    def of(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Each piece's row in size (its number of tokens) and at (their place in flat)."""
        if not len(starts):
            return starts
        offsets = np.r_[starts, len(data)].astype(np.int32)  # a slice, or one string, which Spark keeps under 2 GB
        found = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        pieces = byte_strings(found.dictionary)
        new = [p for p in pieces if p not in self.place]
        more = sum(map(len, new))
        if self.place and (len(self.place) + len(new) > self.most or self.bytes + more > self.most_bytes):
            self.clear()
            new, more = pieces, sum(map(len, pieces))
        for i in range(0, len(new), 1 << 16):
            self._add(new[i : i + (1 << 16)])
        self.bytes += more
        return np.fromiter(map(self.place.__getitem__, pieces), np.int64, len(pieces))[found.indices.to_numpy()]

    def _add(self, pieces: list[bytes]) -> None:
        size, flat = self.make([p.decode() for p in pieces])
        n, used = len(self.place), self.used + len(flat)
        to = n + len(pieces)
        self.size, self.at, self.flat = grown(self.size, to), grown(self.at, to), grown(self.flat, used)
        self.size[n:to] = size
        self.at[n:to] = self.used + np.cumsum(size) - size
        self.flat[self.used : used] = flat
        self.place.update(zip(pieces, range(n, to)))
        self.used = used

    def tokens(self, rows: np.ndarray) -> np.ndarray:
        """The tokens of these rows, one after the other."""
        size = self.size[rows]
        return self.flat[np.repeat(self.at[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())]


def byte_strings(column: pa.Array) -> list[bytes]:
    """The values of a binary column without nulls."""
    _, offsets, data = column.buffers()
    edge = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4).tolist()
    data = data.to_pybytes() if data is not None else b""
    return [data[a:b] for a, b in zip(edge, edge[1:])]


def grown(x: np.ndarray, n: int) -> np.ndarray:
    """x with room for n entries: doubled until it has."""
    while len(x) < n:
        x = np.r_[x, np.zeros_like(x)]
    return x
