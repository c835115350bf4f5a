"""Byte-level BPE by the tiktoken library with a local file of ranks: texts to ids, ids to bytes.

A long text is cut where any text would be cut by the pattern, so that the library sees a bounded part at a time. The library's
regular expressions overflow on very long runs of white space, whose matches are known without them: such a run is one match
but for its last character, if more text follows.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, slices

#: The pattern that the cuts below hold for: contractions, letters, digits and marks with one space before them, white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters and digits that every version of Unicode calls so.
_PLAIN = r"0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0400-\u0481\u048a-\u052f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
_MARKS = r",.;:!?\u3001\u3002\uff01\uff0c\uff1f"
#: A match always starts at white space behind anything else, and at a mark behind a letter or digit.
CUT = re.compile(rf"(?<=[^{WHITE}\x1c-\x1f])(?=[{WHITE}])|(?<=[{_PLAIN}])(?=[{_MARKS}])")
#: Characters of a text that the library gets at a time, at least; and of a run of white space that it doesn't get to match.
PART, RUN = 1 << 16, 1 << 10


class Codec:
    """A file of ranks (lines of a base64 token and its rank) and a pattern."""

    def __init__(self, path: str, pattern: str):
        if pattern != PATTERN:
            raise ValueError("the cuts of long texts hold for byte_bpe.PATTERN only")
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}
        self.encoding = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.whole = tiktoken.Encoding(f"{path}, whole", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str, part: int = PART, run: int = RUN) -> np.ndarray:
        return np.concatenate([np.empty(0, np.int32), *(np.array(self._ids(t, run), np.int32) for t in parts(text, part))])

    def _ids(self, text: str, run: int) -> list[int]:
        half = max(1, run // 2)
        if not any(text[i : i + half].isspace() for i in range(0, len(text), half)):  # a run of `run` characters fills one of these
            return self.encoding.encode_ordinary(text)
        out, at = [], 0
        for found in re.finditer(rf"[{WHITE}]{{{run},}}", text):
            end = found.end() if found.end() == len(text) else found.end() - 1
            out += self.encoding.encode_ordinary(text[at : found.start()]) + self.whole.encode_ordinary(text[found.start() : end])
            at = end
        return out + self.encoding.encode_ordinary(text[at:])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.encoding.decode_bytes(ids[i : i + PART].tolist()) for i in range(0, len(ids), PART))


def parts(text: str, part: int) -> Iterator[str]:
    """The text in parts of `part` characters or somewhat more, each of which starts where a match starts."""
    at = 0
    while len(text) - at > part and (cut := CUT.search(text, at + part)):
        yield text[at : cut.start()]
        at = cut.start()
    if at < len(text):
        yield text[at:]


@lru_cache(4)
def codec(path: str, pattern: str) -> Codec:
    """One a worker."""
    return Codec(path, pattern)


def encoded(docs: DataFrame, ranks: str, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of docs: id, ids (array of int), without special tokens.

    ranks: path of a file of ranks that every executor can open; each match of the pattern is merged by itself. Nulls: a null text
    counts as empty and has no ids; a null id stays null. Bytes that aren't UTF-8 count as the replacement character. Repeated rows
    give repeated rows; other columns are not carried, whatever their names. An empty table gives an empty one. Texts of any length
    count whole.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        for batch in batches:
            for some in slices(batch, 1):
                ids = [own.encode(t) for t in (x or "" for x in some.column(1).to_pylist())]
                ends = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids)))], [id_col, "ids"])

    valid = F.make_valid_utf8(F.col(f"`{text_col}`")).alias("text")
    return arrow_map(docs.select(F.col(f"`{id_col}`"), valid), run, f"`{id_col}` {kind}, ids array<int>")


def decoded(tokens: DataFrame, ranks: str, pattern: str = PATTERN, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row a row of tokens: id, ids, decoded (binary): the bytes of the ids, which need not be UTF-8. Null ids count as none; an id
    without a rank is an error. Repeated rows give repeated rows; other columns are not carried."""
    kind = tokens.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        for batch in batches:
            for i in range(0, len(batch), 1024):
                some = batch.slice(i, 1024)
                back = [own.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else b"" for x in some.column(1)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(back, pa.binary())], [id_col, "ids", "decoded"])

    return arrow_map(tokens.select(F.col(f"`{id_col}`"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids")), run, f"`{id_col}` {kind}, ids array<int>, decoded binary")


def byte_bpe_digests(docs: DataFrame, ranks: str, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of docs: id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the decoded bytes)."""
    back = decoded(encoded(docs, ranks, pattern, id_col, text_col), ranks, pattern, id_col)
    told = F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary")
    return back.select(id_col, F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(told, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
