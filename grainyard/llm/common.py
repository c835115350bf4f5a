"""What the operators share: scratch tables, Arrow maps and vectorised word scanning."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Separators of words: space and the bytes 9 to 13.
WORD_SPLIT = "[ \\t\\n\\x0B\\f\\r]+"

_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; a temporary one where it is unset and Spark runs in one local JVM."""
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _roots:
        _roots[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-grainyard-")
    return _roots[sc.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/grainyard-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written to the shared folder and read again: its lineage is cut and lost executors don't matter."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    _places[back] = path
    return back


def broadcast_if_small(df: DataFrame, row_bytes: int = 64, most: int = 64 << 20) -> DataFrame:
    """df, a written table, marked to be broadcast if its counted rows have at most `most` bytes; else Spark joins by shuffles."""
    return F.broadcast(df) if df.count() * row_bytes <= most else df


_places: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def forget(df: DataFrame) -> None:
    """Delete what `written` wrote for df. Nothing that is still to be read may depend on it."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(_places.pop(df))
    path.getFileSystem(conf).delete(path, True)


_kept: dict[Any, Any] = {}


def kept(key: Any, make: Callable[[], Any]) -> Any:
    """The one thing that this worker keeps from task to task, made if it isn't there. It goes when another is asked for, and when a
    task of an `arrow_map` comes that doesn't keep."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def drop_kept() -> None:
    _kept.clear()


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, keeps: bool = False) -> DataFrame:
    """mapInArrow, with this repository on the workers' path. keeps: fn calls `kept`. A worker outlives its task and serves other
    stages, so what those left behind and what Arrow held for a task is given back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            drop_kept()
        yield from fn(batches)
        pa.default_memory_pool().release_unused()

    env, root = df.sparkSession.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH", "")]))
    return df.mapInArrow(run, schema)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until df has no such column."""
    lead = "_"
    while any(f"{lead}{n}".lower() in map(str.lower, df.columns) for n in names):
        lead += "_"
    return [lead + n for n in names]


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, one after the other, and the offsets of its rows. Null: empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: int, most: int = 1 << 21, most_rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of most_rows rows at most with about `most` bytes of text; a longer text is alone."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
    first, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > first and (total + n > most or i - first >= most_rows):
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += n
    if len(sizes) > first:
        yield batch.slice(first)


def byte_table(separators: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each byte, its lower-case form (A-Z only) and whether it separates words."""
    lower, sep = np.arange(256, dtype=np.uint8), np.zeros(256, bool)
    lower[65:91] += 32
    sep[list(separators)] = True
    return lower, sep


SPACES = byte_table(b" \t\n\x0b\x0c\r")
#: Words as runs of ASCII letters and digits and of all other characters.
PLAIN = byte_table(bytes(b for b in range(128) if not chr(b).isalnum()))


def word_spans(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row (and one more) the index of its first word. Words end with their row."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~sep[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(lowered: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XXH64 of each span of bytes; spans ascend and don't overlap. Equal spans are hashed once."""
    edges = np.zeros(2 * len(starts) + 2, np.int64)
    edges[1:-1:2], edges[2:-1:2], edges[-1] = starts, ends, len(lowered)
    turns = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(lowered))]).dictionary_encode()  # spans, and what is between them
    return np.array([xxhash.xxh64_intdigest(x) for x in turns.dictionary.to_pylist()], np.uint64)[turns.indices.to_numpy()[1::2]]


def ngram_hashes(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words inside each row, and each one's row. first: where rows' words begin, as from word_spans."""
    count = max(0, len(words) - n + 1)
    h = np.zeros(count, np.uint64)
    for k in range(n):
        h = mixed(h + words[k : k + count] * np.uint64(2 * k + 3))
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    keep = row[:count] == row[n - 1 : n - 1 + count]
    return h[keep], row[:count][keep]


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)
