"""Structured Streaming forms of the corpus steps. Sinks and checkpoints are folders that all executors share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.filters import document_reason
from ..functions.text import sha1_hex, squash
from ..functions.names import free_names
from ..operators.ordering import in_order
from ..operators.packing import encode, full_windows, pieces, sft_tensors, sft_windows
from ..operators.splits import hash_split
from ..sources.work import deleted, forget, saved


def pretrain_documents(stream: DataFrame) -> DataFrame:
    """Rows that pass the filters, squashed, with their split. No state."""
    docs = stream.withColumn("text", squash(F.col("text")))
    return docs.where(document_reason(F.col("text")).isNull()).withColumn("split", hash_split(F.col("text")))


def first_seen(stream: DataFrame, text: str = "text", time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Rows whose squashed lower-case text hasn't come before. The state is a hash a distinct text, without bound; with a time column,
    only the hashes of rows that are no later than `delay` behind the latest: an older copy may come through again."""
    keyed = stream.withColumn("key", sha1_hex(F.lower(squash(F.col(text)))))
    return keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["key"]) if time else keyed.dropDuplicates(["key"])


def append_first(stream: DataFrame, path: str, text: str = "text", buckets: int = 256) -> None:
    """Appends, of all that has arrived, the rows whose squashed lower-case text (null: a text of its own) hasn't come before, and returns. Of
    copies in one batch any one is kept. No state store and no watermark: an old copy is dropped however late it comes, and no row is lost.
    See read_first.

    Keys are hashes in written tables. The table of batch i, counted from 1, holds the keys of the last so many batches as i's lowest set
    bit says, so that a batch reads as many tables as the number of batches has bits, and writes a key again as often at most. Of them it
    reads the buckets that its own keys fall into. A batch that is run again replaces its own folders; tables that a later one holds are
    deleted when the batch after that begins.
    """

    def table(i: int) -> str:
        return f"{path}/keys/table={i}"

    def before(i: int, down: int = 0) -> list[int]:
        out = []
        while i > down:
            out.append(i)
            i -= i & -i
        return out

    def keep(batch: DataFrame, n: int) -> None:
        spark, i = batch.sparkSession, n + 1
        for old in before(n - 1, n - (n & -n)) if n else []:
            deleted(spark, table(old))
        key, bucket, known = free_names(batch, "key", "bucket", "known")
        hashed = F.coalesce(sha1_hex(F.lower(squash(F.col(f"`{text}`")))), F.lit(""))
        new = saved(batch.withColumn(key, hashed).dropDuplicates([key]).withColumn(bucket, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")), "arrived")
        schema = "key string, bucket int"
        seen = {j: spark.read.schema(schema).parquet(table(j)) for j in before(n)}
        fresh = new
        if seen:
            touched = [r[0] for r in new.select(bucket).distinct().collect()]  # `buckets` numbers at most
            old = reduce(DataFrame.union, seen.values()).where(F.col("bucket").isin(touched))
            found = old.join(new.select(F.col(key).alias("k"), F.col(bucket).alias("b")), (F.col("b") == F.col("bucket")) & (F.col("k") == F.col("key")), "left_semi")
            fresh = new.join(found.select(F.col("key").alias(known)), F.col(key) == F.col(known), "left_anti")
        fresh = saved(fresh, "fresh")
        fresh.drop(key, bucket).write.mode("overwrite").parquet(f"{path}/rows/batch={n}")
        inner = [seen[j] for j in before(n, i - (i & -i))]
        keys = reduce(DataFrame.union, inner, fresh.select(F.col(key).alias("key"), F.col(bucket).alias("bucket")))
        keys.repartition("bucket", F.substring("key", 1, 1)).sortWithinPartitions("bucket", "key").write.mode("overwrite").partitionBy("bucket").parquet(table(i))
        forget(new)
        forget(fresh)

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def read_first(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """All rows, of the given schema, that append_first has kept below path."""
    return spark.read.schema(schema).parquet(*[f"{path}/rows/batch=*"])


def supervised_windows(examples: DataFrame, context: int) -> DataFrame:
    """Windows of arriving examples that fit: a row an example, no state."""
    return sft_windows(examples, context).where("status IN ('kept', 'truncated')")


def supervised_tensors(examples: DataFrame, vocab: DataFrame, context: int, pad: int) -> DataFrame:
    """id and the padded arrays of arriving examples that fit (see sft_tensors), by a vocabulary that doesn't change meanwhile: a row an
    example, no state."""
    p, t = free_names(examples, "p", "t")
    coded = encode(examples, "prompt_text", vocab).withColumnRenamed("ids", p)
    coded = encode(coded, "target_text", vocab).withColumnRenamed("ids", t)
    return sft_tensors(coded, p, t, context, pad, ["id"]).where("status IN ('kept', 'truncated')")


def packed_windows(stream: DataFrame, order: str, text: str, context: int, separator: str, path: str, ties: tuple[str, ...] = ()) -> None:
    """Packs all that has arrived into windows as lm_windows does with trailing separators, and returns: what a batch leaves of its last
    window, `context` characters at most, begins the next one's first. Batches follow each other as they arrive; inside one, rows
    follow `order`, then `ties`, and are packed by many tasks. See read_packed.

    Windows and what is left go to a folder a batch, so that a batch that is run again begins with what the one before left and
    replaces its own. A batch whose predecessor left nothing behind (other folder, other checkpoint) is an error.
    """
    state = "next bigint, rest string"

    def pack(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        begin, rest = tuple(spark.read.schema(state).parquet(f"{path}/left/batch={n - 1}").first()) if n else (0, "")
        rows = batch.select(*[F.col(f"`{c}`").alias(f"_o{i}") for i, c in enumerate((order, *ties))], F.concat(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(separator)).alias("_t"))
        placed = in_order(rows, ["_o0"], [f"_o{i + 1}" for i in range(len(ties))], "_o", F.length("_t"), "_end").select("_o", "_t", (F.col("_end") + len(rest)).alias("_end"))
        placed = placed.union(spark.createDataFrame([(0, rest, len(rest))], "_o bigint, _t string, _end bigint"))
        pieces(placed, context).write.mode("overwrite").parquet(f"{path}/pieces/batch={n}")
        made = spark.read.schema("window_id bigint, window string").parquet(f"{path}/pieces/batch={n}")
        full_windows(made, context, separator).select((F.col("window_id") + begin).alias("window_id"), "window").write.mode("overwrite").parquet(f"{path}/windows/batch={n}")
        left = made.where(F.length("window") <= context).orderBy("window_id").limit(1).collect()  # the last, unless the batch is empty
        told = (begin + left[0].window_id, left[0].window) if left else (begin, rest)
        spark.createDataFrame([told], state).coalesce(1).write.mode("overwrite").parquet(f"{path}/left/batch={n}")

    stream.writeStream.foreachBatch(pack).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """(window_id, window) of all batches that packed_windows has packed below path."""
    return spark.read.schema("window_id bigint, window string, batch bigint").parquet(f"{path}/windows").drop("batch")


def append_all(stream: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Appends all that has arrived to Parquet files below path, exactly once a row, and returns."""
    writer = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    (writer.partitionBy(*by) if by else writer).start().awaitTermination()


def running_counts(stream: DataFrame, by: list[str], path: str) -> None:
    """Counts of all rows so far by key, one folder a batch (batch=n); a batch that is run again replaces its own folder."""

    def save(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/counts/batch={n}")

    counts = stream.groupBy(*by).agg(F.count("*").alias("n"))
    counts.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def latest_counts(saved: DataFrame, by: list[str]) -> DataFrame:
    """Of each key the count of its last batch."""
    return saved.groupBy(*by).agg(F.max_by("n", "batch").alias("n"))
