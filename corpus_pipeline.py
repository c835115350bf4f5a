"""A corpus pipeline of five operators: documents in, token files out. Part of the subpackage grainyard.llm.

Stages write Parquet between them. run() applies all of them to the table documents. Null and empty texts are documents like any
other: they have the classifier's prior score, are near-duplicates of each other, hold no benchmark item, and are written as one end id.
Extra columns go through all stages but the last, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainyard.llm import decontaminate, mixing, overlap, token_files, toxicity
from grainyard.llm.common import free_names, scratch_path, written
from grainyard.llm.queries import table, tokenizer

#: Bytes of text that a file of the mixed order is to have, and its rows at most.
PART_BYTES, PART_ROWS = 64 << 20, 1 << 20
#: Bytes of text that a task cuts into pieces at a time, less than op10: executors have run the other stages before.
SLICE_BYTES = 1 << 21


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.3. The model learns from labelled documents outside the held-out quarter."""
    model = toxicity.train_toxicity(toxicity.held_in(docs), table(spark, sf_dir, "labels"))
    score, predicted = free_names(docs, "score", "predicted")
    kept = toxicity.toxicity_scores(docs, model, score_col=score, predicted_col=predicted).where(F.col(predicted) == 0)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (SimHash candidates, Jaccard similarity of 5-word shingles 0.8 or more) one document: see
    overlap.representatives."""
    return overlap.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their rows in the mixed order of the sources: files follow each other in it, with as many rows each as have
    about PART_BYTES of text on average."""
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    each = max(1, min(PART_ROWS, rows * PART_BYTES // max(size, 1)))
    names = tuple(free_names(docs, "slot", "rank", "position"))
    mixed = mixing.mixed_sources(docs, names=names)
    dealt = mixed.repartitionById(rows // each + 1, F.floor(F.col(names[2]) / each).cast("int"))
    return dealt.sortWithinPartitions(names[2]).select(*[F.col(f"`{c}`") for c in docs.columns])


def row_order(docs: DataFrame, name: str) -> DataFrame:
    """docs, read from the files that a stage wrote, with a column `name` that rises in the order of the files' rows."""
    place = docs.metadataColumn("_metadata")
    part = F.regexp_extract(place["file_name"], r"^part-(\d+)", 1).cast("bigint")  # any other file's name is an error
    return docs.withColumn(name, F.shiftleft(part, 40) + place["row_index"])


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the documents in the order of their files' rows, read back: doc_id, start, n_tokens, ids_crc32."""
    order, at = free_names(docs, "order", "at")
    ordered = row_order(docs, order)
    path = scratch_path(spark, "tokens")
    token_files.write_token_files(ordered, path, tokenizer(), id_col=order, slice_bytes=SLICE_BYTES)
    found = token_files.read_token_files(spark, path).withColumnRenamed("doc_id", at)
    return found.join(ordered.select(order, "doc_id"), F.col(at) == F.col(order)).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [("toxicity", drop_toxic), ("near-duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("mixing", mix), ("token files", tokenize)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage on all that the one before it kept."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs


#: The classifier, the tokenizer and the codes can't be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None
