"""Files in and out: texts, paragraphs, JSON lines, and the sinks of a split corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import CHAT_END, END_ASSISTANT, normalize_text, strip
from ..operators.ordering import prefix_sum
from .documents import read_documents
from .work import forget, saved, work_path  # noqa: F401

SFT_SCHEMA = "id string, prompt_text string, assistant_text string, target_text string, chat_text string"


def read_rows(spark: SparkSession, *paths: str) -> DataFrame:
    """(source_file, row): rows of .parquet, .jsonl, .jsonl.gz and .json files as JSON objects. Values that are no objects and blank lines
    are left out, a line that isn't JSON is an error. A .json file is one document: a list, an object with a list under one of
    documents.DOCUMENT_KEYS, or a row. Lines, and the elements of a document that is a list, are read by many tasks a file; another document,
    and a file under gzip, by one."""
    file, out = F.col("_metadata.file_name").alias("source_file"), None
    for path in paths:
        name = path.lower().rstrip("/")
        if name.endswith(".parquet"):
            df = spark.read.parquet(path)
            rows = df.select(file, F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("row"))
        elif name.endswith((".jsonl", ".jsonl.gz")):
            rows = spark.read.text(path).where(F.trim("value") != "").select(file, F.col("value").alias("row"))
        elif name.endswith(".json"):
            rows = read_documents(spark, path)
        else:
            raise ValueError(f"no known format of rows: {path}")
        out = rows if out is None else out.union(rows)
    return out.where(F.schema_of_variant(F.parse_json("row")).startswith("OBJECT"))


def read_metrics(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """Run records, one JSON object a file (or a line), with the given nested schema; a record that isn't JSON is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", multi_line).json(path)


def read_records(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(record) of run records of any shape as VARIANT, one JSON object a file (or a line); one that isn't JSON is an error."""
    return spark.read.option("singleVariantColumn", "record").option("mode", "FAILFAST").option("multiLine", multi_line).json(path)


def write_manifest(counts: DataFrame, path: str, arguments: dict[str, str]) -> None:
    """One JSON row: `counts`, a map of maps from rows (kind, key, n; a null key is empty), and the arguments. Counts are aggregates, a row a key."""
    key = F.coalesce(F.col("key").cast("string"), F.lit(""))
    maps = counts.groupBy("kind").agg(F.map_from_entries(F.collect_list(F.struct(key, "n"))).alias("of"))
    whole = maps.agg(F.map_from_entries(F.collect_list(F.struct("kind", "of"))).alias("counts"))
    told = F.create_map(*[F.lit(x) for pair in arguments.items() for x in pair]) if arguments else F.lit(None).cast("map<string,string>")
    whole.select("counts", told.alias("arguments")).coalesce(1).write.json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(kind, key, n) of a manifest."""
    rows = spark.read.schema("counts map<string,map<string,bigint>>").json(path)
    return rows.select(F.explode("counts").alias("kind", "of")).select("kind", F.explode("of").alias("key", "n"))


def read_texts(spark: SparkSession, *paths: str) -> DataFrame:
    """(text): the first string column of Parquet files, normalised, without nulls. Only that column is read."""
    df = spark.read.parquet(*paths)
    names = [f.name for f in df.schema if isinstance(f.dataType, StringType)]
    if not names:
        raise ValueError("no string column")
    return df.select(normalize_text(F.col(f"`{names[0]}`")).alias("text")).where(F.col("text").isNotNull())


def _some(df: DataFrame, path: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"nothing to read in {path}")
    return df


def _numbered(rows: DataFrame) -> DataFrame:
    """rows, each just read from text files, with `_n`: 1, 2, ... in the order of files and of the rows in each. Rows of one part of a
    file are read in order, so parts are counted first; a part is what one task reads."""
    place = rows.metadataColumn("_metadata")
    at = rows.withColumns({"_part": F.struct(place["file_path"].alias("file"), place["file_block_start"].alias("start")), "_k": F.monotonically_increasing_id()})
    return prefix_sum(at, F.col("_part"), ["_k"], F.lit(1), "_n").drop("_part", "_k")


def read_paragraphs(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """(source_file, text): parts of text files between blank lines, stripped, empty ones dropped. Files are split at double line
    feeds, so a large one is read by many tasks. limit: only the first so many, in the order of files (0: all). Nothing at all is an error."""
    pieces = spark.read.option("lineSep", "\n\n").text(path)
    pieces = pieces.withColumn("source_file", pieces.metadataColumn("_metadata")["file_name"])
    pieces = _numbered(pieces) if limit else pieces.withColumn("_n", F.lit(0))
    parts = pieces.select("source_file", "_n", F.posexplode(F.split("value", r"\n\s*\n", -1)).alias("_k", "text"))
    found = parts.withColumn("text", strip(F.col("text"))).where("text <> ''")
    if limit:
        found = found.orderBy("_n", "_k").limit(limit)
    return _some(found.select("source_file", "text"), path)


def read_jsonl_texts(spark: SparkSession, path: str) -> DataFrame:
    """(text) of JSON lines; a line that isn't JSON or has no text is an error, and so is no line at all."""
    lines = spark.read.schema("text string").option("mode", "FAILFAST").json(path)
    return _some(lines.select(F.coalesce("text", F.raise_error(F.lit("a line has no text")).cast("string")).alias("text")), path)


def read_sft(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """Supervised examples from JSON lines; a missing target is made from the answer, a missing chat text from prompt and target, a
    missing id from the example's number in the order of files and lines. limit: only the first so many (0: all). A line that isn't
    JSON, or has no prompt or no answer, is an error, and so is no line at all."""
    rows = _numbered(spark.read.schema(SFT_SCHEMA).option("mode", "FAILFAST").json(path))
    if limit:
        rows = rows.where(F.col("_n") <= limit)
    told = [F.coalesce(c, F.raise_error(F.lit(f"an example has no {c}")).cast("string")).alias(c) for c in ("prompt_text", "assistant_text")]
    rows = rows.select(F.coalesce("id", F.concat(F.lit("example_"), F.col("_n").cast("string"))).alias("id"), *told, "target_text", "chat_text")
    rows = rows.withColumn("target_text", F.coalesce("target_text", F.concat(F.lit(" "), "assistant_text", F.lit(f"\n{END_ASSISTANT}\n{CHAT_END}"))))
    return _some(rows.withColumn("chat_text", F.coalesce("chat_text", F.concat("prompt_text", "target_text"))), path)


def source_label(path: Column, prefix: str = "") -> Column:
    """A file's stem as a label: lower case, other characters than letters and digits as underscores, 80 characters at most."""
    stem = F.regexp_replace(F.regexp_replace(path, "^.*/", ""), r"(?<=.)\.[^.]*$", "")
    label = F.lower(F.regexp_replace(F.regexp_replace(stem, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))
    return F.substring(F.concat(F.lit(f"{prefix}_" if prefix else ""), label), 1, 80)


def write_pretrain(docs: DataFrame, path: str, text: str = "text", split: str = "split") -> None:
    """A folder a split of text files, documents stripped and a blank line between them."""
    docs.select(split, strip(F.col(text)).alias("value")).write.partitionBy(split).option("lineSep", "\n\n").text(path)


def write_pretrain_counted(docs: DataFrame, path: str, reasons: Sequence[str], text: str = "text", split: str = "split", reason: str = "reason", splits: Sequence[str] = ("training", "validation", "testing")) -> dict[str, int]:
    """write_pretrain of the rows whose reason is null, with counts of all rows from the same pass: seen, kept, characters (two more a
    document, as between documents), each of `reasons` as rejected_<reason>, each of `splits` as <split>_documents.

    Counts are observed by the tasks that write: nothing between counting and writing deals rows out, so that a task that runs again after
    a loss counts once. A null text counts as a rejected row, without a reason of its own; a reason or split that isn't listed counts in seen
    only (and, the latter, in kept). Empty: zeros. Other columns aren't carried.
    """
    ok = F.col(reason).isNull() & F.col(text).isNotNull()
    asked = {"seen": F.count(F.lit(1)), "kept": F.count_if(ok), "characters": F.coalesce(F.sum(F.when(ok, F.length(text) + 2)), F.lit(0))}
    asked |= {f"rejected_{r}": F.count_if(F.col(reason) == r) for r in reasons} | {f"{s}_documents": F.count_if(ok & (F.col(split) == s)) for s in splits}
    seen = Observation()
    write_pretrain(docs.observe(seen, *[c.alias(n) for n, c in asked.items()]).where(ok), path, text, split)
    return {n: int(seen.get[n]) for n in asked}


def write_sft(examples: DataFrame, path: str, split: str = "split") -> None:
    """JSON lines of all fields in path/examples and text files of the chat texts in path/chats, a folder a split."""
    examples.write.partitionBy(split).json(f"{path}/examples")
    write_pretrain(examples, f"{path}/chats", "chat_text", split)


def split_sizes(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """(split, documents, bytes, characters) of a folder that write_pretrain wrote; a required split that isn't there is an error."""
    docs = spark.read.option("lineSep", "\n\n").text(path).where("value <> ''")
    found = saved(docs.groupBy("split").agg(F.count("*").alias("documents"), F.sum(F.octet_length("value")).alias("bytes"), F.sum(F.length("value")).alias("characters")), "sizes")
    if missing := set(required) - {r.split for r in found.where(F.col("split").isin(*required)).collect()}:
        raise ValueError(f"no documents of {sorted(missing)} in {path}")
    return found
