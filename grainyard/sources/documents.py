"""JSON documents read by many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import prefix_sum
from .work import saved

# Keys under which a JSON document may hold its rows.
DOCUMENT_KEYS = ["data", "rows", "examples"]


def _list(c: Column) -> Column:
    """array<string> of the objects in a JSON list, null if it isn't one."""
    kinds = F.transform(F.variant_get(F.try_parse_json(c), "$", "array<variant>"), F.schema_of_variant)
    pairs = F.arrays_zip(F.from_json(c, "array<string>").alias("row"), kinds.alias("kind"))
    objects = F.transform(F.filter(pairs, lambda p: p["kind"].startswith("OBJECT")), lambda p: p["row"])
    return F.when(F.try_parse_json(c).isNotNull() & c.rlike(r"^\s*\["), objects)


def _told(c: Column) -> Column:
    return F.coalesce(c, F.raise_error(F.lit("a document isn't JSON")).cast("array<string>"))


def document_rows(c: Column) -> Column:
    """array<string> of the rows of a JSON document that is no list; an error if it isn't JSON."""
    kind = lambda key: F.schema_of_variant(F.try_variant_get(F.try_parse_json(c), f"$.{key}", "variant"))
    under = [F.when(kind(key).startswith("ARRAY"), _list(F.get_json_object(c, f"$.{key}"))) for key in DOCUMENT_KEYS]
    return F.coalesce(*under, _told(F.when(F.try_parse_json(c).isNotNull(), F.array(c))))


def _net(c: Column) -> Column:
    """Brackets that open less those that close, outside of strings."""
    plain = F.regexp_replace(c, r'"[^"]*("|\z)', "")
    return F.length(F.regexp_replace(plain, r"[^\[{]", "")) - F.length(F.regexp_replace(plain, r"[^\]}]", ""))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, row) of .json files, each one document: a list, an object with a list under one of DOCUMENT_KEYS, or a row.

    A list is read by many tasks: files are split at closing braces, as lines are at line feeds; counts of quotation marks up to a piece
    tell whether it begins inside a string, sums of brackets how deep it ends, and pieces that end at depth one close an element. Only the
    pieces of one element meet, with what stands between it and the one before. A document that is no list is put together in one task.
    A document that isn't JSON is an error; a file without a character has no rows.
    """
    raw = spark.read.option("lineSep", "}").text(path)
    at = raw.metadataColumn("_metadata")
    bare = F.regexp_replace("value", r"(?s)\\.", "")  # a backslash before a closing brace isn't JSON, so no escape crosses a border
    pieces = raw.select(
        at["file_path"].alias("file"), at["file_name"].alias("source_file"), F.struct(at["file_path"].alias("file"), at["file_block_start"].alias("start")).alias("part"),
        at["file_size"].alias("size"), F.monotonically_increasing_id().alias("k"), "value", F.regexp_count(bare, F.lit('"')).alias("quotes"), _net(bare).alias("out"), _net(F.concat(F.lit('"'), bare)).alias("inside"),
    )
    pieces = saved(pieces, "pieces")
    marked = prefix_sum(pieces, F.col("part"), ["k"], F.col("quotes"), "upto")
    odd, even = (F.col("upto") - F.col("quotes")) % 2 == 1, F.col("upto") % 2 == 0
    change = F.when(odd, F.col("inside")).otherwise(F.col("out")) - even.cast("int")
    deep = saved(prefix_sum(marked.select("file", "source_file", "size", "part", "k", "value", even.alias("free"), change.alias("change")), F.col("part"), ["k"], F.col("change"), "depth"), "depth")
    place = F.struct(F.col("part.start"), F.col("k"))
    files = deep.groupBy("file").agg(
        F.min_by(F.col("depth") - F.col("change"), place).alias("base"), F.min_by(F.col("value").rlike(r"^\s*\["), place).alias("listed"), F.max(place).alias("last"), F.max_by("depth", place).alias("end"),
        F.max_by("free", place).alias("whole"), (F.max("size") - F.sum(F.octet_length("value")) - F.count("*")).alias("over"),
    )
    closed = F.col("over").isin(0, 3)  # every piece counts a brace behind it; that of the last is there if the file has its byte (3: of a byte order mark)
    ends = F.col("end") - F.col("base") == F.when(closed, 0).otherwise(-1)
    told = files.select(F.col("file").alias("f"), "base", "listed", "last", closed.alias("closed"), (F.col("whole") & ends & ~(F.col("listed") & closed)).alias("whole"))
    rows = deep.join(told, F.col("file") == F.col("f"))
    closes = F.col("listed") & F.col("free") & (F.col("depth") - F.col("base") == 1) & (place != F.col("last"))
    rows = rows.select("file", "source_file", "part", "k", "value", "listed", "closed", "whole", closes.alias("closes"), (place == F.col("last")).alias("is_last"))
    rows = prefix_sum(rows, F.col("part"), ["k"], F.col("closes").cast("int"), "n").withColumn("n", F.col("n") - F.col("closes").cast("int"))
    own = rows.groupBy("file", "n").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("part.start").alias("s"), "k", "value"))), lambda p: p["value"]), "}").alias("text"),
        F.first("source_file").alias("source_file"), F.first("listed").alias("listed"), F.first("closed").alias("closed"), F.first("whole").alias("whole"), F.bool_or("is_last").alias("is_last"),
    )
    starts = rows.groupBy("file").agg(F.min("n").alias("n0"))
    own = own.join(starts, "file").withColumn("head", F.col("n") == F.col("n0"))
    brace = lambda c: F.when(c, "}").otherwise("")
    element = F.concat(F.when(F.col("head"), "").otherwise("[0"), "text", brace(~F.col("is_last")), F.when(F.col("is_last"), "").otherwise("]"))
    listed = F.when(F.col("listed"), _told(_list(element))).otherwise(document_rows(F.concat("text", brace(F.col("closed")))))
    return own.select("source_file", F.explode(F.when(F.col("whole"), listed).otherwise(_told(F.lit(None).cast("array<string>")))).alias("row"))
