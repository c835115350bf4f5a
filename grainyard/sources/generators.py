"""One text to many paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_text, squash, strip, ws_word_count


def paragraphs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, para, text): parts between blank lines, white space squashed, empty ones dropped."""
    parts = F.posexplode(F.split(normalize_text(F.col(text_col)), r"\n\s*\n", -1)).alias("para", "text")
    return df.select(id_col, parts).withColumn("text", squash(F.col("text"))).where("text <> ''")


def markdown_paragraphs(lines: DataFrame, id_col: str, min_words: int = 5) -> DataFrame:
    """(id, i, line) -> (id, island, paragraph): fenced blocks left out without ending a paragraph, heading and list marks, links and
    backticks taken off, blank and badge lines between paragraphs."""
    order = Window.partitionBy(id_col).orderBy("i")
    fence = strip(F.col("line")).startswith("```")
    outside = lines.withColumn("_fence", fence).withColumn("_n", F.sum(F.col("_fence").cast("int")).over(order)).where(~F.col("_fence") & (F.col("_n") % 2 == 0))
    s = F.regexp_replace(F.regexp_replace(strip(F.col("line")), r"^#{1,6}\s*", ""), r"^([-*+]|\d+\.)\s+", "")
    s = F.when(s.startswith("[!["), "").otherwise(strip(F.replace(F.regexp_replace(s, r"\[([^\]]*)\]\([^)]*\)", "$1"), F.lit("`"), F.lit(""))))
    islands = outside.withColumn("_s", s).withColumn("island", F.sum((F.col("_s") == "").cast("int")).over(order)).where("_s <> ''")
    joined = islands.groupBy(id_col, "island").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "_s"))), lambda x: x["_s"]), " ").alias("paragraph"))
    return joined.where(ws_word_count(F.col("paragraph")) >= min_words)


def docstring_paragraphs(df: DataFrame, id_col: str, code_col: str, min_words: int = 5) -> DataFrame:
    """(id, block, paragraph): text between triple quotes, by blank lines, without those that begin as comments or fences."""
    blocks = df.select(id_col, F.posexplode(F.regexp_extract_all(code_col, F.lit('(?s)"""(.*?)"""'), 1)).alias("block", "_b"))
    parts = blocks.select(id_col, "block", F.explode(F.split("_b", r"\n\s*\n", -1)).alias("_p"))
    kept = parts.where(~F.col("_p").startswith("#") & ~F.col("_p").startswith("```") & (ws_word_count(F.col("_p")) >= min_words))
    return kept.select(id_col, "block", squash(F.replace("_p", F.lit("`"), F.lit(""))).alias("paragraph"))
