"""Conversations: cleaning, merging runs of a role, and supervised examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.filters import ASSISTANT, USER, TextLimits, text_reason
from ..functions.text import CHAT_END, END_ASSISTANT, is_english, normalize_role, normalize_turn, prompt_category, sha1_hex, word_count


def merge_runs(turns: DataFrame) -> DataFrame:
    """(row_id, pos, role, content) -> (row_id, i, role, content): system, unknown and empty messages dropped, then runs of a role
    joined. Kept: conversations of two raw and two merged messages at least that begin with a user and hold an assistant."""
    conv = Window.partitionBy("row_id")
    raw = turns.withColumn("_raw", F.count("*").over(conv)).where("_raw >= 2")
    kept = raw.select("row_id", "pos", normalize_role(F.col("role")).alias("role"), normalize_turn(F.col("content")).alias("content")).where("role IN ('user', 'assistant') AND content <> ''")
    order = conv.orderBy("pos")
    new = F.when(F.lag("role").over(order).eqNullSafe(F.col("role")), 0).otherwise(1)
    runs = kept.withColumn("_new", new).withColumn("i", F.sum("_new").over(order))
    merged = runs.groupBy("row_id", "i", "role").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"]), "\n").alias("content"))
    checked = merged.withColumns({"_n": F.count("*").over(conv), "_first": F.min_by("role", "i").over(conv), "_some": F.max(F.col("role") == "assistant").over(conv)})
    return checked.where("_n >= 2 AND _first = 'user' AND _some").select("row_id", "i", "role", "content")


def build_examples(messages: DataFrame, source_group: str, source_ref: str, max_index: int = 1, user: TextLimits = USER, assistant: TextLimits = ASSISTANT, max_prompt_chars: int = 1400) -> DataFrame:
    """An example for each assistant message up to max_index (0: all) of which it and all messages before are usable. Only messages
    whose earlier ones fit the prompt's length are kept, before any prompt is put together."""
    is_user = F.col("role") == "user"
    order = Window.partitionBy("row_id").orderBy("i")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    ok = F.when(is_user, text_reason(F.col("content"), user, True)).otherwise(text_reason(F.col("content"), assistant, False)).isNull()
    segment = F.when(is_user, F.concat(F.lit("User: "), "content")).otherwise(F.concat(F.lit("Assistant: "), "content", F.lit(f"\n{END_ASSISTANT}\n{CHAT_END}")))
    seen = messages.withColumns({"_ok": ok, "_seg": segment})
    seen = seen.withColumns({"_all": F.min("_ok").over(order), "_turn": F.sum((~is_user).cast("int")).over(order), "_chars": F.coalesce(F.sum(F.length("_seg") + 1).over(earlier), F.lit(0)) + 10, "_user": F.lag("content").over(order)})
    fits = seen.where(F.col("_all") & (F.col("_chars") <= max_prompt_chars))
    told = fits.withColumn("_said", F.collect_list("_seg").over(earlier)).where(~is_user & F.col("_user").isNotNull())
    if max_index:
        told = told.where(F.col("_turn") <= max_index)
    prompt = F.concat(F.array_join("_said", "\n"), F.lit("\nAssistant:"))
    target = F.concat(F.lit(" "), "content", F.lit(f"\n{END_ASSISTANT}\n{CHAT_END}"))
    told = told.withColumns({"prompt_text": prompt, "target_text": target}).withColumn("chat_text", F.concat("prompt_text", "target_text"))
    row = F.col("row_id").cast("string")
    ident = F.concat(F.lit(f"real_chat_{source_group}_"), F.substring(sha1_hex(F.concat_ws(":", row, F.col("_turn").cast("string"), "chat_text")), 1, 24))
    return told.select(
        ident.alias("id"), F.concat(F.lit(f"{source_group}_"), row).alias("dialogue_group"), F.lit(source_group).alias("source_group"), F.lit(source_ref).alias("source_ref"),
        prompt_category(F.col("_user"), F.col("content")).alias("category"), "prompt_text", F.col("content").alias("assistant_text"), "target_text", "chat_text",
        word_count(F.col("prompt_text")).alias("prompt_words"), word_count(F.col("content")).alias("assistant_words"),
    )


def plain_prompts(messages: DataFrame, system: str = "") -> DataFrame:
    """(row_id, prompt): an optional system line, a line a message with its role, and the assistant's turn to come."""
    label = F.when(F.col("role") == "user", "User").when(F.col("role") == "assistant", "Assistant").otherwise(F.raise_error(F.lit("unsupported chat role")).cast("string"))
    line = F.concat(label, F.lit(": "), "content", F.lit("\n"))
    said = messages.groupBy("row_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", line.alias("line")))), lambda x: x["line"]), "").alias("lines"))
    return said.select("row_id", F.concat(F.lit(f"System: {system}\n" if system else ""), "lines", F.lit("Assistant: ")).alias("prompt"))


def row_id(*ids: Column, index: Column) -> Column:
    """The first id that is neither null, empty nor zero, as text; else the row's index."""
    told = [F.when(~c.cast("string").isin("", "0", "0.0"), c.cast("string")) for c in ids]
    return F.coalesce(*told, index.cast("string"))


def import_funnel(rows: DataFrame, messages: DataFrame, examples: DataFrame, source: str, languages: list[str]) -> DataFrame:
    """Of each source: rows_seen, non_english_rows, rows_without_messages, rows_filtered, rows_kept, examples_kept.

    rows: (row_id, source, languages); messages: (row_id, ...), merged, of any of the rows; examples: (row_id), a row an example. Each
    row counts once, at the first step that it fails. Messages and examples are counted by row before they are joined.
    """
    english = is_english(*[F.col(c) for c in languages])
    talks = messages.select("row_id").distinct().withColumn("_talk", F.lit(True))
    kept = examples.groupBy("row_id").agg(F.count("*").alias("_n"))
    told = rows.select("row_id", source, english.alias("_en")).join(talks, "row_id", "left").join(kept, "row_id", "left")
    talk = F.col("_talk").isNotNull()
    return told.groupBy(source).agg(
        F.count("*").alias("rows_seen"), F.count_if(~F.col("_en")).alias("non_english_rows"), F.count_if(F.col("_en") & ~talk).alias("rows_without_messages"),
        F.count_if(F.col("_en") & talk & F.col("_n").isNull()).alias("rows_filtered"), F.count_if(F.col("_en") & talk & F.col("_n").isNotNull()).alias("rows_kept"),
        F.coalesce(F.sum(F.when(F.col("_en") & talk, F.col("_n"))), F.lit(0)).alias("examples_kept"),
    )
