"""Vocabularies, packing and mixing of training windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import free_names
from .ordering import in_order


def char_vocab(df: DataFrame, text: str) -> DataFrame:
    """All distinct characters and the line feed, in code-point order, numbered from 1. Each text's characters are made distinct first."""
    chars = df.select(F.explode(F.array_distinct(F.split(text, ""))).alias("token")).where("token <> ''").distinct()
    chars = chars.union(df.sparkSession.createDataFrame([("\n",)], "token string")).distinct()
    return chars.withColumn("token_id", F.row_number().over(Window.orderBy("token")))  # a row a character


def lm_windows(df: DataFrame, order: str, text: str, context: int, separator: str, bucket_rows: int = 0, trailing: bool = False, most: int | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """Windows of `context` characters over the texts put together in an order (see in_order) with a separator: window_id, window (one
    character more than the context, for targets shifted by one). Texts of one number in `order` follow each other by `ties`. A null
    text counts as empty. A rest that fills no window is dropped, and so is a window whose targets are all characters of the
    separator. `most`: the stream ends after so many characters; a shorter one is an error. bucket_rows: rows of in_order."""
    rows = df.select(*[F.col(f"`{c}`").alias(f"_o{i}") for i, c in enumerate((order, *ties))], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"))
    placed = in_order(rows, ["_o0"], [f"_o{i + 1}" for i in range(len(ties))], "_o", F.length("_t") + len(separator), "_end", bucket_rows).select("_o", "_t", "_end")
    if trailing:
        placed = placed.withColumn("_t", F.concat("_t", F.lit(separator)))
    else:
        last = placed.agg(F.max("_o")).first()[0] or 0
        placed = placed.withColumn("_t", F.when(F.col("_o") == last, F.col("_t")).otherwise(F.concat("_t", F.lit(separator))))
        placed = placed.withColumn("_end", F.when(F.col("_o") == last, F.col("_end") - len(separator)).otherwise(F.col("_end")))
    return full_windows(pieces(placed, context, most), context, separator)


def full_windows(windows: DataFrame, context: int, separator: str) -> DataFrame:
    """The windows of context + 1 characters whose targets aren't all characters of the separator."""
    full = windows.where(F.length("window") == context + 1)
    return full.where(F.ltrim(F.substring("window", 2, context), F.lit(separator)) != "") if separator else full


def pieces(placed: DataFrame, context: int, most: int | None = None) -> DataFrame:
    """(window_id, window), the last one shorter, of texts _t in the order of _o, which end at the character _end of a stream."""
    placed = placed.where(F.length("_t") > 0).withColumn("_at", F.col("_end") - F.length("_t"))
    if most is not None:
        if (placed.agg(F.max("_end")).first()[0] or 0) < most:
            raise ValueError(f"the stream is shorter than {most}")
        placed = placed.where(F.col("_at") < most).withColumn("_t", F.substring("_t", F.lit(1), F.least(F.length("_t"), most - F.col("_at")).cast("int")))
        placed = placed.withColumn("_end", F.col("_at") + F.length("_t"))
    first, final = F.greatest(F.floor((F.col("_at") - 1) / context), F.lit(0)), F.floor((F.col("_end") - 1) / context)
    parts = placed.select("_o", "_t", "_at", F.explode(F.sequence(first, final)).alias("window_id"))
    start = F.col("window_id") * context
    piece = F.substring("_t", (F.greatest(start - F.col("_at"), F.lit(0)) + 1).cast("int"), (F.least(F.col("_at") + F.length("_t"), start + context + 1) - F.greatest(F.col("_at"), start)).cast("int"))
    return parts.select("window_id", "_o", piece.alias("_p")).groupBy("window_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_o", "_p"))), lambda x: x["_p"]), "").alias("window"))


def sft_windows(examples: DataFrame, context: int) -> DataFrame:
    """Windows over characters of prompt and target. Columns: id, status, prompt_kept, loss_targets, window (context + 1 characters at most, to
    be shifted and padded). An example without prompt or target (empty or null) is `empty`, one whose target needs more than the
    context `too_long`; a prompt that doesn't fit keeps its last characters (`truncated`)."""
    room = F.lit(context + 1) - F.length("target_text")
    status = F.when((F.coalesce(F.length("prompt_text"), F.lit(0)) == 0) | (F.coalesce(F.length("target_text"), F.lit(0)) == 0), "empty").when(room <= 0, "too_long").when(F.length("prompt_text") > room, "truncated").otherwise("kept")
    used = F.when(room > 0, F.least(F.length("prompt_text"), room))
    window = F.concat(F.substring("prompt_text", F.length("prompt_text") - used + 1, used), "target_text")
    on = status.isin("truncated", "kept")
    return examples.select("id", status.alias("status"), F.when(on, used).alias("prompt_kept"), F.when(on, F.length("target_text")).alias("loss_targets"), F.when(on, window).alias("window"))


def mixture(df_counts: dict[str, int], parts: list[tuple[str, int]], slots: DataFrame) -> DataFrame:
    """slots (i) -> i, source, index: sources take turns in a cycle of their parts and start anew when they end."""
    cycle = sum(n for _, n in parts)
    at, out, index = 0, None, None
    k = F.pmod(F.col("i"), F.lit(cycle))
    for name, n in parts:
        here = (k >= at) & (k < at + n)
        nth = F.pmod(F.floor(F.col("i") / cycle) * n + k - at, F.lit(max(df_counts[name], 1)))
        out = F.when(here, name) if out is None else out.when(here, name)
        index = F.when(here, nth) if index is None else index.when(here, nth)
        at += n
    return slots.select("i", out.alias("source"), index.alias("index"))


def mixture_batches(parts: list[tuple[str, int]], batches: DataFrame, slots: DataFrame) -> DataFrame:
    """slots (i) -> i, source, index and all other columns of that batch, and `update`: how many batches with loss targets there were
    up to this one, null for a batch without any, which uses up its slot and does nothing else.

    batches: (source, index from 0, loss_targets, ...). Sources take turns in a cycle of their parts and start anew when they end;
    a source of the cycle without batches is an error."""
    told = {r["source"]: r["n"] for r in batches.groupBy("source").agg(F.count("*").alias("n")).where(F.col("source").isin([s for s, _ in parts])).collect()}
    if missing := [s for s, n in parts if n and not told.get(s)]:
        raise ValueError(f"no batches of {missing}")
    given = mixture({s: told.get(s, 0) for s, _ in parts}, [(s, n) for s, n in parts if n], slots)
    joined = given.join(batches, ["source", "index"])
    dead = free_names(joined, "dead")[0]
    ranked = in_order(joined.withColumn(dead, ~F.coalesce(F.col("loss_targets") > 0, F.lit(False))), [dead, "i"], (), "update")  # those with targets come first
    return ranked.withColumn("update", F.when(~F.col(dead), F.col("update"))).drop(dead)


def write_vocab(vocab: DataFrame, path: str) -> None:
    """A vocabulary as JSON lines of token and token_id, in the order of the ids; see checked_vocab."""
    checked_vocab(vocab).select("token", "token_id").orderBy("token_id").write.json(path)


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """A vocabulary that write_vocab wrote; a line that isn't JSON, and an entry that isn't one character, are errors."""
    return checked_vocab(spark.read.schema("token string, token_id int").option("mode", "FAILFAST").json(path))


def frequency_vocab(df: DataFrame, text: str, size: int, specials: list[str], least: int = 2, pattern: str = "[A-Za-z0-9']+") -> DataFrame:
    """(token, frequency, token_id): the special tokens first, with no frequency, then the most frequent pre-tokens, ties in code-point
    order, `size` entries in all; rarer ones than `least` stay out. Counts are summed before the shuffle."""
    counts = df.select(F.explode(F.regexp_extract_all(text, F.lit(pattern), 0)).alias("token")).groupBy("token").agg(F.count("*").alias("frequency"))
    top = counts.where((F.col("frequency") >= least) & ~F.col("token").isin(specials)).orderBy(F.desc("frequency"), "token").limit(max(size - len(specials), 0))
    numbered = top.withColumn("token_id", F.row_number().over(Window.orderBy(F.desc("frequency"), "token")) + len(specials))  # `size` rows at most
    fixed = df.sparkSession.createDataFrame([(t, None, i + 1) for i, t in enumerate(specials)], "token string, frequency bigint, token_id int")
    return fixed.unionByName(numbered)


def assistant_mask(tokens: DataFrame, doc: str, pos: str, token: str, assistant: Column, user: Column, end: Column) -> DataFrame:
    """tokens (a row a token) with `loss` 0 or 1: 1 inside assistant turns, without the markers that open and close turns; the end
    marker of a turn counts. The state is the last marker before, so that long texts are sorted and never held whole."""
    c = F.col(token)
    marker = F.when(c.eqNullSafe(assistant), "a").when(c.eqNullSafe(user), "u").when(c.eqNullSafe(end), "e")
    before = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    seen = tokens.withColumn("_m", marker).withColumn("_last", F.last("_m", ignorenulls=True).over(before))
    inside = (F.col("_last") == "a") & ~F.coalesce(F.col("_m").isin("a", "u"), F.lit(False))
    return seen.withColumn("loss", F.coalesce(inside, F.lit(False)).cast("int")).drop("_m", "_last")


def checked_vocab(vocab: DataFrame) -> DataFrame:
    """A vocabulary (token, token_id) of single characters, numbered from 1 without gaps; anything else is an error. Its size is
    bounded by the number of code points."""
    told = vocab.agg(F.count("*").alias("n"), F.max("token_id").alias("most"), F.count_distinct("token_id").alias("ids"), F.count_if(F.coalesce(F.length("token"), F.lit(0)) != 1).alias("bad")).first()
    if told.bad or told.n and not told.n == told.ids == told.most:
        raise ValueError("a vocabulary must have single characters, numbered from 1 without gaps")
    return vocab


def encode(df: DataFrame, text: str, vocab: DataFrame) -> DataFrame:
    """df with `ids`, the numbers of the text's characters by vocab (token, token_id); unknown ones are 1. The numbers are put into one
    array by code point, so that a character costs one look."""
    codes = checked_vocab(vocab).select(F.ascii("token").alias("code"), F.col("token_id").cast("int").alias("id"))
    last = codes.agg(F.max("code")).first()[0] or 0  # a code point
    dense = df.sparkSession.range(last + 1).toDF("at").join(codes, F.col("at") == F.col("code"), "left")
    table = dense.agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias("_vocab"))
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return df.crossJoin(F.broadcast(table)).withColumn("ids", F.transform(chars, lambda c: F.coalesce(F.get("_vocab", F.ascii(c)), F.lit(1)))).drop("_vocab")


def decode(df: DataFrame, ids: str, vocab: DataFrame) -> DataFrame:
    """df with `decoded`, the text of the ids; unknown ones are a question mark."""
    table = checked_vocab(vocab).agg(F.transform(F.sort_array(F.collect_list(F.struct("token_id", "token"))), lambda x: x["token"]).alias("_vocab"))
    return df.crossJoin(F.broadcast(table)).withColumn("decoded", F.array_join(F.transform(ids, lambda i: F.coalesce(F.get("_vocab", i - 1), F.lit("?"))), "")).drop("_vocab")


def batches(windows: DataFrame, window_id: str, size: int, ties: Sequence[str] = (), first: int = 0) -> DataFrame:
    """windows with batch_id: `size` in a row, in the order of a column (see in_order), whether or not numbers are missing or repeated; the
    last batch may be short. first: only so many batches, 0 or more than there are: all."""
    rank = free_names(windows, "rank")[0]
    ranked = in_order(windows, [window_id], ties, rank)
    ranked = ranked.where(F.col(rank) <= first * size) if first > 0 else ranked
    return ranked.withColumn("batch_id", F.floor((F.col(rank) - 1) / size)).drop(rank)


def lm_stats(windows: DataFrame, separator: str, texts: DataFrame, text: str, context: int, trailing: bool = False) -> DataFrame:
    """stream_length and candidate windows of the texts put together, and of the windows made of them how many there are and their loss
    targets (all but separators), one row; zeros for none."""
    target = F.expr("substring(window, 2)")
    live = F.length(F.replace(target, F.lit(separator), F.lit("")))
    kept = windows.agg(F.count("*").alias("windows"), F.coalesce(F.sum(live), F.lit(0)).alias("loss_targets"))
    between = F.count("*") if trailing else F.greatest(F.count("*") - 1, F.lit(0))
    length = texts.agg((F.coalesce(F.sum(F.length(text)), F.lit(0)) + between * len(separator)).alias("stream_length"))
    told = length.withColumn("candidates", F.greatest(F.floor((F.col("stream_length") - 1) / context), F.lit(0)))
    return told.crossJoin(F.broadcast(kept))  # one row each


def sft_tensors(rows: DataFrame, prompt_ids: str, target_ids: str, context: int, pad: int, keep: list[str]) -> DataFrame:
    """The columns `keep`, status, prompt_kept, loss_targets, input_ids, target_ids and loss_mask: arrays of `context` ints, the targets
    shifted by one, the pad id behind the end, the mask 1 where the target is one of the answer's.

    A row without prompt or target is `empty`, one whose target needs more than the context `too_long`, and has null arrays; a
    prompt that doesn't fit keeps its last ids (`truncated`)."""
    p, t = F.col(prompt_ids), F.col(target_ids)
    np_, nt = F.coalesce(F.size(p), F.lit(0)), F.coalesce(F.size(t), F.lit(0))
    room = F.lit(context + 1) - nt
    status = F.when((np_ < 1) | (nt < 1), "empty").when(room <= 0, "too_long").when(np_ > room, "truncated").otherwise("kept")
    used = F.least(np_, room)
    told = rows.select(*keep, status.alias("status"), F.when(status.isin("truncated", "kept"), F.struct(used.alias("used"), nt.alias("n"), F.concat(F.slice(p, np_ - used + 1, used), t).alias("full"))).alias("w"))
    n = F.size("w.full") - 1
    rest = F.lit(context) - n
    padded = lambda x: F.concat(x, F.array_repeat(F.lit(pad), rest))
    mask = F.concat(F.array_repeat(F.lit(0), F.col("w.used") - 1), F.array_repeat(F.lit(1), F.col("w.n")), F.array_repeat(F.lit(0), rest))
    return told.select(*keep, "status", F.col("w.used").alias("prompt_kept"), F.col("w.n").alias("loss_targets"), padded(F.slice("w.full", F.lit(1), n)).alias("input_ids"), padded(F.slice("w.full", F.lit(2), n)).alias("target_ids"), mask.alias("loss_mask"))


def sft_stats(windows: DataFrame, target_tokens: Column, batch: int) -> DataFrame:
    """One row over sft_windows: kept, batches, too_long, empty, truncated, loss_targets, mean_prompt and mean_target of the kept."""
    on = F.col("status").isin("kept", "truncated")
    kept = F.count_if(on)
    return windows.agg(
        kept.alias("kept"), F.ceil(kept / batch).alias("batches"), F.count_if(F.col("status") == "too_long").alias("too_long"), F.count_if(F.col("status") == "empty").alias("empty"),
        F.count_if(F.col("status") == "truncated").alias("truncated"), F.coalesce(F.sum("loss_targets"), F.lit(0)).alias("loss_targets"),
        F.coalesce(F.avg("prompt_kept"), F.lit(0.0)).alias("mean_prompt"), F.coalesce(F.avg(F.when(on, target_tokens)), F.lit(0.0)).alias("mean_target"),
    )


def prompt_prefixes(df: DataFrame, order: str, text: str, k: int, chars: int) -> DataFrame:
    """(order, prefix): the first `chars` characters of the first k texts that aren't blank: a sampling operator."""
    return df.where(F.col(text).rlike(r"(?U)\S")).orderBy(order).limit(k).select(order, F.substring(text, 1, chars).alias("prefix"))


def stream_stats(df: DataFrame, by: list[str], chars: Column, context: int) -> DataFrame:
    """Of the texts put together with separators of one token: lines, characters, length of the stream, windows and mean characters."""
    told = df.groupBy(*by).agg(F.count("*").alias("lines"), F.sum(chars).alias("characters"), F.avg(chars).alias("mean_characters"))
    told = told.withColumn("stream_length", F.col("characters") + F.col("lines") - 1)
    return told.withColumn("windows", F.greatest(F.floor((F.col("stream_length") - 1) / context), F.lit(0)))


def audit_sample(examples: DataFrame, id_col: str, n: int, seed: str) -> DataFrame:
    """n examples in the order of a seeded hash of their ids: a sampling operator."""
    return examples.orderBy(F.sha1(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")).cast("binary")), id_col).limit(n)


def vocabulary_sample(documents: DataFrame, order: str, text: str, chats: DataFrame, chat_order: str, chat_text: str, most: int) -> DataFrame:
    """(source, text): texts to learn a vocabulary from, three quarters of them documents and the rest chats, each first by its
    order; 0: all. A sampling operator."""
    first = max(1, round(most * 0.75)) if most else 0
    parts = []
    for name, df, by, column, n in (("pretrain", documents, order, text, first), ("sft", chats, chat_order, chat_text, max(1, most - first))):
        kept = df.orderBy(by).limit(n) if most else df
        parts.append(kept.select(F.lit(name).alias("source"), F.col(column).alias("text")))
    both = parts[0].unionByName(parts[1])
    return both if not most else both.orderBy("source").limit(most)
