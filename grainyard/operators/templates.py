"""Supervised examples from templates and tables of what fills them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.filters import direct_reason
from ..functions.text import CHAT_END, END_ASSISTANT, sha1_hex, squash, word_count
from ..sources.work import forget, saved
from .ordering import in_order
from .splits import first_by


def filled(template: Column, values: Column) -> Column:
    """The template with each {name} replaced by the map's value of that name."""
    return F.aggregate(F.map_entries(values), template, lambda t, e: F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))


def candidates(index: DataFrame, i: str, weights: dict[str, int], forms: DataFrame, slots: DataFrame) -> DataFrame:
    """(_i, category, prompt_text, assistant_text, target_text, chat_text, reason) for the numbers in column i; reason: why it is no
    direct answer, null if it is one.

    weights: places of each category in a cycle; a number's place tells its category, and how often that came before is its variation.
    forms: (category, form, prompt, answer), numbered from 0; slots: (category, slot, values), values a map of what fills a form.
    Variation v takes slot v mod slots, and form v div slots mod forms. Slots are joined by category and number, so that their
    table may be large; forms are a small table.
    """
    cycle, at, category, nth = sum(weights.values()), 0, None, None
    place = F.pmod(F.col(i), F.lit(cycle))
    for name, n in weights.items():
        here = (place >= at) & (place < at + n)
        v = F.floor(F.col(i) / cycle) * n + place - at
        category = F.when(here, name) if category is None else category.when(here, name)
        nth = F.when(here, v) if nth is None else nth.when(here, v)
        at += n
    return filled_forms(index.select(F.col(i).alias("_i"), category.alias("category"), nth.alias("_v")), forms, slots)


def shuffled(spark: SparkSession, n: int, weights: dict[str, int], block: int = 97, seed: str = "0") -> DataFrame:
    """(_i, category, _v) of the numbers 0 to n - 1: a cycle of the weights' places in which number i takes place i mod places, and whose
    places are put in a new order for each `block` numbers: by the SHA-1 of `seed:block:place`. _v: how often the category came before.

    Orders come from the block's number alone, so that tasks make their blocks by themselves and again after a loss. What came
    before a block are sums by category over the blocks, a row a category and block.
    """
    places = [name for name, k in weights.items() for _ in range(k)]
    b, size = F.col("_b"), F.lit(len(places))
    keyed = F.transform(F.sequence(F.lit(0), size - 1), lambda s: F.struct(sha1_hex(F.concat_ws(":", F.lit(seed), b, s)).alias("key"), s.alias("at")))
    order = F.transform(F.array_sort(keyed), lambda k: F.get(F.array(*map(F.lit, places)), k["at"]))
    blocks = spark.range(-(-n // block)).select(F.col("id").alias("_b")).withColumn("_order", order)
    told = F.transform(F.sequence(F.lit(0), F.lit(block - 1)), lambda k: F.get("_order", F.pmod(b * block + k, size).cast("int")))
    each = blocks.select("_b", F.posexplode(told).alias("_k", "category")).where(b * block + F.col("_k") < n)
    sums = in_order(each.groupBy("category", "_b").agg(F.count("*").alias("_n")), ["category", "_b"], name="_rank", value=F.col("_n"), running="_upto")
    first = sums.groupBy("category").agg(F.min(F.col("_upto") - F.col("_n")).alias("_first"))  # a row a category
    before = sums.join(F.broadcast(first), "category").select("category", "_b", (F.col("_upto") - F.col("_n") - F.col("_first")).alias("_before"))
    own = each.withColumn("_own", F.row_number().over(Window.partitionBy("category", "_b").orderBy("_k")))
    return own.join(before, ["category", "_b"]).select((b * block + F.col("_k")).alias("_i"), "category", (F.col("_before") + F.col("_own") - 1).alias("_v"))


def until_count(spark: SparkSession, count: int, weights: dict[str, int], forms: DataFrame, slots: DataFrame, block: int = 97, seed: str = "0", most: int = 0) -> DataFrame:
    """Candidates (see candidates) of the numbers of a shuffled cycle, up to the one that gives the count-th example: without a reason, and
    the first of its chat. template_examples makes `count` examples of them, counts their counters. A written table.

    Numbers are tried in rounds of twice as many until they suffice; if `most` (0: twenty times the count, 10,000 at least) don't, it is an
    error. A count of 0 gives no candidates.
    """
    most, tried = most or max(20 * count, 10_000), max(2 * count, block)
    while True:
        tried = min(tried, most)
        found = saved(filled_forms(shuffled(spark, tried, weights, block, seed), forms, slots), "candidates")
        if not count:
            return found.limit(0)
        kept = in_order(first_by(found.where("reason IS NULL").select("_i", "chat_text"), F.lower(squash(F.col("chat_text"))), "_i").select("_i"), ["_i"], name="_nth")
        last = kept.where(F.col("_nth") == count).first()
        if last:
            return found.where(F.col("_i") <= last["_i"])
        if tried == most:
            raise ValueError(f"{most} attempts give {kept.count()} examples, not {count}")
        forget(found)
        tried *= 2


def filled_forms(numbers: DataFrame, forms: DataFrame, slots: DataFrame) -> DataFrame:
    """candidates of numbers (_i, category, _v), _v the variation."""
    sizes = slots.groupBy("category").agg(F.count("*").alias("_slots")).join(forms.groupBy("category").agg(F.count("*").alias("_forms")), "category")
    numbered = numbers.join(F.broadcast(sizes), "category")  # a row a category
    placed = numbered.withColumns({"slot": F.pmod("_v", "_slots"), "form": F.pmod(F.floor(F.col("_v") / F.col("_slots")), F.col("_forms"))})
    full = placed.join(slots, ["category", "slot"]).join(forms, ["category", "form"])
    prompt = F.concat(F.lit("User: "), filled(F.col("prompt"), F.col("values")), F.lit("\nAssistant:"))
    told = full.select("_i", "category", prompt.alias("prompt_text"), filled(F.col("answer"), F.col("values")).alias("assistant_text"))
    told = told.withColumn("target_text", F.concat(F.lit(" "), "assistant_text", F.lit(f"\n{END_ASSISTANT}\n{CHAT_END}"))).withColumn("chat_text", F.concat("prompt_text", "target_text"))
    return told.withColumn("reason", direct_reason(F.col("prompt_text"), F.col("assistant_text")))


def counts(found: DataFrame) -> DataFrame:
    """(category, kept, rejected, repeated) of candidates; category null: of all."""
    good = F.col("reason").isNull()
    chat = F.when(good, F.sha2(F.lower(squash(F.col("chat_text"))).cast("binary"), 256))
    each = found.groupBy("category", chat.alias("_chat")).agg(F.count("*").alias("_n"))
    once = F.col("_chat").isNotNull()
    return each.groupingSets([[F.col("category")], []], F.col("category")).agg(
        F.count_if(once).alias("kept"), F.coalesce(F.sum(F.when(~once, F.col("_n"))), F.lit(0)).alias("rejected"), F.coalesce(F.sum(F.when(once, F.col("_n") - 1)), F.lit(0)).alias("repeated")
    )


def template_examples(found: DataFrame, source_group: str, source_ref: str) -> DataFrame:
    """Examples of candidates: those without a reason, of repeated chats the first by number."""
    once = first_by(found.where("reason IS NULL").drop("reason"), F.lower(squash(F.col("chat_text"))), "_i").drop("copies")
    ident = F.concat(F.lit(f"{source_group}_"), "category", F.lit("_"), F.substring(sha1_hex(F.col("chat_text")), 1, 24), F.lit("_"), F.col("_i").cast("string"))
    return once.select(
        ident.alias("id"), ident.alias("dialogue_group"), F.lit(source_group).alias("source_group"), F.lit(source_ref).alias("source_ref"), "category", "prompt_text", "assistant_text",
        "target_text", "chat_text", word_count(F.col("prompt_text")).alias("prompt_words"), word_count(F.col("assistant_text")).alias("assistant_words"),
    )
