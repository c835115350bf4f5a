"""Trees of messages: what is put together only as far as examples reach equals whole chains."""

import random

from pyspark.sql import functions as F

from grainyard.functions.filters import TextLimits
from grainyard.operators import extract, messages

LIMITS = TextLimits(1, 50, 30, 9)
SCHEMA = "message_id string, parent_id string, role string, text string, lang string, n int"


def build(talks):
    return messages.build_examples(talks, "t", "t", 0, LIMITS, LIMITS, 120)


def imported(df, reach):
    found, counts = extract.tree_import(df, "n", ["lang"], "t", build, reach=reach)
    return sorted((r.id, r.dialogue_group, r.prompt_text, r.target_text) for r in found.collect()), counts.first()


def test_reach_changes_nothing(spark):
    rng = random.Random(12)
    rows = []
    for i in range(400):
        parent = None if i < 6 or rng.random() < 0.05 else str(rng.randrange(max(0, i - 8), i))
        role = rng.choice(["user", "user", "assistant", "assistant", "system", None, "bot"])
        rows.append((str(i), parent, role, rng.choice(["", None, "Please say a few words", "I say some words here.", "one", "x " * 40]), rng.choice(["en", None, "en", "fr"]) if i % 13 == 0 else "en", i))
    rows += [("p", "q", "user", "Say hello to us", "en", 900), ("q", "r", "assistant", "Hello to all of you.", "en", 901), ("r", "p", "assistant", "More of it.", "en", 902), ("s", "q", "user", "And now?", "en", 903), ("t", "s", "assistant", "Now it ends.", "en", 904), ("u", "u", "assistant", "alone", "en", 905)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    whole, counts = imported(df, 0)
    short, told = imported(df, 150)
    assert whole == short and counts == told and len(whole) > 20 and counts.bad_paths > 10
    assert imported(df.where("false"), 150)[0] == []


def test_rows_grow_with_messages(spark):
    n = 3000  # whole chains would have over two million rows
    df = spark.range(n, numPartitions=4).select(
        F.col("id").cast("string").alias("message_id"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent_id"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("these are words "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"), F.col("id").cast("int").alias("n"),
    )
    known = df.select("message_id", "parent_id", "role", "text")
    paths = extract.tree_paths(known)
    assert paths.agg(F.count("*"), F.max("n"), F.count_if("looped")).first()[:] == (n, n, 0)
    found, counts = extract.tree_import(df, "n", ["lang"], "t", build, reach=150)
    # the first two answers of each chain fit the prompt
    told = found.groupBy("dialogue_group").count().groupBy("count").count().collect()
    assert counts.first().bad_paths == 0 and {r[0]: r[1] for r in told} == {1: 1, 2: n // 2 - 1}
