"""Orders in which numbers repeat, are missing or are all the same; budgets by file; packing of a stream."""

import random

import pytest
from pyspark.sql import functions as F

from grainyard.operators import gate, ordering, packing
from grainyard.streaming import ingest

NAMES = ["_b", "_v", "_s", "_bb", "_before", "_own", "_even", "_rank", "_live", "_mark", "_salt", "_at", "_of", "_more", "rank2"]


@pytest.fixture(scope="module")
def tied(spark):
    """30 rows of numbers 1 (20 times) and 2, of 8 characters each; columns whose names operators use themselves."""
    df = spark.range(30).withColumn("nr", F.when(F.col("id") < 20, 1).otherwise(2)).withColumn("t", F.lit("x" * 8))
    return df.withColumns({n: F.lit(n) for n in NAMES}).repartition(5)


def test_repeated_numbers(spark, tied):
    assert {r.split: r["count"] for r in ordering.order_split(tied, "nr").groupBy("split").count().collect()} == {"training": 24, "validation": 3, "testing": 3}
    assert {r.split: r["count"] for r in ordering.rank_split(tied.withColumn("key", F.lit("same")), "key").groupBy("split").count().collect()} == {"training": 24, "validation": 3, "testing": 3}
    kept = ordering.char_budget(tied, "nr", F.length("t"), 100, ["id"])
    assert [(r.id, r.running, r["_own"]) for r in kept.orderBy("id").collect()] == [(i, 10 * i + 10, "_own") for i in range(10)]
    assert [r["count"] for r in packing.batches(tied, "nr", 8).groupBy("batch_id").count().orderBy("batch_id").collect()] == [8, 8, 8, 6]
    some = packing.batches(tied, "nr", 8, ["id"], first=2)
    assert {r.id: r.batch_id for r in some.collect()} == {i: i // 8 for i in range(16)} and set(some.columns) == {*tied.columns, "batch_id"}
    three = spark.createDataFrame([(5, "abcdefgh", 2), (5, "ijklmnop", 1), (5, None, 3)], "nr int, t string, k int")
    windows = packing.lm_windows(three, "nr", "t", 4, "|", ties=["k"]).orderBy("window_id").collect()
    assert [r.window for r in windows] == ["ijklm", "mnop|", "|abcd", "defgh"][:2] + ["|abcd", "defgh"]


def test_in_order_of_anything(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 7, 7, 7, -(10**15), 10**15, rng.randrange(10**18)]), i, {"k": i}, rng.randrange(-5, 9) if i % 9 else None) for i in range(800)]
    df = spark.createDataFrame(rows, "nr bigint, id int, m map<string,int>, v int").repartition(7)
    got = ordering.in_order(df, ["nr"], ["id"], value=F.col("v"), rows=50).orderBy("rank").collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r.nr, r.id, r.m, r.v) for r in got] == want and [r["rank"] for r in got] == list(range(1, 801))
    total = 0
    for r in got:
        total += r.v or 0
        assert r.running == total
    assert ordering.in_order(df.limit(0), ["nr"], value=F.col("v")).count() == 0
    # without ties the order is some order of the numbers, the same on every run
    runs = [[(r["rank"], r.nr, r.id) for r in ordering.in_order(df.repartition(n), ["nr"]).orderBy("rank").collect()] for n in (2, 5)]
    assert runs[0] == runs[1] and [x[1] for x in runs[0]] == [r[0] for r in want]


def test_one_row_many_times_fills_several_ranges(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(ordering, "saved", lambda df, label, own=ordering.saved: kept.append(own(df, label)) or kept[-1])
    df = spark.range(20_000, numPartitions=8).select(F.lit(1).alias("nr"), F.lit("same").alias("t"))
    placed = ordering.in_order(df, ["nr"], rows=2_500)
    ranges = kept[0].groupBy(F.col("_metadata.file_name")).count().collect()
    assert len(ranges) > 4 and max(r["count"] for r in ranges) <= 5_000
    assert placed.agg(F.min("rank"), F.max("rank"), F.count_distinct("rank")).first()[:] == (1, 20_000, 20_000)


def brute_budget(rows, most):
    total, kept, ended = 0, set(), set()
    for file, nr, i, n in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2])):
        if file in ended:
            continue
        if total + (n or 0) > most:
            ended.add(file)
            continue
        total += (n or 0) + 2
        kept.add(i)
    return kept


@pytest.mark.parametrize("most, step", [(0, 1000), (60, 1), (400, 2), (1500, 1000), (10**6, 1000)])
def test_budget_by_file(spark, most, step):
    rng = random.Random(most)
    rows = [(rng.choice([None, "a", "b", "c", "d", "e"]), rng.choice([None, 1, 2, 3]), i, rng.choice([None, 0, 1, 5, 20, 90])) for i in range(120)]
    df = spark.createDataFrame(rows, "file string, nr int, id int, n int").repartition(3)
    got = ordering.file_budget(df, "file", "nr", F.col("n"), most, ["id"], step)
    assert {r.id for r in got.collect()} == brute_budget(rows, most) and got.columns == df.columns
    assert ordering.file_budget(df.limit(0), "file", "nr", F.col("n"), most).count() == 0


def test_packing_of_a_stream(spark, tmp_path):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abc |") for _ in range(rng.choice([0, 0, 3, 40]))) or None for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    bounds = [0, 25, 26, 26, 60]
    for a, b in zip(bounds, bounds[1:]):
        df.where((F.col("i") >= a) & (F.col("i") < b)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        ingest.packed_windows(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "i", "t", 7, "|", str(tmp_path))
    want = packing.lm_windows(df, "i", "t", 7, "|", trailing=True)
    got = ingest.read_packed(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 50
    # another checkpoint without what was left before it
    with pytest.raises(Exception, match="batch=0|PATH_NOT_FOUND"):
        spark.read.parquet(f"{tmp_path}/nowhere/left/batch=0")


def test_windows_without_prompt(spark):
    df = spark.createDataFrame([(1, "", "answer"), (2, None, "answer"), (3, "ask", ""), (4, "ask", None), (5, "ask", "answer"), (6, "ask", "x" * 9), (7, "question", "yes")], "id int, prompt_text string, target_text string")
    got = {r.id: r for r in packing.sft_windows(df, 8).collect()}
    assert {i: r.status for i, r in got.items()} == {1: "empty", 2: "empty", 3: "empty", 4: "empty", 5: "kept", 6: "too_long", 7: "truncated"}
    assert (got[5].window, got[5].loss_targets, got[7].window, got[7].prompt_kept) == ("askanswer", 6, "estionyes", 6) and got[1].window is None


def test_first_cases_of_the_gate(spark):
    cases = gate.cases(spark)
    said = spark.createDataFrame([("r", c.case_id, "x") for c in cases.collect()], "run string, case_id string, completion string")
    told = gate.summary(gate.suite(said, cases, ["run"], first=3), ["run"]).first()
    names = [c.case_id for c in cases.orderBy("case_index").limit(3).collect()]
    assert told.total_count == 3 and set(told.failed_case_ids) <= set(names)
