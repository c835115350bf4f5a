import json

import pytest
from pyspark.sql import functions as F

from grainyard.operators import gate, runs
from grainyard.sources import files


def test_values_of_any_shape(spark, tmp_path):
    records = [{"experiment": "a", "x": {"y.z": [1, [2.5, "3", None], {}], "t": False}, "big": 12345678901, "e": []}, {"other": "é\n"}]
    for i, r in enumerate(records):
        (tmp_path / f"{i}.json").write_text(json.dumps(r, indent=1))
    df = files.read_records(spark, str(tmp_path))
    got = sorted((r.run or "", r.path, r.number, r.text, r.truth) for r in runs.metric_values(df, "record").collect())
    assert got == sorted([
        ("a", "experiment", None, "a", None), ("a", 'x["y.z"][0]', 1.0, None, None), ("a", 'x["y.z"][1][0]', 2.5, None, None), ("a", 'x["y.z"][1][1]', None, "3", None),
        ("a", 'x["y.z"][1][2]', None, None, None), ("a", 'x["y.z"][2]', None, None, None), ("a", "x.t", None, None, False), ("a", "big", 12345678901.0, None, None),
        ("a", "e", None, None, None), ("", "other", None, "é\n", None),
    ], key=lambda t: t[:2])
    with pytest.raises(Exception, match="nested deeper than 2"):
        runs.metric_values(df, "record", depth=2).collect()
    assert "Exchange" not in runs.metric_values(df, "record")._jdf.queryExecution().executedPlan().toString()
    assert runs.metric_values(df.limit(0), "record").count() == 0


def test_history_takes_the_first_list(spark):
    rows = [('{"experiment": "a", "p": [{"s": 1}, {"s": "no", "t": 2}, 5]}',), ('{"experiment": "b", "q": {"p": [{"s": 7}]}, "p": 3}',), ('{"experiment": "c"}',), (None,)]
    df = spark.createDataFrame(rows, "j string").select(F.parse_json("j").alias("r"))
    got = runs.metric_history(df, "r", ["$.p", "$.q.p"], {"s": "bigint", "t": "bigint"}).collect()
    assert sorted(map(tuple, got), key=lambda t: t[:2]) == [("a", 0, 1, None), ("a", 1, None, 2), ("a", 2, None, None), ("b", 0, 7, None)]
    told = runs.metric_columns(df, "r", {"n": ("bigint", ["$.p", "$.q.p[0].s"])}).collect()
    assert [r.n for r in told] == [None, 3, None, None]  # a list is no number


def test_first_cases_of_a_suite(spark):
    """A missing completion counts as an empty one, and completions of later cases count for nothing."""
    cases = gate.cases(spark)
    ids = [r.case_id for r in cases.orderBy("case_index").select("case_id").collect()]
    said = spark.createDataFrame([("r", ids[0], "Hello there"), ("r", ids[5], "x"), ("s", ids[1], "y")], "run string, case_id string, completion string")
    got = gate.suite(said, cases, ["run"], 3)
    assert sorted((r.run, r.case_id, r.completion or "") for r in got.select("run", "case_id", "completion").collect()) == sorted(
        [("r", ids[0], "Hello there"), ("r", ids[1], ""), ("r", ids[2], ""), ("s", ids[0], ""), ("s", ids[1], "y"), ("s", ids[2], "")]
    )
    assert {(r.run, r.total_count) for r in gate.summary(got, ["run"]).collect()} == {("r", 3), ("s", 3)}
    assert gate.suite(said, cases, ["run"]).count() == 2 * len(ids)
