import json
import random

import pytest

from grainyard.sources import documents, files
from grainyard.streaming import ingest


def rows_of(value):
    rows = value if isinstance(value, list) else next((value[k] for k in documents.DOCUMENT_KEYS if isinstance(value.get(k), list)), [value])
    return [r for r in rows if isinstance(r, dict)]


def made(rng, depth=0):
    text = "".join(rng.choice('ab{}[]",\\\n é') for _ in range(rng.randrange(12)))
    kind = rng.randrange(3 if depth > 2 else 6)
    if kind < 3:
        return [text, rng.random(), None][kind]
    return [made(rng, depth + 1) for _ in range(rng.randrange(4))] if kind == 3 else {text[:3] + str(i): made(rng, depth + 1) for i in range(rng.randrange(4))}


@pytest.mark.parametrize("size", ["600", "134217728"])
def test_lists_by_many_tasks(spark, tmp_path, size):
    rng, want = random.Random(5), []
    folder = tmp_path / "x.json"
    folder.mkdir()
    whole = [[made(rng) for _ in range(60)], [], [1, [{"a": 1}], "x}"], [{"a": 2}], {"rows": [{"b": "}"}]}, {"c": [{"d": 1}]}, [{"a": "é" * 3000}, {}], {"a": 7}]
    for i, value in enumerate(whole):
        (folder / f"{i}.json").write_text(json.dumps(value, indent=i % 3 or None, ensure_ascii=i % 2 == 0) + "\n" * (i % 2), encoding="utf-8-sig" if i % 4 == 2 else "utf-8")
        want += [(f"{i}.json", json.dumps(r, sort_keys=True)) for r in rows_of(value)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = [(r.source_file, json.dumps(json.loads(r.row), sort_keys=True)) for r in files.read_rows(spark, str(folder)).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("bad", ['[{"a": 1}', '[{"a": 1} {"b": 2}]', '[{"a": 1},]', '[{"a": "x}]', '[{"a": 1}]]', '{"a": ', '{"a": 1}}', '[{"a": 1}]}', "[1, {]}", "[,{}]"])
def test_documents_that_are_not_json(spark, tmp_path, bad):
    (tmp_path / "bad.json").write_text(bad)
    with pytest.raises(Exception, match="JSON|MALFORMED"):
        files.read_rows(spark, str(tmp_path / "bad.json")).collect()


def arrive(spark, path, batches, **options):
    for name, rows in batches.items():
        spark.createDataFrame(rows, "key int, text string").coalesce(1).write.json(f"{path}/in/{name}")
    stream = spark.readStream.schema("key int, text string").option("maxFilesPerTrigger", 1).json(f"{path}/in/*")
    ingest.append_first(stream, f"{path}/out", **options)
    return sorted((r.text is None, r.text or "", r.key) for r in ingest.read_first(spark, f"{path}/out", "key int, text string").collect())


def test_old_copies_are_dropped(spark, tmp_path):
    """Copies in one batch, in the next, and many batches and a restart later; a column of the operator's own name, null and empty texts."""
    batches = {f"b{i:02}": [(i, f"text {i}"), (i, f"Text  {i} "), (i, f"text {i // 3}"), (i, None), (i, "")] for i in range(6)}
    got = arrive(spark, tmp_path, batches, buckets=4)
    assert [g[1].lower().split() for g in got if not g[0]] == [[], *[["text", str(i)] for i in range(6)]] and [g[0] for g in got].count(True) == 1
    again = arrive(spark, tmp_path, {"c0": [(90, "TEXT 0"), (91, "text 5"), (92, "new")], "c1": [(93, " New")]}, buckets=4)
    assert sorted(set(again) - set(got)) == [(False, "new", 92)]
    tables = sorted(int(p.name[6:]) for p in (tmp_path / "out" / "keys").iterdir())
    assert tables == [4, 6, 7, 8]  # those that the eighth holds go when the ninth begins


def test_no_rows_arrive(spark, tmp_path):
    assert arrive(spark, tmp_path, {"a": []}) == [] and arrive(spark, tmp_path, {"b": [(1, "x")]}) == [(False, "x", 1)]
