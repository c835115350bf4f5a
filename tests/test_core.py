"""Every core query against its SQL, and edge rows of the functions and operators."""

import duckdb
import pytest
from pyspark.sql import functions as F

from grainyard.functions import filters, text
from grainyard.operators import extract, gate, messages, ordering, packing, runs, splits
from grainyard.plans import core, training  # noqa: F401
from grainyard.sources import files
from grainyard.streaming import ingest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(str([round(v, 5) if isinstance(v, float) else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_equals_sql(spark, duck, name):
    df = core.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.sql(f"SELECT {', '.join(cols)} FROM ({core.SQL[name]})").fetchall()
    assert plain(df.select(*cols).collect()) == plain(want)


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


def test_normalize(spark):
    assert one(spark, text.normalize_text, "  a\r\n\r\r\n\n\t“b” ’c ") == "a\n\n \"b\" 'c"
    assert one(spark, text.normalize_turn, " a \n\n  b\r") == "a\nb"
    assert one(spark, text.squash, " a\n\t b ") == "a b"
    assert one(spark, text.squash, None) is None
    assert one(spark, text.squash, "\u2003 a \n b\u00a0\x0bc  d\t e f\n ") == "a b c d e f"
    assert one(spark, text.squash, " \n\t ") == ""
    assert one(spark, text.normalize_role, " Human ") == "user"
    assert one(spark, text.normalize_role, "narrator") is None


def test_stops(spark):
    assert one(spark, lambda c: text.trim_stops(c, ["<END>", "###"]), "reply<END>ignored") == "reply"
    assert one(spark, lambda c: text.trim_stops(c, ["<END>", "###"]), "hello") == "hello"
    assert one(spark, text.pretty_completion, "so , it is !") == "so, it is!"


def test_reasons(spark):
    assert one(spark, filters.document_reason, "x") == "short"
    assert one(spark, filters.document_reason, "see www.example.org " * 4) == "url"
    assert one(spark, filters.document_reason, "a | b | c | d | e | f | g and some more words here") == "code"
    assert one(spark, lambda c: filters.text_reason(c, filters.USER, True), "please jailbreak it") == "phrase"
    assert one(spark, lambda c: filters.text_reason(c, filters.USER, True), "hello there") is None


def test_gate_probes(spark):
    rows = [(" 2", []), ("User: what next?", ["role_leakage", "missing_required_any"]), ("q q q q q", ["repetition_loop", "missing_required_any"]), ("I am not sure.", ["missing_required_any"]), (None, ["empty_completion", "missing_required_any"]), ("two q q q", [])]
    case = gate.cases(spark).where("case_id = 'arithmetic_one_plus_one'")
    df = case.crossJoin(spark.createDataFrame([(r[0],) for r in rows], "completion string"))
    got = {r.completion: r.failures for r in gate.scored(df).collect()}
    assert got == dict(rows)


def test_splits(spark):
    with pytest.raises(ValueError):
        splits.group_split(F.col("g"), 0.9, 0.2)
    df = spark.range(20).withColumn("split", F.lit("training"))
    counts = {r.split: r["count"] for r in splits.repair_empty(df, ["id"]).groupBy("split").count().collect()}
    assert counts == {"training": 18, "validation": 1, "testing": 1}
    ranked = ordering.rank_split(spark.range(25).withColumn("k", text.sha1_hex(F.col("id").cast("string"))), "k")
    assert {r.split: r["count"] for r in ranked.groupBy("split").count().collect()} == {"training": 20, "validation": 2, "testing": 3}


def test_prefix_sum_and_windows(spark):
    df = spark.range(50).withColumn("t", F.repeat(F.lit("ab"), (F.col("id") % 7).cast("int")))
    got = [r.running for r in ordering.prefix_sum(df, F.floor(F.col("id") / 8), ["id"], F.length("t")).orderBy("id").collect()]
    want = [sum(2 * (i % 7) for i in range(k + 1)) for k in range(50)]
    assert got == want
    stream = "|".join("ab" * (i % 7) for i in range(50))
    windows = [r.window for r in packing.lm_windows(df, "id", "t", 16, "|", 8).orderBy("window_id").collect()]
    assert windows == [stream[i : i + 17] for i in range(0, len(stream) - 16, 16)]
    short = [r.window for r in packing.lm_windows(df, "id", "t", 16, "|", 8, most=100).orderBy("window_id").collect()]
    assert short == [stream[i : i + 17] for i in range(0, 100 - 16, 16)]
    with pytest.raises(ValueError, match="shorter"):
        packing.lm_windows(df, "id", "t", 16, "|", 8, most=10_000)
    blank = packing.lm_windows(spark.range(60).withColumn("t", F.when(F.col("id") == 50, "x")), "id", "t", 8, "|", 8).collect()
    assert [(r.window_id, r.window) for r in blank] == [(6, "||x||||||")]
    assert [(r.window_id, r.batch_id) for r in packing.batches(spark.createDataFrame([(3,), (5,), (9000,)], "window_id bigint"), "window_id", 2).orderBy("window_id").collect()] == [(3, 0), (5, 0), (9000, 1)]


def test_cap_with_some_rows_first(spark):
    df = spark.range(30).withColumns({"c": F.lit("a"), "made": F.col("id") >= 28})
    kept = {r.id for r in splits.cap(df, "c", "id", 0, 5, F.col("made")).collect()}
    assert {28, 29} <= kept and len(kept) == 5


def test_merge_runs(spark):
    rows = [("a", 0, "user", "x"), ("a", 1, "system", "s"), ("a", 2, "human", "y"), ("a", 3, "bot", "z"), ("b", 0, "assistant", "q"), ("b", 1, "user", "r"), ("c", 0, "user", "alone")]
    got = messages.merge_runs(spark.createDataFrame(rows, "row_id string, pos int, role string, content string")).orderBy("row_id", "i").collect()
    assert [(r.row_id, r.role, r.content) for r in got] == [("a", "user", "x\ny"), ("a", "assistant", "z")]


def test_masked_loss_without_weight(spark):
    df = spark.createDataFrame([("a", 1.0, 0.0), ("b", 2.0, 1.0)], "g string, l double, w double")
    got = {r.g: r.mean_loss for r in runs.masked_loss(df, ["g"], F.col("l"), F.col("w")).collect()}
    assert got == {"a": None, "b": 2.0}


def test_extract_shapes(spark):
    rows = ['{"turns": [{"speaker": "a", "utterance": "x"}, "{\\"role\\": \\"b\\", \\"text\\": \\"y\\"}"]}', '{"instruction": "do", "input": "this", "output": "done"}', '{"question": "q", "answer": ""}', "no json", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, row string")
    read = lambda **more: [(r.row_id, r.pos, r.role, r.content) for r in extract.extract_messages(df, "i", "row", **more).where("shape < 9 OR row_id <> 1").orderBy("row_id", "shape", "pos").collect()]
    assert read() == [(0, 0, "a", "x"), (0, 1, "b", "y")]
    pair = extract.row_messages(df, "i", "row").where("row_id = 1").orderBy("i").collect()
    assert [(r.role, r.content) for r in pair] == [("user", "do"), ("assistant", "done")]
    more = extract.row_messages(df, "i", "row", include_input=True).where("row_id = 1").orderBy("i").collect()
    assert [(r.role, r.content) for r in more] == [("user", "do\nthis"), ("assistant", "done")]


def test_first_shape_that_gives_a_conversation(spark):
    rows = ['{"messages": [{"role": "user", "content": "alone"}], "turns": "[{\\"from\\": \\"human\\", \\"value\\": \\"a\\"}, {\\"from\\": \\"gpt\\", \\"value\\": \\"b\\"}]", "prompt": "c", "response": "d"}', '{"messages": [{"role": null, "from": "user", "text": "x"}, {"role": "bot", "text": "y"}], "prompt": "p", "completion": "q"}', '{"messages": []}']
    df = spark.createDataFrame(list(enumerate(rows)), "i int, row string")
    got = [(r.row_id, r.role, r.content) for r in extract.row_messages(df, "i", "row").orderBy("row_id", "i").collect()]
    assert got == [(0, "user", "a"), (0, "assistant", "b"), (1, "user", "p"), (1, "assistant", "q")]


def test_tree_edges(spark):
    rows = [("a", None, "user", "old", 0), ("a", None, "user", "new", 1), ("b", "a", "bot", "t", 2), ("c", "d", "gpt", "u", 3), ("d", "c", "user", "v", 4), ("e", "gone", "assistant", None, 5), (None, "a", "assistant", "w", 6)]
    df = spark.createDataFrame(rows, "message_id string, parent_id string, role string, text string, n int")
    assert extract.is_tree(df) and not extract.is_tree(df.drop("text"))
    got = [(r.row_id, r.pos, r.content) for r in extract.tree_chains(df, "n").orderBy("row_id", "pos").collect()]
    assert got == [("b", -1, "new"), ("b", 0, "t"), ("c", -1, "v"), ("c", 0, "u"), ("e", 0, None)]
    assert extract.tree_chains(df.limit(0), "n").count() == 0


def test_read_rows(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n[2]\n  {"a": 3}\n')
    (tmp_path / "b.json").write_text('{"data": "none", "rows": [{"a": 4}, 5]}')
    (tmp_path / "c.json").write_text('[{"a": 6}]')
    (tmp_path / "d.json").write_text('{"a": 7}')
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\nno json\n')
    found = files.read_rows(spark, *[str(tmp_path / n) for n in ("a.jsonl", "b.json", "c.json", "d.json")])
    assert sorted((r.source_file, r.a) for r in found.select("source_file", F.get_json_object("row", "$.a").alias("a")).collect()) == [("a.jsonl", "1"), ("a.jsonl", "3"), ("b.json", "4"), ("c.json", "6"), ("d.json", "7")]
    with pytest.raises(Exception, match="MALFORMED"):
        files.read_rows(spark, str(tmp_path / "bad.jsonl")).collect()
    with pytest.raises(ValueError, match="format"):
        files.read_rows(spark, "x.csv")


def test_row_ids_masks_and_codes(spark):
    df = spark.createDataFrame([(0, "", 5), (3, "x", 6), (None, "y", 7)], "a int, b string, n int")
    assert [r[0] for r in df.orderBy("n").select(messages.row_id(F.col("a"), F.col("b"), index=F.col("n"))).collect()] == ["5", "3", "y"]
    tokens = spark.createDataFrame([(1, i, t) for i, t in enumerate("x A b U c A d E e E A".split())] + [(2, 0, None)], "doc int, pos int, t string")
    masked = packing.assistant_mask(tokens, "doc", "pos", "t", F.lit("A"), F.lit("U"), F.lit("E")).orderBy("doc", "pos").collect()
    assert "".join(str(r.loss) for r in masked) == "00100011000" + "0"
    vocab = spark.createDataFrame([("\n", 1), ("a", 2)], "token string, token_id int")
    coded = packing.decode(packing.encode(spark.createDataFrame([("aba",), ("",), (None,)], "t string"), "t", vocab), "ids", vocab)
    assert sorted((str(r.ids), str(r.decoded)) for r in coded.collect()) == [("None", "None"), ("[2, 1, 2]", "a\na"), ("[]", "")]
    odd = packing.decode(spark.createDataFrame([([2, 9, 0],)], "ids array<int>"), "ids", vocab)
    assert odd.first().decoded == "a??"
    with pytest.raises(ValueError, match="single characters"):
        packing.encode(vocab, "token", vocab.withColumn("token", F.repeat("token", F.lit(2))))
    assert one(spark, lambda c: text.has_stop(c, ["#"], F.array(F.lit(1), F.lit(9)), 9), "none") is True
    assert one(spark, lambda c: text.pretty_completion(c, brackets=True), "so ( it ) !") == "so (it)!"


def test_plain_prompt_rejects_other_roles(spark):
    df = spark.createDataFrame([(1, 1, "user", "hi"), (1, 2, "assistant", "yo")], "row_id int, i int, role string, content string")
    assert messages.plain_prompts(df).first().prompt == "User: hi\nAssistant: yo\nAssistant: "
    with pytest.raises(Exception, match="unsupported"):
        messages.plain_prompts(df.withColumn("role", F.lit("tool"))).collect()


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\n\n two \n \nthree\n")
    assert sorted(r.text for r in files.read_paragraphs(spark, str(tmp_path / "a.txt")).collect()) == ["one", "three", "two"]
    (tmp_path / "b.jsonl").write_text('{"text": "x"}\n{"other": 1}\n')
    with pytest.raises(Exception, match="no text"):
        files.read_jsonl_texts(spark, str(tmp_path / "b.jsonl")).collect()
    (tmp_path / "c.jsonl").write_text('{"id": "i", "prompt_text": "p", "assistant_text": "a"}\n')
    assert files.read_sft(spark, str(tmp_path / "c.jsonl")).first().chat_text == "p a\n<END_ASSISTANT>\n<CHAT_END>"
    assert one(spark, files.source_label, "/x/My File.jsonl.gz") == "my_file_jsonl"
    assert one(spark, lambda c: files.source_label(c, "Own"), "/x/(a) b!.json") == "Own_a_b"
    examples = spark.createDataFrame([("i", "c1", "training"), ("j", "c2", "testing")], "id string, chat_text string, split string")
    files.write_sft(examples, str(tmp_path / "sft"))
    assert {r.split: r.documents for r in files.split_sizes(spark, str(tmp_path / "sft" / "chats")).collect()} == {"training": 1, "testing": 1}
    spark.createDataFrame([(1, " x ", "y"), (2, None, "z")], "n int, a string, b string").write.parquet(str(tmp_path / "d"))
    assert [r.text for r in files.read_texts(spark, str(tmp_path / "d")).collect()] == ["x"]


def test_strict_readers(spark, tmp_path):
    parts = [f'{{"prompt_text": "p{i}", "assistant_text": "a"}}\n' for i in range(300)]
    for k in range(3):
        (tmp_path / f"part-{k}.jsonl").write_text("".join(parts[100 * k : 100 * k + 100]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        ids = {r.prompt_text: r.id for r in files.read_sft(spark, str(tmp_path)).collect()}
        first = {r.prompt_text for r in files.read_sft(spark, str(tmp_path), 150).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert ids == {f"p{i}": f"example_{i + 1}" for i in range(300)} and first == {f"p{i}" for i in range(150)}
    for name, body, match in (("bad", "broken line\n", "MALFORMED|FAILFAST"), ("half", '{"prompt_text": "p"}\n', "no assistant_text"), ("none", "", "nothing")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.jsonl").write_text(body)
        with pytest.raises(Exception, match=match):
            files.read_sft(spark, str(tmp_path / name)).collect()
    with pytest.raises(Exception, match="nothing"):
        files.read_paragraphs(spark, str(tmp_path / "none"))
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.txt").write_text("a\n\nb\n \nc\n\n\nd")
    (tmp_path / "p" / "b.txt").write_text("e\n\nf")
    assert [r.text for r in files.read_paragraphs(spark, str(tmp_path / "p"), 5).collect()] == list("abcde")
    files.write_pretrain(spark.createDataFrame([("x", "training")], "text string, split string"), str(tmp_path / "w"))
    with pytest.raises(ValueError, match="validation"):
        files.split_sizes(spark, str(tmp_path / "w"), ("training", "validation"))


def test_order_of_sparse_and_repeated_numbers(spark):
    rows = [(i * 10**12 if i % 3 else 7, 1) for i in range(500)] + [(None, 1)]
    df = spark.createDataFrame(rows, "i bigint, v int")
    got = ordering.prefix_sum(ordering.even_buckets(df, "i", rows=20), F.col("_even"), ["i"], F.col("v"))
    assert got.select("_even").distinct().count() > 10
    want = sorted((r[0] is not None, r[0]) for r in rows)
    told = sorted((r.i is not None, r.i, r.running) for r in got.collect())
    assert [(a, b) for a, b, _ in told] == want and max(r for *_, r in told) == len(rows)
    assert all(r == sum((x <= (a, b)) for x in want) for a, b, r in told if b != 7)
    with pytest.raises(ValueError, match="few"):
        ordering.order_split(spark.range(9), "id")
    counts = {r.split: r["count"] for r in ordering.order_split(spark.range(11), "id").groupBy("split").count().collect()}
    assert counts == {"training": 8, "validation": 1, "testing": 2}


def test_tensors_and_mixture(spark):
    rows = spark.createDataFrame([(1, [5, 6, 7], [8, 9]), (2, [], [1]), (3, [1], [1] * 6), (4, list(range(9)), [8, 9]), (5, None, [1])], "id int, p array<int>, t array<int>")
    got = {r.id: r for r in packing.sft_tensors(rows, "p", "t", 5, 0, ["id"]).collect()}
    assert {i: r.status for i, r in got.items()} == {1: "kept", 2: "empty", 3: "too_long", 4: "truncated", 5: "empty"}
    assert (got[1].input_ids, got[1].target_ids, got[1].loss_mask, got[1].loss_targets) == ([5, 6, 7, 8, 0], [6, 7, 8, 9, 0], [0, 0, 1, 1, 0], 2)
    assert (got[4].input_ids, got[4].target_ids, got[4].loss_mask) == ([5, 6, 7, 8, 8], [6, 7, 8, 8, 9], [0, 0, 0, 1, 1]) and got[2].input_ids is None
    batches = spark.createDataFrame([("a", 0, 2), ("a", 1, 0), ("b", 0, 1)], "source string, index bigint, loss_targets int")
    slots = spark.range(9).withColumnRenamed("id", "i")
    mixed = packing.mixture_batches([("a", 2), ("b", 1)], batches, slots).orderBy("i").collect()
    assert [(r.source, r["index"], r.update) for r in mixed] == [("a", 0, 1), ("a", 1, None), ("b", 0, 2), ("a", 0, 3), ("a", 1, None), ("b", 0, 4), ("a", 0, 5), ("a", 1, None), ("b", 0, 6)]
    with pytest.raises(ValueError, match="no batches"):
        packing.mixture_batches([("a", 2), ("c", 1)], batches, slots)
    with pytest.raises(Exception, match="zero"):
        runs.masked_loss(spark.createDataFrame([("a", 1.0, 0.0)], "g string, l double, w double"), ["g"], F.col("l"), F.col("w"), strict=True).collect()


def test_tree_depth_and_open_prompts(spark):
    df = spark.createDataFrame([(str(i), str(i - 1) if i else None, "bot" if i % 2 else "user", str(i), i) for i in range(20)], "message_id string, parent_id string, role string, text string, n int")
    got = extract.tree_chains(df, "n", max_depth=3).groupBy("row_id").agg(F.min("pos").alias("p")).collect()
    assert {r.row_id: r.p for r in got} == {str(i): -min(i, 3) for i in range(1, 20, 2)}
    said = spark.createDataFrame([(1, "greeting", "x"), (2, "greeting", None)], "run int, case_id string, completion string")
    left = gate.open_prompts(said, gate.cases(spark), ["run"])
    assert left.count() == 2 * 21 and left.where("prompt IS NULL").count() == 0


def test_first_seen_with_bounded_state(spark, tmp_path):
    rows = [(f"2024-01-{d:02d} 00:00:00", t) for d, t in ((1, "a"), (1, " A "), (2, "b"), (9, "c"), (9, "a"), (9, "b"))]
    for k, part in enumerate((rows[:3], rows[3:4], rows[4:])):
        given = spark.createDataFrame(part, "at string, text string").select(F.col("at").cast("timestamp").alias("at"), "text")
        given.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.append_all(ingest.first_seen(spark.readStream.schema(given.schema).parquet(str(tmp_path / "in")), time="at"), str(tmp_path / "out"))
    got = sorted((r.text, r.at.day) for r in spark.read.parquet(str(tmp_path / "out" / "rows")).collect())
    assert got == [("a", 1), ("a", 9), ("b", 2), ("b", 9), ("c", 9)]  # after a week the first ones are forgotten


def test_frequency_vocab_of_nothing(spark):
    got = packing.frequency_vocab(spark.createDataFrame([(None,), ("once",)], "t string"), "t", 10, ["<PAD>"]).collect()
    assert [(r.token, r.token_id) for r in got] == [("<PAD>", 1)]
