"""Long texts, which cross the bounds of slices, and extra columns of clashing names, for every operator on documents."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from grainyard.llm import decontaminate, language, lm_score, media, mixing, overlap, simhash, token_counts, token_files, toxicity

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
NAMES = ["id", "n", "row", "key", "bucket", "fp", "own", "label", "mark", "media", "ids", "part", "h", "k", "t", "word", "hits", "no", "src", "first", "_row", "_mk", "__mk", "_id", "_text", "_n"]


@pytest.fixture(scope="module")
def long_docs(spark):
    """Two long texts that are alike, one without a space, and short ones around them; many columns whose names operators use themselves."""
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(1, 9))) for _ in range(5000)]
    text = " ".join(rng.choice(words, 900_000))
    assert len(text) > 4 << 20
    item = "one very special test item of nine words"
    rows = [(1, "short"), (2, text), (3, text[: len(text) // 2] + " " + item + " " + text[len(text) // 2 :]), (4, "漢字" * 400_000), (5, None), (6, "short")]
    return spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({n: F.lit(n) for n in NAMES}).withColumn("source", F.lit("s")).withColumn("lang", F.when(F.col("doc_id") < 4, "xx")).coalesce(1)


def test_tokens(long_docs):
    want = {r.doc_id: [*e.ids, 0] for r, e in zip(long_docs.collect(), Tokenizer.from_file(BPE).encode_batch([r.text or "" for r in long_docs.collect()], add_special_tokens=False))}
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(long_docs, BPE).collect()} == {i: len(x) - 1 for i, x in want.items()}
    assert {r.doc_id: r.ids_crc32 for r in token_files.token_file_digests(long_docs, BPE).collect()} == {i: zlib.crc32(np.array(x, "<u4").tobytes()) for i, x in want.items()}


def test_copies_and_items(spark, long_docs):
    assert {r.doc_id: r.component_id for r in overlap.similar(long_docs).collect()} == {1: 1, 2: 2, 3: 2, 4: 4, 5: 5, 6: 1}
    kept = overlap.representatives(long_docs)
    assert kept.columns == long_docs.columns and sorted(r.doc_id for r in kept.select("doc_id").collect()) == [1, 2, 4, 5]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(long_docs).collect()}
    assert got[1] == got[6] and got[5][0] == "0" * 16 and got[2][1] == got[3][1] == 2
    items = spark.createDataFrame([(7, "one very special test item of nine words")], "item_id bigint, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminations(long_docs, items).collect()] == [(3, 7)]
    left = decontaminate.decontaminated(long_docs, items)
    assert left.columns == long_docs.columns and left.count() == 5


def test_models(spark, long_docs):
    model = language.train_language(long_docs)
    told = language.languages(long_docs, model)
    assert {r.doc_id: r.lang_pred for r in told.select("doc_id", "lang_pred").collect()} == {1: "xx", 2: "xx", 3: "xx", 4: "xx", 5: "und", 6: "xx"}
    labels = spark.createDataFrame([(1, 0), (2, 1), (6, 0)], "doc_id bigint, toxic int")
    scores = toxicity.toxicity_scores(long_docs, toxicity.train_toxicity(long_docs, labels))
    assert scores.columns == [*long_docs.columns, "score", "predicted"]
    found = {r.doc_id: r.score for r in scores.select("doc_id", "score").collect()}
    assert found[1] == found[6] and all(0 <= x <= 1 for x in found.values())
    got = {r.doc_id: r for r in lm_score.lm_scores(long_docs).collect()}
    counts = Counter(w for r in long_docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 7 != 2 for w in [*(r.text or "").split(), "END"])
    assert got[2].n_tokens == 900_001 and got[4].n_tokens == 2 and got[5].n_tokens == 1
    assert {r.train_tokens for r in got.values()} == {sum(counts.values())}


def test_files_and_order(long_docs):
    for r in media.text_media_digests(long_docs).collect():
        raw = (long_docs.where(F.col("doc_id") == r.doc_id).first().text or "").encode()
        body = raw + b"\0" * (64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(body), hashlib.sha256(body).hexdigest())
    mixed = mixing.mixed_sources(long_docs)
    assert mixed.columns == [*long_docs.columns, "mix_slot", "mix_rank", "mix_position"]
    assert sorted(r.mix_position for r in mixed.select("mix_position").collect()) == list(range(6))


def test_many_sources(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3000, "big").otherwise(F.concat(F.lit("s"), F.pmod("id", F.lit(500)).cast("string"))).alias("source"))
    weights = {"big": 0.8} | {f"s{k}": 0.0004 for k in range(500)}  # every share is far below 1 / 1000
    got = sorted(mixing.mixed_sources(docs, weights, block=2).collect(), key=lambda r: r.mix_position)
    assert [r.mix_position for r in got] == list(range(6000))
    seen = Counter()
    for k, r in enumerate(got[:3000]):
        seen[r.source] += 1
        if k % 2:
            assert abs(seen["big"] / 2 - 0.8 * (k + 1) / 2) < 1
    with pytest.raises(Exception, match="more than 100 sources"):
        mixing.mixed_sources(docs, weights, max_sources=100).collect()
