"""op4 where there are more words than are broadcast."""

from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from grainyard.llm import common, lm_score

NAMES = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def scores(docs, **limits):
    got = lm_score.lm_scores(docs, **limits).toPandas()[list(NAMES)]
    return got.sort_values(list(NAMES)).reset_index(drop=True)


def same(one, two):
    exact = list(NAMES[:5])
    return one[exact].equals(two[exact]) and all(np.allclose(one[c], two[c], rtol=1e-9) for c in NAMES[5:])


def test_rare_words_are_counted_in_buckets(spark, monkeypatch):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = [(-1, None), (-2, ""), (-3, "zz " * 500), (-4, "zz yy zz yy xx"), (-5, "new0 new1 new2 new2"), (-5, "new0 new1 new2 new2"), (-6, "　a \x0bb")]
    docs = given.union(spark.createDataFrame(odd + [(-100 - k, f"zz w{k} w{k} W{k // 2} yy") for k in range(60)], given.schema))
    whole = scores(docs)
    assert len(whole) == docs.count() and (whole.n_known < whole.n_tokens).any()
    for limits in ({"max_words": 0, "head": 4}, {"max_words": 700, "head": 64}, {"max_words": 0, "head": 1}):
        assert same(scores(docs, **limits), whole)
    monkeypatch.setattr(lm_score, "RARE_PAIRS", 1 << 9)
    monkeypatch.setattr(lm_score, "BUCKET_PAIRS", 1 << 13)
    monkeypatch.setattr(lm_score, "HOME_ROWS", 50)
    assert same(scores(docs, max_words=300, head=16), whole)
    assert scores(docs.limit(0), max_words=0, head=1).empty


def test_rare_words_take_little_disk(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").coalesce(1)
    sizes = []

    def counted(df, label):
        out = common.written(df, label)
        sizes.append(sum(p.stat().st_size for p in Path(common._places[out].removeprefix("file://")).glob("*.parquet")))
        return out

    monkeypatch.setattr(lm_score, "written", counted)
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    lm_score.lm_scores(docs, max_words=5000).collect()
    assert sum(sizes) < 1.8 * docs.agg(F.sum(F.octet_length("text"))).first()[0]  # by joins of strings: 3.2
    assert spark.conf.get(name, "false") == before
