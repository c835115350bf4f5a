"""The whole job where a narrower one would pass on the given tables."""

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

import corpus_pipeline
from grainyard.llm import common, media, overlap, queries, token_files, toxicity, wordbags

SF = "/root/testdata/sf0.001"


def word_sets(texts):
    split = {i: t.encode().lower().split() for i, t in texts.items()}
    return {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in split.items()}


def test_pipeline_drops_near_copies_from_jaccard_08(spark):
    rng = np.random.default_rng(4)
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in given.collect()}
    for k, i in enumerate(sorted(texts)[:60]):
        w = texts[i].split()
        for at in rng.integers(0, len(w), max(1, len(w) * (k % 12) // 200)):
            w[at] = "other"
        texts[5000 + k] = " ".join(w)
    texts |= {6000 + k: " ".join(["base"] * k + [f"w{j}" for j in range(60)]) for k in range(12)} | {7000: "", 7001: " ", 7002: "one two", 7003: "One  two", 7004: "one two three"}
    sets = word_sets(texts)
    first = {i: i for i in texts}
    near = {i: [j for j in sets if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in sets}
    while first != (new := {i: min(first[j] for j in near[i]) for i in first}):
        first = new
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect())
    assert got == sorted(i for i in first if first[i] == i)
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), SF).count() == 0


def test_toxicity_keeps_clean_texts_when_caps_bind(spark):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("aeinrst"), 5)) for _ in range(300)]
    toxic = np.arange(1500) % 9 == 0
    texts = [" ".join([*rng.choice(words, 30), *(["moronic", "stupid"] if rng.random() < (0.8 if k else 0.1) else [])]) for k in toxic]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(k)) for i, k in enumerate(toxic[:1000])], "doc_id bigint, toxic int")
    asked = docs.where("doc_id >= 1000").union(spark.createDataFrame([(-1, ""), (-2, None)], docs.schema))
    share, empty = [], []
    for most in (5000, 100):
        got = {r.doc_id: r for r in toxicity.toxicity_scores(asked, toxicity.train_toxicity(docs, labels, most)).collect()}
        share.append(np.mean([got[i].predicted == 0 for i in range(1000, 1500) if not toxic[i]]))
        empty += [got[-1].score, got[-2].score]
    assert abs(share[0] - share[1]) < 0.05
    assert max(empty) < 0.3


def test_toxic_tail_of_an_unbroken_word_counts():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("aeinrst"), 5)) for _ in range(300)]
    texts = [" ".join([*rng.choice(words, 30), *(["moronic", "stupid"] if k % 2 else [])]) for k in range(300)]
    model = toxicity.SubwordBag(epochs=20).fit(texts, np.arange(300) % 2)
    value = lambda t: model.scores(model.word_values(toxicity.split_words(t.encode())).sum(0)[None])[0]
    for lead in ("_".join(words[:17])[:100], "日本語" * 12):
        assert value(lead + "_moronic_stupid") > value(lead + "_" + words[20] + "_" + words[21])
    for n in range(60, 200):
        w = rng.integers(97, 123, n).astype(np.uint8).tobytes()
        parts = toxicity.split_words(w)
        assert max(map(len, parts)) <= 64 and {w[i : i + 4] for i in range(n - 3)} == {p[i : i + 4] for p in parts for i in range(len(p) - 3)}


def pdf_file(body=b""):
    lead = b"%PDF-1.4\n1 0 obj\n" + body + b"\nendobj\n"
    return lead + b"xref\n0 1\ntrailer\nstartxref\n%d\n%%%%EOF" % len(lead)


def test_sniffing_of_other_waves_and_several_pdfs():
    machine = media.automaton()
    for form, channels, bits in ((1, 2, 16), (3, 1, 32), (1, 1, 24), (1, 1, 8)):
        wide = channels * bits // 8
        wav = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + 96, b"WAVE", b"fmt ", 16, form, channels, 44100, 44100 * wide, wide, bits, b"data", 96) + bytes(96)
        assert media.sniff(wav, machine) == ("audio/wav", len(wav), [])
        assert media.sniff(b"junk" + wav + b"tail", machine)[2] == [("audio/wav", 4, len(wav))]
        assert (media.wave_data(wav, 0, len(wav)) is None) == ((form, channels, bits) != (1, 1, 8))
        assert media.sniff(wav[:-1], machine)[0] == media.UNKNOWN
    chunk = lambda kind, body: struct.pack(">I4s", len(body), kind) + body + struct.pack(">I", zlib.crc32(kind + body))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IEND", b"")
    one, two = pdf_file(), pdf_file(b"two" * 50)
    for first, second in ((one, two), (two, one), (one, one)):
        blob = b"junk" + first + png + second + b"\n"
        at = 4 + len(first)
        assert media.sniff(blob, machine)[2] == [("application/pdf", 4, len(first)), ("image/png", at, len(png)), ("application/pdf", at + len(png), len(second))]
        assert media.sniff(blob[4:], machine)[:2] == ("application/pdf", len(first))
    nest = pdf_file(one + two)
    assert media.sniff(b"junk" + nest + png, machine)[2] == [("application/pdf", 4, len(nest)), ("image/png", 4 + len(nest), len(png))]
    assert media.sniff(two[:-5], machine)[0] == media.UNKNOWN


def test_workers_give_back_what_other_stages_kept(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two")], "doc_id bigint, text string")
    taken = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, fn, schema: taken.append(cloudpickle.dumps(fn)))
    token_files.token_ids(docs, queries.tokenizer(), 0, "doc_id", "text", 1 << 21)
    overlap.marked_sets(docs, 5, "doc_id", "text")
    batch = pa.RecordBatch.from_pydict({"id": [1], "text": ["one two"]})

    def task(k):  # as a worker gets it, anew for each
        return [x.to_pylist() for x in cloudpickle.loads(taken[k])(iter([batch]))]

    wordbags.worker_table([np.ones(2)], lambda words: np.ones((len(words), 2)), 2).of([b"one"])
    common.drop_kept()
    assert not common._kept
    first = task(0)
    own = token_files.encoder(queries.tokenizer())
    assert list(common._kept.values()) == [own]
    assert task(0) == first and token_files.encoder(queries.tokenizer()) is own  # loaded once a worker, not once a task
    wordbags.worker_table([np.ones(2)], lambda words: np.ones((len(words), 2)), 2).of([b"one"])
    assert own not in common._kept.values() and len(common._kept) == 1
    assert task(1) and not common._kept  # near-duplicates, after the classifier's words
