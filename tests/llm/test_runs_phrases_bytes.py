"""Periodic runs, phrases and byte-level BPE against brute force, with the edge cases that their docstrings define."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from grainyard.llm import byte_bpe, phrases, queries, word_runs

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
GAPS = " \t\n\x0b\x0c\r"


def split(text, gaps):
    for c in gaps:
        text = text.replace(c, "\0")
    return [w for w in text.split("\0") if w]


def brute_runs(w, least=6, times=4):
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def brute_digest(doc_id, text):
    w = split(text or "", GAPS)
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = brute_runs(w)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    told = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *told, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


@pytest.mark.parametrize("least, times", [(6, 4), (2, 2), (9, 3)])
def test_all_runs_of_random_words(least, times):
    rng = random.Random(least)
    for _ in range(300):
        docs = []
        for _ in range(rng.randrange(4)):
            doc = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randrange(50))]
            if doc and rng.random() < 0.5:
                s, p = rng.randrange(len(doc)), rng.randrange(1, 9)
                doc[s:] = [doc[s + i % min(p, len(doc) - s)] for i in range(len(doc) - s)]
            docs.append(doc)
        words, first = np.array([x for d in docs for x in d], np.int64), np.r_[0, np.cumsum([len(d) for d in docs], dtype=np.int64)]
        assert word_runs.runs_of(words, first, least, times).tolist() == [[i, *r] for i, d in enumerate(docs) for r in brute_runs(d, least, times)]


def test_runs_take_no_quadratic_time():
    rows = [[1] * 200_000, [1, 2, 3] * 60_000, [x for i in range(30_000) for x in (*[1] * 6, i + 2)]]
    first = np.r_[0, np.cumsum([len(r) for r in rows])]
    found = word_runs.runs_of(np.array([x for r in rows for x in r]), first)
    assert len(found) == 30_002 and found[:2].tolist() == [[0, 0, 200_000, 1], [1, 0, 180_000, 3]]


def test_word_runs_query(spark, tmp_path):
    rng = random.Random(2)
    texts = [None, "", " \t\n", "a", "a a a a a a", "x " * 40 + "y", "É\x0bé\x0c" * 30, "\x1c \x1d" * 9, "one two\rthree " * 2000]
    texts += [" ".join(rng.choice(["a", "b", "c c", "dd"]) for _ in range(rng.randrange(200))) for _ in range(150)]
    rows = [(i if i % 40 else None, t, "keep") for i, t in enumerate(texts)] + [(4, texts[4], "again"), (4, "a b", "other")]
    spark.createDataFrame(rows, "doc_id bigint, text string, runs string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_word_runs(spark, str(tmp_path))
    assert Counter(map(tuple, got.collect())) == Counter(brute_digest(i, t) for i, t, _ in rows)
    assert spark.read.parquet(f"{tmp_path}/documents.parquet").where("false").transform(lambda d: word_runs.periodic_runs(d)).count() == 0


def brute_collocations(docs, most_words=3, support=10, share=50, first=2000):
    counts, total = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in split(text, ".,;:!?\n\x0b\x0c\r"):
            w = split(piece, " \t")
            total[lang] += len(w)
            counts.update((lang, tuple(w[i : i + n])) for n in range(1, most_words + 1) for i in range(len(w) - n + 1))
    often = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= support}
    out = {}
    for (lang, p), a in often.items():
        inner = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023,E731
        if any(x == lang and len(q) > len(p) and 100 * b >= share * a and inner(q) for (x, q), b in often.items()):
            continue
        score, _, l, r = min((10**6 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return {(lang, i + 1, x[2].decode(), -x[1], x[3], x[4], total[lang], -x[0]) for lang, found in out.items() for i, x in enumerate(sorted(found)[:first])}


def phrase_docs():
    rng = random.Random(4)
    words = ["the", "The", "of", "new", "york", "city", "é", "ß", "A.b", "x,y", "\x1f", "zé"]
    rows = [(None if rng.random() < 0.1 else rng.choice(["en", "fr", "und"]), rng.choice([" ", "\t", "  "]).join(rng.choice(words) for _ in range(rng.randrange(60)))) for _ in range(250)]
    return [*rows, ("en", None), ("en", ""), ("de", "one two"), *[("fr", "same words again and again!")] * 30, ("en", "new york city " * 400)]


def test_collocations(spark):
    docs = phrase_docs()
    table = spark.createDataFrame([(*d, i, "f") for i, d in enumerate(docs)], "lang string, text string, rank int, phrase string").repartition(3)
    want = brute_collocations(docs)
    assert set(map(tuple, phrases.collocations(table).collect())) == want and len(want) > 100
    # a bit array that knows nearly everything gives the same, as does another width, support and share
    assert set(map(tuple, phrases.collocations(table, most_bytes=SMALL).collect())) == want
    assert set(map(tuple, phrases.collocations(table, 4, 7, 80, 5).collect())) == brute_collocations(docs, 4, 7, 80, 5)
    assert phrases.collocations(table.where("false")).count() == 0


SMALL = 1 << 11


def test_many_ranges_of_hashes(spark, monkeypatch):
    monkeypatch.setattr(phrases, "RANGE_BYTES", 1000)
    monkeypatch.setattr(phrases, "SLICE", 500)
    docs = phrase_docs()
    assert set(map(tuple, phrases.collocations(spark.createDataFrame(docs, "lang string, text string")).collect())) == brute_collocations(docs)


def test_scores_are_exact(spark):
    rows = [(5 * 10**12, 7 * 10**12, 9 * 10**12), (10**13 - 1, 10**13, 10**13), (999_999_999_999, 10**12, 999_999_999_999), (10, 10, 10)]
    got = spark.createDataFrame(rows, "a bigint, l bigint, r bigint").select("a", "l", "r", phrases.score("a", "l", "r").alias("s")).collect()
    assert all(x.s == 10**6 * x.a * x.a // (x.l * x.r) for x in got)


def test_cuts_of_long_texts():
    own = byte_bpe.codec(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(1)
    some = ["a", "B", "é", "漢", "の", "9", "²", "Ⅷ", " ", "  ", "\n", "\t", "\x1c", "\x85", "　", " ", " ", "​", "'", "'s", "'ll", ".", ",", "、", "!", "😀", "́", "_"]
    for _ in range(5000):
        text = "".join(rng.choice(some) for _ in range(rng.randrange(30)))
        want = own.encoding.encode_ordinary(text)
        assert all(own.encode(text, part, run).tolist() == want for part, run in ((1, 2), (3, 3), (5, 1024), (2, 4)))
        assert own.decode(np.array(want, np.int32)) == text.encode()


def test_byte_bpe_query(spark, tmp_path):
    own = byte_bpe.codec(RANKS, public_tokenizers.PATTERN)
    texts = [None, "", " ", "word", "<|endoftext|> is text", "né 漢字 😀 ‍́", "ab " * 100_000, "漢" * 70_000 + "。" + "字" * 70_000]
    rows = [(i or None, t, [1]) for i, t in enumerate(texts)] + [(3, "word", None), (3, "other", None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, ids array<int>").write.parquet(f"{tmp_path}/documents.parquet")
    ids = [(i, own.encoding.encode_ordinary(t or ""), t or "") for i, t, _ in rows]
    want = Counter((i, len(x), sha(",".join(map(str, x))), sha(t)) for i, x, t in ids)
    assert Counter(map(tuple, queries.op13_byte_bpe(spark, str(tmp_path)).collect())) == want
    assert byte_bpe.encoded(spark.read.parquet(f"{tmp_path}/documents.parquet").where("false"), RANKS).count() == 0


def test_white_space_beyond_the_library(spark):
    texts = ["\n" * 300_000 + "a b", "x" + " " * 300_000, " " * 200_000 + "\ny"]
    found = byte_bpe.byte_bpe_digests(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), RANKS).select("doc_id", "decoded_sha256").collect()
    assert dict(map(tuple, found)) == {i: sha(t) for i, t in enumerate(texts)}


def test_bytes_of_ids_that_are_no_text(spark):
    ranks = byte_bpe.codec(RANKS, public_tokenizers.PATTERN).encoding
    half = [ranks.encode_single_token(b"\xf0"), ranks.encode_single_token(b"a")]
    back = byte_bpe.decoded(spark.createDataFrame([(1, half), (2, None), (2, [])], "doc_id int, ids array<int>"), RANKS)
    assert sorted((r.doc_id, bytes(r.decoded)) for r in back.select("doc_id", "decoded").collect()) == [(1, b"\xf0a"), (2, b""), (2, b"")]


def test_queries_keep_row_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for query in (queries.op11_word_runs, queries.op13_byte_bpe):
        assert query(spark, "/root/testdata/sf0.001").agg(F.count("*"), F.count_distinct("doc_id")).first()[0] == docs.count()
