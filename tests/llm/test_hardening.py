"""Hostile input: words that shared a hash, media that took quadratic time, long schedules, large families of unlike sets."""

import random
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainyard.llm import lm_score, media, mixing, pieces
from grainyard.llm.common import SPACES, span_hashes, word_spans
from grainyard.llm.overlap import alike_pairs

TWINS = "b'*5znpcdaabcdefgh", "k/8v5&@hd&nktkro"  # one hash in an earlier version


def test_words_that_shared_a_hash(spark):
    text = " ".join([*TWINS, "", TWINS[0], "é" * 99]).encode()
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), SPACES[1])
    found = span_hashes(data, starts, ends).tolist()
    assert found[0] == found[2] and len(set(found)) == 3
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 != 2][:20]
    held = next(i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = [(i, f"{TWINS[0]} some words of {i}") for i in ids] + [(held, f"{TWINS[1]} words")]
    got = {r.doc_id: r for r in lm_score.lm_scores(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[held].held_out and (got[held].n_tokens, got[held].n_known) == (3, 2)


def test_checksums_of_parts():
    data, memo = random.Random(1).randbytes(60_000), {}
    for _ in range(200):
        a, b = sorted(random.Random(_).choices(range(60_001), k=2))
        assert media.crc_between(data, a, b, memo) == zlib.crc32(data[a:b])


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def open_pngs(n):
    head, parts, at = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0" * 13), [], 0
    while at + len(head) + 20 < n:
        at += len(head)
        parts.append(head + struct.pack(">I4s", n - at - 12, b"IDAT"))
        at += 8
    return b"".join(parts)


@pytest.mark.parametrize("make", [lambda n: b"GIF89aaaaaaaa!a" * (n // 15), open_pngs])
def test_validators_take_linear_time(make):
    machine, took = media.automaton(), []
    for n in (1 << 18, 1 << 20):
        began = time.process_time()
        media.sniff(make(n), machine)
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.5 and took[1] < 5


def test_validators_still_find_media():
    gif = b"GIF89a" + bytes([1, 0, 1, 0, 0, 0, 0]) + b"!\xfe\3abc\0;"
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0" * 13) + chunk(b"IDAT", random.Random(2).randbytes(50_000)) + chunk(b"IEND", b"")
    kind, _, inside = media.sniff(b"x" * 9000 + png + b"yy" + gif + gif[:-1], media.automaton())
    assert [(t, o, n) for t, o, n in inside] == [("image/png", 9000, len(png)), ("image/gif", 9002 + len(png), len(gif))]


def brute_schedule(q):
    h, c, out = sum(q), [0] * len(q), []
    for t in range(h):
        pick = min((-(-(c[i] + 1) * h // q[i]), i) for i in range(len(q)) if c[i] < q[i] and c[i] * h // q[i] <= t)[1]
        c[pick] += 1
        out.append(pick)
    return out


def schedule(spark, q):
    src = F.array(*[F.struct(F.lit(f"={i:05}").alias("key"), F.lit(1).cast("bigint").alias("n"), F.lit(x).cast("bigint").alias("q")) for i, x in enumerate(q)])
    units = spark.range(1).select(src.alias("src"), F.lit(sum(q)).cast("bigint").alias("h"))
    return units.withColumn("shares", F.expr(mixing._SHARES)).select(F.expr(mixing._PERIOD).alias("run")).first().run


@pytest.mark.parametrize("q", [[1], [3, 3, 1], [7, 2, 2, 7, 1, 5], [100, 300, 1, 1, 200, 100, 298]])
def test_schedule_is_earliest_deadline_first(spark, q):
    assert schedule(spark, q) == brute_schedule(q)


def test_long_schedule(spark):
    rows = [(i, "a" if i % 1000 else "rare") for i in range(20_000)]
    docs = spark.createDataFrame([(i, s if i % 3 else "b") for i, s in rows], "doc_id bigint, source string")
    began = time.time()
    got = mixing.mixed_sources(docs, {"a": 60_000.0, "b": 39_999.0, "rare": 1.0}, resolution=100_000)
    assert got.agg(F.count_distinct("mix_position"), F.max("mix_position")).first()[:] == (20_000, 19_999) and time.time() - began < 60


def test_pairs_by_rarest_numbers():
    rng = np.random.default_rng(1)
    for _ in range(150):
        base, sets = rng.choice(200, rng.integers(1, 30), False), []
        for _ in range(rng.integers(2, 25)):
            x = set(base.tolist()) if rng.random() < 0.8 else set()
            for _ in range(rng.integers(0, 5)):
                x.discard(int(rng.integers(0, 200)))
                x.add(int(rng.integers(0, 300)))
            sets.append(x or {1})
        raw = np.empty(len(sets), object)
        raw[:] = [np.array(sorted(x), np.uint32).tobytes() for x in sets]
        label = rng.integers(0, 4, len(sets))
        items = np.flatnonzero(label != np.bincount(label).argmax())
        a, b = alike_pairs(raw, label, items, 0.8)
        want = {(i, j) for i in range(len(sets)) for j in range(i) if label[i] != label[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
        assert {(max(x, y), min(x, y)) for x, y in zip(a.tolist(), b.tolist())} == want and len(a) == len(want)


def test_white_space_of_several_bytes():
    """Each byte of a white space, and no other, also where a text ends inside one."""
    rng = random.Random(4)
    signs = ["a", " ", "\n", "\x85", "\xa0", "\u1680", "\u2000", "\u200a", "\u200b", "\u2028", "\u2029", "\u202f", "\u205f", "\u3000", "\u3001", "\u304b", "\xe9"]
    for n in [*range(6)] * 20 + [2000]:
        text = "".join(rng.choice(signs) for _ in range(n))
        data = np.frombuffer(text.encode(), np.uint8)
        want = [c.isspace() for c in text for _ in c.encode()]
        assert pieces.white(data).tolist() == want
        for cut in (1, 2):  # the bytes of a last sign that isn't whole are no white space of several bytes
            part = data[: max(0, len(data) - cut)]
            whole = part.tobytes().decode(errors="ignore")
            assert pieces.white(part).tolist()[: len(whole.encode())] == want[: len(whole.encode())]
