"""Phrase collocations by SON partitioning: shards are mined at a lowered support, then all candidates are counted exactly.

A phrase that comes `support` times in a language comes, in at least one of its SHARDS shards, as often as the shard's part of the
language's words asks for. Shards are mined for one width of phrases after another, from hashes of phrases alone: tasks count the
hashes of what they read, and these are summed by shard and range of hashes. Two phrases of one hash are counted as one,
so no candidate is lost, and a phrase whose first or last words aren't candidates of the width before is left out. The shards' candidates
are united, but for those that miss the support even if every shard where they fell short had just one place too few of them. A bit
array of bounded size knows all candidates and few others; the phrases that it knows are counted by their own words over
the whole input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, broadcast_if_small, byte_table, mixed, slices, text_bytes, word_spans, written

#: Shards that a language is cut into, by the hash of the texts. More of them lower the support in each.
SHARDS = 4
#: Bytes of hashes that a range of a language has in one task, about.
RANGE_BYTES = 8 << 20
#: Bytes that the bit array of candidates has at most; beyond, it lets more phrases through to the exact count.
MOST_BYTES = 64 << 20
#: Bytes of text that a task counts at a time.
SLICE = 1 << 22
SEGMENTS = 256
_ODD = np.random.default_rng(12).integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
LOWER, WORD_GAP = byte_table(b" \t.,;:!?\n\x0b\x0c\r")
_PIECE_GAP = byte_table(b".,;:!?\n\x0b\x0c\r")[1]


class Words:
    """The words of a slice: code (a number for each word), names (what they stand for, binary), row, and piece (never falls, differs
    between pieces)."""

    def __init__(self, column: pa.Array):
        data, offsets = text_bytes(column)
        lowered = np.ascontiguousarray(LOWER[data])
        starts, ends, first = word_spans(data, offsets, WORD_GAP)
        edges = np.zeros(2 * len(starts) + 2, np.int64)
        edges[1:-1:2], edges[2:-1:2], edges[-1] = starts, ends, len(data)
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(lowered)]).dictionary_encode()
        self.code, self.names = found.indices.to_numpy()[1::2].astype(np.int64), found.dictionary
        self.row = np.repeat(np.arange(len(column)), np.diff(first))
        self.piece = np.r_[0, np.cumsum(_PIECE_GAP[data], dtype=np.int32)][starts] + self.row

    def phrases(self, width: int) -> np.ndarray:
        """Where phrases of so many words begin."""
        n = max(0, len(self.code) - width + 1)
        return np.flatnonzero((self.piece[:n] == self.piece[width - 1 :][:n]) & (self.row[:n] == self.row[width - 1 :][:n]))

    def word_hashes(self) -> np.ndarray:
        """A hash of each name."""
        return np.array([xxhash.xxh64_intdigest(w) for w in self.names.to_pylist()], np.uint64)


def lang_hash(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode(), 1)


def phrase_hashes(start: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """Hashes of phrases: start is their languages' hashes, words the hashes of their first words, second words, ..."""
    h = start.copy()
    for k, w in enumerate(words):
        h += w * _ODD[k]
    return mixed(h)


class Known:
    """A set of hashes as a bit array in SEGMENTS parts: finds all of them, and few others."""

    def __init__(self, bits: np.ndarray, segment: int, probes: int):
        self.bits, self.segment, self.probes = bits, segment, probes

    @staticmethod
    def places(h: np.ndarray, segment: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each hash's part, its first bit in it, and the step to the next one."""
        v = mixed(h)
        return (v >> np.uint64(56)).astype(np.int64), (v & np.uint64(segment - 1)).astype(np.int64), (v >> np.uint64(32) & np.uint64(segment - 1) | np.uint64(1)).astype(np.int64)

    def has(self, h: np.ndarray) -> np.ndarray:
        """The places of the hashes that are in it."""
        found = np.arange(len(h))
        part, bit, step = self.places(h, self.segment)
        for _ in range(self.probes):
            at = part * self.segment + bit
            hit = (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            found, part, bit, step = found[hit], part[hit], bit[hit], step[hit]
            bit = bit + step & self.segment - 1
        return found


def known_of(hashes: DataFrame, most: int) -> Known:
    """The set of a written table (h), built by parts in tasks; `most` bytes at most reach the driver."""
    n = max(1, hashes.count())
    segment = 1 << max(6, min(int(np.log2(max(64, 16 * n / SEGMENTS))) + 1, int(np.log2(most * 8 // SEGMENTS))))
    probes = int(max(1, min(6, round(0.69 * segment * SEGMENTS / n))))
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(Known.places(h, segment)[0]), b.column(0)], ["part", "h"])

    def build(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(segment, np.uint8)
        for b in batches:
            h = b.column("h").to_numpy().view(np.uint64)
            _, bit, step = Known.places(h, segment)
            for k in range(probes):
                bits[bit + k * step & segment - 1] = 1
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["part", "bits"])

    made = arrow_map(hashes, parts, "part bigint, h bigint").groupBy("part").applyInArrow(build, "part bigint, bits binary")
    bits = np.zeros(segment * SEGMENTS // 8, np.uint8)
    for r in made.collect():  # SEGMENTS rows, `most` bytes at most
        bits[r.part * segment // 8 : (r.part + 1) * segment // 8] = np.frombuffer(r.bits, np.uint8)
    return Known(bits, segment, probes)


def _texts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    text = F.make_valid_utf8(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    shard = F.pmod(F.xxhash64(text), F.lit(SHARDS)).cast("int")
    return docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), shard.alias("shard"), text.alias("text"))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, np.ndarray, list[str], np.ndarray]]:
    """Of each slice its words, the number of each word's language, the languages' names, and each word's shard."""
    for batch in batches:
        for part in slices(batch, 2, SLICE):
            words, langs = Words(part.column(2)), part.column(0).dictionary_encode()
            yield words, langs.indices.to_numpy().astype(np.int64)[words.row], langs.dictionary.to_pylist(), part.column(1).to_numpy()[words.row].astype(np.int64)


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, shard, word, n), summed by what one task reads at a time: a row a word with null shard, and a row a shard with null word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, lang, langs, shard in _slices(batches):
            key, n = np.unique(lang * len(words.names) + words.code, return_counts=True)
            names = words.names.take(pa.array(key % max(len(words.names), 1))).cast(pa.large_string()).cast(pa.string())
            of = pa.array(langs, pa.string()).take(pa.array(key // max(len(words.names), 1)))
            yield pa.RecordBatch.from_arrays([of, pa.nulls(len(key), pa.int32()), names, pa.array(n)], ["lang", "shard", "word", "n"])
            key, n = np.unique(lang * SHARDS + shard, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()).take(pa.array(key // SHARDS)), pa.array((key % SHARDS).astype(np.int32)), pa.nulls(len(key), pa.string()), pa.array(n)], ["lang", "shard", "word", "n"])

    return arrow_map(texts, run, "lang string, shard int, word string, n bigint").groupBy("lang", "shard", "word").agg(F.sum("n").alias("n"))


def _candidates(words: Words, lang: np.ndarray, langs: list[str], width: int, known: Known, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the phrases of this width whose first and last words, without one, are known; and the phrases' hashes."""
    inner, hashes = known_phrases(words, lang, langs, width - 1, known, ranges)
    flag = np.zeros(len(words.code) + 1, bool)
    flag[inner] = True
    at = words.phrases(width)
    at = at[flag[at] & flag[at + 1]]
    return at, phrase_hashes(hashes[0][at], [hashes[1][at + k] for k in range(width)])


def known_phrases(words: Words, lang: np.ndarray, langs: list[str], width: int, known: Known, ranges: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Places of the phrases of this width that are known; and of each word its language's hash and its own."""
    h, start = words.word_hashes()[words.code], np.array([lang_hash(x) for x in langs], np.uint64)[lang]
    at = words.phrases(width)
    return at[known.has(cut(phrase_hashes(start[at], [h[at + k] for k in range(width)]), ranges))], (start, h)


def cut(h: np.ndarray, ranges: int) -> np.ndarray:
    """The part of hashes that mining tells apart: 32 bits in each of 2 ** ranges ranges."""
    return h >> np.uint64(32 - ranges)


def mined(texts: DataFrame, width: int, known: Known, least: DataFrame, support: int, ranges: int) -> DataFrame:
    """(h): hashes of all phrases of this width that reach a shard's support in a shard of their language, but for those that can't reach
    `support` in all. least: (lang, least), an array of each shard's support."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, lang, langs, shard in _slices(batches):
            at, h = _candidates(words, lang, langs, width, known, ranges)
            group = lang[at] * SHARDS + shard[at]
            order = np.argsort(group, kind="stable")
            edges = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0, True]) if len(at) else np.zeros(1, np.int64)
            for a, b in zip(edges.tolist(), edges[1:].tolist()):
                g = int(group[order[a]])
                found, n = np.unique(cut(h[order[a:b]], ranges), return_counts=True)
                rest = (found & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                spots = np.searchsorted(found, np.arange((1 << ranges) + 1, dtype=np.uint64) << np.uint64(32))
                rows = [(r, x, y) for r, (x, y) in enumerate(zip(spots.tolist(), spots[1:].tolist())) if y > x]
                once = [rest[x:y][n[x:y] == 1].tobytes() for _, x, y in rows]
                more = [np.stack([rest[x:y], n[x:y].astype(np.uint32)])[:, n[x:y] > 1].tobytes() for _, x, y in rows]
                yield pa.RecordBatch.from_arrays([pa.array([langs[g // SHARDS]] * len(rows), pa.string()), pa.array([g % SHARDS] * len(rows), pa.int32()), pa.array([r for r, _, _ in rows], pa.int64()), pa.array(once, pa.binary()), pa.array(more, pa.binary())], ["lang", "shard", "range", "once", "more"])

    def merge(table: pa.Table) -> pa.Table:
        least = np.array(table["least"][0].as_py(), np.int64)
        shard, h, n = [], [], []
        for s, once, more in zip(table["shard"].to_pylist(), table["once"].to_pylist(), table["more"].to_pylist()):
            pairs = np.frombuffer(more, np.uint32).reshape(2, -1)
            h += [np.frombuffer(once, np.uint32), pairs[0]]
            n += [np.ones(len(once) // 4, np.uint32), pairs[1]]
            shard.append(np.full(len(once) // 4 + pairs.shape[1], s, np.uint64))
        key = np.concatenate(h).astype(np.uint64) << np.uint64(32) | np.concatenate(shard)
        order = np.argsort(key)
        key, n = key[order], np.concatenate(n).astype(np.int64)[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        n, own, h = np.add.reduceat(n, first), least[(key[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)], key[first] >> np.uint64(32)
        h, n, own = (x[n >= own] for x in (h, n, own))  # what the shards find
        if not len(h):
            return pa.table({"h": pa.array([], pa.int64())})
        edge = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        most = np.add.reduceat(n - own + 1, edge) + (least - 1)[least > 0].sum()
        return pa.table({"h": (np.uint64(table["range"][0].as_py()) << np.uint64(32) | h[edge[most >= support]]).view(np.int64)})

    parts = arrow_map(texts, count, "lang string, shard int, range bigint, once binary, more binary")
    return parts.join(broadcast_if_small(least), "lang").groupBy("lang", "range").applyInArrow(merge, "h bigint")


def counted(codes: list[np.ndarray], lang: np.ndarray, names: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The distinct phrases of words' numbers, below `names`, in a language: their words, language and how often each comes."""
    if (int(lang.max()) + 1) * names ** len(codes) < 1 << 63:  # a phrase is one number
        key = lang
        for c in codes:
            key = key * names + c
        key, n = np.unique(key, return_counts=True)
        spelled = []
        for _ in codes:
            key, last = np.divmod(key, names)
            spelled.insert(0, last)
        return spelled, key, n
    key = lang
    for c in codes:
        key = np.unique(key * names + c, return_inverse=True)[1]
    _, one, n = np.unique(key, return_index=True, return_counts=True)
    return [c[one] for c in codes], lang[one], n


def phrase_counts(texts: DataFrame, known: list[Known], ranges: int) -> DataFrame:
    """(lang, phrase, f) of the phrases of 2, 3, ... words that are in the sets of their width; known: of width 1, 2, ..."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, lang, langs, _ in _slices(batches):
            for width in range(2, len(known) + 1):
                at, _ = known_phrases(words, lang, langs, width, known[width - 1], ranges)
                if not len(at):
                    continue
                spelled, own, n = counted([words.code[at + k] for k in range(width)], lang[at], len(words.names))
                text = pc.binary_join_element_wise(*(words.names.take(pa.array(c)) for c in spelled), pa.scalar(b" ", pa.large_binary()))
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()).take(pa.array(own)), text.cast(pa.large_string()).cast(pa.string()), pa.array(n)], ["lang", "phrase", "f"])

    return arrow_map(texts, run, "lang string, phrase string, f bigint").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def hashed_words(words: DataFrame, ranges: int) -> DataFrame:
    """(h) of (lang, word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start = np.array([lang_hash(x) for x in b.column(0).to_pylist()], np.uint64)
            own = np.array([xxhash.xxh64_intdigest(x.encode()) for x in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(cut(phrase_hashes(start, [own]), ranges).view(np.int64))], ["h"])

    return arrow_map(words.select("lang", "word"), run, "h bigint")


def frequent_phrases(docs: DataFrame, most_words: int = 3, support: int = 10, lang_col: str = "lang", text_col: str = "text", most_bytes: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """Two written tables: (lang, phrase, f) of all phrases of 1 to most_words words that come at least `support` times in a language, and
    (lang, n), its number of words."""
    texts = _texts(docs, lang_col, text_col)
    counts = written(word_counts(texts), "words")
    shards = counts.where("word IS NULL").select("lang", "shard", F.col("n").alias("own"))
    totals = written(shards.groupBy("lang").agg(F.sum("own").alias("n")), "totals")
    own = F.expr(f"cast((cast({support} AS decimal(10, 0)) * own + n - 1) div n AS bigint)")
    each = shards.join(broadcast_if_small(totals), "lang").groupBy("lang").agg(*[F.coalesce(F.max(F.when(F.col("shard") == i, own)), F.lit(0)).alias(f"s{i}") for i in range(SHARDS)])
    least = written(each.select("lang", F.array(*[f"s{i}" for i in range(SHARDS)]).alias("least")), "least")
    words = counts.where((F.col("n") >= support) & F.col("word").isNotNull())
    largest = shards.agg(F.max("own")).first()[0] or 0
    ranges = int(min(24, max(0, np.ceil(np.log2(max(1, 4 * SHARDS * largest / RANGE_BYTES))))))
    known = [known_of(written(hashed_words(words, ranges), "known"), most_bytes)]
    for width in range(2, most_words + 1):
        known.append(known_of(written(mined(texts, width, known[-1], least, support, ranges), "mined"), most_bytes))
    longer = phrase_counts(texts, known, ranges).where(F.col("f") >= support)
    both = words.select("lang", F.col("word").alias("phrase"), F.col("n").alias("f")).unionByName(longer)
    return written(both, "phrases"), totals


def score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)) of columns of whole numbers under 10 ** 15, exact; larger ones are an error."""
    d = lambda c: f"cast({c} AS decimal(15, 0))"
    return F.expr(f"(cast(1000000 AS decimal(7, 0)) * {d(a)} * {d(a)}) div ({d(left)} * {d(right)})")


def scored(grams: DataFrame) -> DataFrame:
    """(lang, phrase, a, width, score, l, r) of the phrases (lang, phrase, f) of two words or more, by the cut of lowest score, the first
    of several. Every part of a phrase is a phrase of the table, as it comes at least as often."""
    words = F.split("phrase", " ")
    longer = grams.select("lang", "phrase", F.col("f").alias("a"), words.alias("w"), F.size(words).alias("width")).where("width > 1")
    cuts = longer.select("lang", "phrase", "a", "width", F.explode(F.sequence(F.lit(1), F.col("width") - 1)).alias("k"), "w")
    part = lambda at, n: F.array_join(F.slice("w", at, n), " ")
    cuts = cuts.select("lang", "phrase", "a", "width", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("width") - F.col("k")).alias("right"))
    known = broadcast_if_small(grams, 128)
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    best = F.min(F.struct(score("a", "l", "r").alias("score"), "k", "l", "r")).alias("best")
    return cuts.groupBy("lang", "phrase", "a", "width").agg(best).select("lang", "phrase", "a", "width", "best.score", "best.l", "best.r")


def inside(grams: DataFrame) -> DataFrame:
    """(lang, phrase, most): phrases of two words or more inside longer ones of the table, with the largest count of these."""
    words = F.split("phrase", " ")
    longer = grams.select("lang", "f", words.alias("w"), F.size(words).alias("width")).where("width > 2")
    sized = longer.select("lang", "f", "w", "width", F.explode(F.sequence(F.lit(2), F.col("width") - 1)).alias("n"))
    each = sized.select("lang", "f", "w", "n", F.explode(F.sequence(F.lit(1), F.col("width") - F.col("n") + 1)).alias("at"))
    return each.groupBy("lang", F.array_join(F.slice("w", F.col("at"), F.col("n")), " ").alias("phrase")).agg(F.max("f").alias("most"))


def collocations(docs: DataFrame, most_words: int = 3, support: int = 10, share: int = 50, first: int = 2000, lang_col: str = "lang", text_col: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each language the `first` phrases of 2 to most_words words by score, then a, both
    descending, then the phrase's bytes.

    Letters A-Z become small, texts fall into pieces at . , ; : ! ? and the bytes 10 to 13, and pieces into words at space and tab. a is how
    often a phrase comes, at least `support` times; n the language's words. A phrase cut in two has parts that come l and r
    times and the score floor(1000000 * a * a / (l * r)); the cut of lowest score counts, the first of several. A phrase inside a longer
    one that comes in at least share % of its places is left out. Nulls: a null text counts as empty, a null language as `und`. Bytes
    that aren't UTF-8 count as the replacement character. Repeated rows count as often as they come; other columns are not read,
    whatever their names. An empty table gives an empty one. Texts of any length count whole.
    """
    grams, totals = frequent_phrases(docs, most_words, support, lang_col, text_col, most_bytes)
    told = scored(grams).join(inside(grams), ["lang", "phrase"], "left").where(F.coalesce(F.col("most") * 100 < F.col("a") * share, F.lit(True)))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # first in parts of a language, so that none is ranked whole in one task
    parts = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    some = told.withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= first)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= first)
    return ranked.join(broadcast_if_small(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The same of the table documents with the defaults, by counting all phrases.
PHRASE_SQL = f"""WITH pieces AS (SELECT doc_id, lang, generate_subscripts(p, 1) AS piece, unnest(p) AS words FROM (
SELECT row_number() OVER () AS doc_id, coalesce(lang, 'und') AS lang, regexp_split_to_array({_LOWERED}, '[.,;:!?\\x0A-\\x0D]') AS p FROM documents)),
words AS (SELECT doc_id, lang, piece, generate_subscripts(w, 1) AS place, unnest(w) AS word FROM (SELECT doc_id, lang, piece, regexp_extract_all(words, '[^\\x20\\x09]+') AS w FROM pieces)),
three AS (SELECT lang, word AS x, lead(word) OVER p AS y, lead(word, 2) OVER p AS z FROM words WINDOW p AS (PARTITION BY doc_id, piece ORDER BY place)),
f1 AS (SELECT lang, x, count(*) AS f FROM three GROUP BY ALL),
f2 AS (SELECT lang, x, y, count(*) AS f FROM three WHERE y IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, x, y, z, count(*) AS f FROM three WHERE z IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
cuts AS (SELECT f2.lang, f2.x || ' ' || f2.y AS phrase, f2.f AS a, 1 AS k, u.f AS l, v.f AS r FROM f2 JOIN f1 u ON u.lang = f2.lang AND u.x = f2.x JOIN f1 v ON v.lang = f2.lang AND v.x = f2.y
UNION ALL SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z, f3.f, 1, u.f, v.f FROM f3 JOIN f1 u ON u.lang = f3.lang AND u.x = f3.x JOIN f2 v ON v.lang = f3.lang AND v.x = f3.y AND v.y = f3.z
UNION ALL SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z, f3.f, 2, u.f, v.f FROM f3 JOIN f2 u ON u.lang = f3.lang AND u.x = f3.x AND u.y = f3.y JOIN f1 v ON v.lang = f3.lang AND v.x = f3.z),
scores AS (SELECT lang, phrase, a, k, l, r, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, phrase, max(f) AS f FROM (SELECT lang, x || ' ' || y AS phrase, f FROM f3 UNION ALL SELECT lang, y || ' ' || z, f FROM f3) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.f IS NULL OR 100 * o.f < 50 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""
