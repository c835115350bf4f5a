"""Mixing sources to target weights by a Pfair schedule.

Each source's rows, in an order by hash, are cut into blocks. With a source's share of q slots in a period of h slots, its
block i (from 0) has release time i * h div q and deadline ceil((i + 1) * h / q); in each slot the released block of earliest
deadline runs, so that after any number of slots every source is less than one block away from its target. The schedule of one
period, a table bounded by parameters, holds for all; a block's slot follows from it by arithmetic, and its first row's position
from the sizes of the blocks before it, summed up by period.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, free_names, written

#: Sources with the same share have the same release times and deadlines, so of these the one with the fewest blocks so far, and of
#: several the first, is due: they take turns. Only one block a share is looked at in a slot.
_SHARES = """
transform(array_sort(array_distinct(transform(src, x -> x.q))), q -> named_struct('q', q, 'who', filter(transform(src, (x, i) -> if(x.q = q, i, null)), i -> i IS NOT NULL)))
"""
#: One period: for each slot the place in src of the source that runs. shares: see _SHARES; c: blocks so far of each. Slots are put
#: together in chunks, so that none of them copies all before it.
_PERIOD = """
aggregate(
  sequence(0L, (h - 1) div 256),
  named_struct('c', transform(shares, x -> 0L), 'run', cast(array() AS array<array<int>>)),
  (a, u) -> element_at(transform(array(aggregate(
      sequence(u * 256, least(h, (u + 1) * 256) - 1),
      named_struct('c', a.c, 'run', cast(array() AS array<int>)),
      (b, t) -> element_at(transform(
        array(array_min(filter(
          transform(shares, (x, j) -> if(b.c[j] div size(x.who) < x.q AND (b.c[j] div size(x.who)) * h div x.q <= t,
            named_struct('d', ((b.c[j] div size(x.who) + 1) * h + x.q - 1) div x.q, 'i', x.who[cast(b.c[j] % size(x.who) AS int)], 'j', j), null)),
          x -> x IS NOT NULL))),
        p -> named_struct('c', transform(b.c, (n, j) -> n + if(j = p.j, 1L, 0L)), 'run', concat(b.run, array(p.i)))), 1))),
    z -> named_struct('c', z.c, 'run', concat(a.run, array(z.run)))), 1),
  a -> flatten(a.run))
"""
#: So many hash ranges of a source at most, in powers of two, and slots of a period at most (one more a source).
MOST_BUCKET_BITS, MOST_RESOLUTION = 20, 100_000


def mixed_sources(docs: DataFrame, weights: dict[str, float] | None = None, block: int = 32, resolution: int = 1000, max_sources: int = 4096, bucket_rows: int = 256, id_col: str = "doc_id", source_col: str = "source", names: tuple[str, str, str] = ("mix_slot", "mix_rank", "mix_position")) -> DataFrame:
    """docs with mix_slot, mix_rank (place in its block) and mix_position (0, 1, ... in the mixed order) as last columns, or as `names`.

    weights: target weights by source; a source that it doesn't name gets the smallest one named. Without it, weights are the square
    roots of the sources' row counts. Shares are rounded to 1 / resolution, one unit at least; the resolution is raised until the
    smallest share is a unit, to MOST_RESOLUTION at most. Every row is kept once: when a source ends, its later slots are left out
    and the others go on in their proportions; until the first source ends, any prefix of whole blocks is less than one block away
    from the rounded target for each source.
    Nulls: a null source is a source of its own, a null id sorts first among equal hashes. Rows of equal id and source may swap
    places. An empty table gives an empty one. Texts aren't looked at, so their length doesn't matter. Other columns stay; columns
    with the names of the new ones are replaced.
    A hot source is numbered in ranges of its hashes, about bucket_rows rows each. More than max_sources sources are an error: the
    period's schedule, a row a slot, is broadcast.
    """
    docs = docs.drop(*names)
    key, h, bucket, n = free_names(docs, "mk", "mh", "mb", "mn")
    bits = min(max(0, docs.count() // bucket_rows).bit_length(), MOST_BUCKET_BITS)
    digest = F.md5(F.concat(F.lit("mix|"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    keyed = docs.withColumns({key: F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")), h: F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")}).withColumn(bucket, F.shiftright(h, 60 - bits) if bits else F.lit(0).cast("bigint"))

    counts = keyed.groupBy(F.col(key).alias("key"), F.col(bucket).alias("bucket")).agg(F.count("*").alias("n"))
    # written, so that their sizes are known and, while they are small, the rows aren't dealt out once more to join them
    before = written(counts.select("key", "bucket", "n", (F.sum("n").over(Window.partitionBy("key").orderBy("bucket")) - F.col("n")).alias("before")), "ranges")
    blocks = written(_blocks(before, _units(before, weights, resolution, max_sources), block), "blocks")

    order = Window.partitionBy(key, bucket).orderBy(h, F.asc_nulls_first(id_col))
    numbered = keyed.withColumn(n, F.row_number().over(order) - 1)
    k, b, more = free_names(numbered, "jk", "jb", "jn")
    placed = numbered.join(broadcast_if_small(before.select("key", "bucket", "before").toDF(k, b, more)), (F.col(key) == F.col(k)) & (F.col(bucket) == F.col(b)))
    placed = placed.withColumn(n, F.col(n) + F.col(more)).drop(k, b, more)
    bk, nth, slot, start = free_names(placed, "bk", "bn", "bs", "bp")
    wide = placed.join(broadcast_if_small(blocks.toDF(bk, nth, slot, start)), (F.col(key) == F.col(bk)) & (F.floor(F.col(n) / block) == F.col(nth)))
    rank = F.pmod(F.col(n), F.lit(block))
    return wide.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(slot).alias(names[0]), rank.cast("int").alias(names[1]), (F.col(start) + rank).alias(names[2]))


def _units(counts: DataFrame, weights: dict[str, float] | None, resolution: int, max_sources: int) -> DataFrame:
    """One row: h, and src, an array of (key, n, q): each source's rows and its slots in a period of h."""
    total = counts.groupBy("key").agg(F.sum("n").alias("n"))
    if weights is None:
        weight = F.sqrt("n")
    else:
        named = F.create_map(*[x for s, w in weights.items() for x in (F.lit("=" + s), F.lit(float(w)))])
        weight = F.coalesce(F.try_element_at(named, F.col("key")), F.lit(float(min(weights.values()))))
    weighted = total.withColumn("w", weight)
    told = weighted.agg(F.sum("w").alias("sum"), F.greatest(F.lit(resolution), F.least(F.ceil(F.sum("w") / F.min("w")), F.lit(MOST_RESOLUTION))).alias("fine"))
    share = F.floor(F.round(F.col("fine") * F.col("w") / F.col("sum"), 6) + 0.5).cast("bigint")
    units = weighted.crossJoin(F.broadcast(told)).withColumn("q", F.greatest(F.lit(1).cast("bigint"), share))  # one row of sums
    listed = units.agg(F.sort_array(F.collect_list(F.struct("key", "n", "q"))).alias("src")).where(F.size("src") > 0)
    bounded = F.when(F.size("src") > max_sources, F.raise_error(F.lit(f"more than {max_sources} sources"))).otherwise(F.col("src"))
    return listed.select(bounded.alias("src")).withColumn("h", F.expr("aggregate(src, 0L, (a, x) -> a + x.q)"))


def _blocks(before: DataFrame, units: DataFrame, block: int) -> DataFrame:
    """(key, nth, slot, start) of each block: its slot, and how many rows the blocks of earlier slots have."""
    slots = units.withColumn("shares", F.expr(_SHARES)).select("src", "h", F.posexplode(F.expr(_PERIOD)).alias("t", "i")).select(F.col("src")[F.col("i")].alias("s"), "h", "t").select("s.*", "h", "t")
    slots = slots.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy("t")) - 1).withColumnRenamed("n", "total")
    shares = slots.where("k = 0").select("key", "total", "q")
    # a block belongs to the range of hashes that holds its first row
    first, past = F.ceil(F.col("before") / block), F.ceil((F.col("before") + F.col("n")) / block)
    own = before.where(first < past).select("key", F.explode(F.sequence(first, past - 1)).alias("nth")).join(F.broadcast(shares), "key")
    own = own.select("key", "nth", F.least(F.lit(block), F.col("total") - F.col("nth") * block).alias("size"), F.floor(F.col("nth") / F.col("q")).alias("cycle"), F.pmod("nth", "q").alias("k"))
    dealt = own.join(F.broadcast(slots.select("key", "k", "h", "t")), ["key", "k"])
    cycles = dealt.groupBy("cycle").agg(F.sum("size").alias("sum"))  # a row a period
    earlier = cycles.select("cycle", (F.sum("sum").over(Window.orderBy("cycle")) - F.col("sum")).alias("earlier"))
    inside = F.sum("size").over(Window.partitionBy("cycle").orderBy("t")) - F.col("size")  # a period's slots
    return dealt.withColumn("inside", inside).join(earlier, "cycle").select("key", "nth", (F.col("cycle") * F.col("h") + F.col("t")).alias("slot"), (F.col("earlier") + F.col("inside")).alias("start"))


MIX_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS sk, substr(md5('mix|' || coalesce(doc_id::varchar, '')), 1, 15) AS h FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY sk ORDER BY h, doc_id NULLS FIRST) - 1 AS n FROM d),
s AS (SELECT sk, count(*) AS n FROM d GROUP BY sk),
u AS (SELECT sk, n, greatest(1, floor(round(greatest(1000, least(ceil(sum(sqrt(n)) OVER () / min(sqrt(n)) OVER ()), 100000)) * sqrt(n) / sum(sqrt(n)) OVER (), 6) + 0.5)::bigint) AS q, row_number() OVER (ORDER BY sk) AS i FROM s),
l AS (SELECT list(q ORDER BY i) AS q, list(n ORDER BY i) AS n, sum(q)::bigint AS h FROM u),
e AS (
  SELECT 0::bigint AS t, NULL::bigint AS p, list_transform(q, lambda x: 0::bigint) AS c, list_transform(q, lambda x: 0::bigint) AS was FROM l
  UNION ALL
  SELECT t + 1, pick, list_transform(c, lambda x, j: x + CASE WHEN j = pick THEN 1 ELSE 0 END), c
  FROM (SELECT t, c, list_min(list_filter(list_transform(range(1, len(q) + 1), lambda i: CASE WHEN c[i] < q[i] AND (c[i] * h) // q[i] <= t
          THEN (((c[i] + 1) * h + q[i] - 1) // q[i]) * 100000 + i END), lambda x: x IS NOT NULL)) % 100000 AS pick FROM e, l WHERE t < h)),
w AS (SELECT u.sk, u.q, e.t - 1 AS t, e.was[e.p] AS k, e.was AS c FROM e JOIN u ON u.i = e.p WHERE e.p IS NOT NULL),
b AS (SELECT r.doc_id, r.source, r.n % 32 AS rank, w.t, w.c, (r.n // 32) // u.q AS cycle
  FROM r JOIN u ON r.sk = u.sk JOIN w ON w.sk = r.sk AND w.k = (r.n // 32) % u.q)
SELECT doc_id, source, cycle * l.h + t AS mix_slot, rank::int AS mix_rank,
  (list_sum(list_transform(range(1, len(l.q) + 1), lambda i: least(l.n[i], (cycle * l.q[i] + c[i]) * 32))) + rank)::bigint AS mix_position
FROM b, l
"""
