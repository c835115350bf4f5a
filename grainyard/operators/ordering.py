"""Global order without a global sort in one task: rows are dealt by ranges, sorted in them and numbered; small sums a range do the rest."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import free_names
from ..sources.work import saved

_AT = 33  # bits of a row's number inside its range, as monotonically_increasing_id has it


def in_order(df: DataFrame, order: Sequence[str], ties: Sequence[str] = (), name: str = "rank", value: Column | None = None, running: str = "running", rows: int = 0) -> DataFrame:
    """df with each row's place from 1 in the order of the columns `order`, then `ties`, as column `name`; with a value, also the sum of
    value (null: 0) over all rows up to this one, as column `running`. The result is a written table.

    Null comes first. Rows that are equal in order and ties follow each other by a hash of all their columns, so the order is the same on
    every run; rows that are equal in all columns are interchangeable. Rows are dealt by ranges of the whole order, that hash, and
    the task they come from, so that one number, or one row, that comes very often fills several ranges. df is evaluated twice, first
    for the ranges' bounds: save it if it is costly. rows: about so many rows a range, for which they are counted (0: as many ranges as
    spark.sql.shuffle.partitions has). Other columns are kept, whatever their names. Empty: empty.
    """
    mark, salt, at, of, own, more = free_names(df, "mark", "salt", "at", "of", "own", "more")
    plain = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() or "variant" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema]
    keys = [*(F.col(f"`{c}`") for c in (*order, *ties)), F.col(mark)]
    dealt = df.withColumns({mark: F.xxhash64(*plain), salt: F.spark_partition_id()})
    parts = (max(1, -(-df.count() // rows)),) if rows else ()
    dealt = dealt.repartitionByRange(*parts, *keys, F.col(salt)).sortWithinPartitions(*keys)
    dealt = dealt.withColumn(at, F.monotonically_increasing_id()).drop(mark, salt)
    if value is not None:
        dealt = _running(dealt.withColumn(own, F.coalesce(value.cast("bigint"), F.lit(0))), own)
    table = saved(dealt, "ordered")
    part = F.shiftright(at, _AT)
    sums = table.groupBy(part.alias(of)).agg(F.count("*").alias("n"), *([F.max_by(own, at).alias("v")] if value is not None else []))
    before = Window.orderBy(of).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = sums.select(of, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c2) for c, c2 in [("n", more), *([("v", f"{more}_v")] if value is not None else [])]])
    placed = table.join(F.broadcast(offsets), part == F.col(of))
    out = {name: F.col(more) + F.col(at).bitwiseAND((1 << _AT) - 1) + 1}
    if value is not None:
        out[running] = F.col(own) + F.col(f"{more}_v")
    return placed.select(*[F.col(f"`{c}`") for c in df.columns if c not in out], *[c.alias(n) for n, c in out.items()])


def _running(df: DataFrame, column: str) -> DataFrame:
    """df with the column's sums over the rows of each task, in their order."""
    i = df.columns.index(column)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            own = before + np.cumsum(batch.column(i).to_numpy(zero_copy_only=False))
            if len(own):
                before = int(own[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:i], pa.array(own, pa.int64()), *batch.columns[i + 1 :]], names=batch.schema.names)

    return df.mapInArrow(sums, df.schema)


def even_buckets(df: DataFrame, order: str, name: str = "_even", rows: int = 1 << 16, most: int = 4096) -> DataFrame:
    """df with a bucket that never falls as the numeric column `order` rises, about `rows` rows each, whatever gaps the numbers have:
    ranges between their quantiles, `most` at most. Null comes first. Rows of one number share a bucket."""
    n = df.count()
    parts = min(most, -(-n // rows))
    if parts < 2:
        return df.withColumn(name, F.lit(0.0))
    bounds = df.select(F.percentile_approx(F.col(order).cast("double"), [i / parts for i in range(1, parts)], 20 * parts)).first()[0]
    cuts = [float("-inf"), *sorted(set(bounds or [])), float("inf")]
    place = F.coalesce(F.col(order).cast("double"), F.lit(float("-inf")))
    return Bucketizer(splits=cuts, inputCol=f"{name}_at", outputCol=name).transform(df.withColumn(f"{name}_at", place)).drop(f"{name}_at")


def prefix_sum(df: DataFrame, bucket: Column, order: list[str], value: Column, name: str = "running") -> DataFrame:
    """df with the sum of `value` over all rows up to this one, row by row. `bucket` must not fall as `order` rises, and `order` must be
    total; a row a bucket is summed in one task, the rows of a bucket in another. For any order and many rows see in_order."""
    b, v, s, bb, before, own = free_names(df, "b", "v", "s", "bb", "before", "own")
    df = df.withColumns({b: bucket, v: value.cast("bigint")})
    sums = df.groupBy(b).agg(F.sum(v).alias(s))
    told = sums.select(F.col(b).alias(bb), (F.sum(s).over(Window.orderBy(b).rowsBetween(Window.unboundedPreceding, 0)) - F.col(s)).alias(before))
    within = F.sum(v).over(Window.partitionBy(b).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(own, within).join(told, F.col(b).eqNullSafe(F.col(bb))).withColumn(name, F.col(own) + F.col(before)).drop(b, v, bb, before, own)


def char_budget(df: DataFrame, order: str, chars: Column, most: int, ties: Sequence[str] = ()) -> DataFrame:
    """The rows, in an order (see in_order), whose characters (each row costs two more) fit the budget, with `running`: a strict prefix. A
    null length counts as 0."""
    rank = free_names(df, "rank")[0]
    return in_order(df, [order], ties, rank, F.coalesce(chars, F.lit(0)) + 2).drop(rank).where(F.col("running") - 2 <= most)


def file_budget(df: DataFrame, file: str, order: str, chars: Column, most: int, ties: Sequence[str] = (), step: int = 1000) -> DataFrame:
    """The rows that fit a budget of characters (each row costs two more) file by file: the first row of a file that doesn't fit ends that
    file only, and the next files take what is left. Files follow each other by the column `file`, rows in each by `order`, then `ties`.

    Whole files and the first cut come from sums by file. What is left then is less than the row that didn't fit, so that of later files
    only first rows that fit it count. A row a file, with the most that its first rows can take of the rest, is looked
    through in order, `step` at a time; one that takes more than is left by then is asked for again.
    """
    rank, left, own, upto, last, cost, before, end = free_names(df, "rank", "left", "own", "upto", "last", "cost", "before", "end")
    rows = in_order(df.withColumn(cost, F.coalesce(chars, F.lit(0)) + 2), [file, order], ties, rank, F.col(cost), own)
    start = F.min_by(F.col(own) - F.col(cost), rank).alias(before)  # names its file too, since every row costs something
    files = saved(rows.groupBy(F.col(f"`{file}`").alias(left)).agg(start, F.max(own).alias(end)), "files")
    rows = rows.join(files, F.col(f"`{file}`").eqNullSafe(F.col(left))).withColumn(upto, F.col(own) - F.col(before) - 2)
    kept = [F.col(f"`{c}`") for c in df.columns]
    over = files.where(F.col(end) - 2 > most).agg(F.min(before)).first()[0]
    if over is None:
        return rows.select(*kept)
    narrow = saved(rows.where(F.col(before) >= over).select(before, upto), "upto")
    cuts, rest, at = {}, most - over, over
    first = narrow.where((F.col(before) == over) & (F.col(upto) <= rest)).agg(F.max(upto)).first()[0]
    if first is not None:
        cuts[over], rest = first, rest - first - 2
    while True:
        fits = narrow.where((F.col(before) > at) & (F.col(upto) <= rest)).groupBy(before).agg(F.max(upto).alias(last))
        found = fits.orderBy(before).limit(step).collect()
        for r in found:
            if r[last] > rest:
                break
            cuts[r[before]], rest, at = r[last], rest - r[last] - 2, r[before]
        else:
            if len(found) < step:
                break
    told = df.sparkSession.createDataFrame(list(cuts.items()), f"`{left}` bigint, `{last}` bigint")  # at most one, and one for each two characters left
    return rows.drop(left).join(F.broadcast(told), F.col(before) == F.col(left), "left").where((F.col(before) < over) | (F.col(upto) <= F.col(last))).select(*kept)


def _three_ways(ranked: DataFrame) -> DataFrame:
    """80/10/10 by `rank`, from 1 without gaps: floors, one at least, the rest is testing. Fewer than 10 rows are an error."""
    n = ranked.agg(F.max("rank")).first()[0] or 0
    if n < 10:
        raise ValueError(f"{n} rows are too few for an exact split")
    first, second = max(1, int(n * 0.8)), max(1, int(n * 0.1))
    return ranked.withColumn("split", F.when(F.col("rank") <= first, "training").when(F.col("rank") <= first + second, "validation").otherwise("testing"))


def rank_split(df: DataFrame, key: str, ties: Sequence[str] = ()) -> DataFrame:
    """Exactly 80/10/10 by rank of a key (see in_order)."""
    return _three_ways(in_order(df, [key], ties))


def order_split(df: DataFrame, order: str, ties: Sequence[str] = ()) -> DataFrame:
    """Exactly 80/10/10 by rank in the order of a column (see in_order)."""
    return _three_ways(in_order(df, [order], ties))
