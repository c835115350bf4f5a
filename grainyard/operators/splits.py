"""Splits, first-by and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sha1_hex, sha1_int


def hash_split(key: Column, validation: int = 5, testing: int = 5, mod: int = 1000) -> Column:
    """validation and testing get that many of `mod` buckets of the key's hash, training the rest."""
    b = F.pmod(sha1_int(key), F.lit(mod))
    return F.when(b < validation, "validation").when(b < validation + testing, "testing").otherwise("training")


def group_split(group: Column, train: float = 0.96, validation: float = 0.02) -> Column:
    """By group, so that a group is never cut; cut-offs are truncated from the same floating-point terms as in the reference data."""
    if not 0 < train < 1 or not 0 <= validation < 1 or train + validation >= 1:
        raise ValueError("fractions must be in (0, 1) and leave some testing")
    first, second = int(validation * 1000), int((validation + (1 - train - validation)) * 1000)
    return hash_split(group, first, second - first)


def repair_empty(df: DataFrame, order: list[str], need: int = 2) -> DataFrame:
    """If no row is validation (then testing), the last training row in `order` becomes it, while at least `need` are left."""
    for name in ("validation", "testing"):
        counts = df.agg(F.count_if(F.col("split") == name).alias("own"), F.count_if(F.col("split") == "training").alias("train")).first()
        if counts.own == 0 and counts.train >= need:
            last = df.where("split = 'training'").orderBy(*[F.desc(c) for c in order]).limit(1).select(*[F.col(c).alias(f"_{c}") for c in order])
            same = F.lit(True)
            for c in order:
                same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
            df = df.join(F.broadcast(last), same, "left").withColumn("split", F.when(F.col(f"_{order[0]}").isNotNull(), name).otherwise(F.col("split"))).drop(*[f"_{c}" for c in order])
    return df


def modulo_split(index: Column, n: int = 10) -> Column:
    """The last two of each n rows are validation and testing."""
    m = F.pmod(index, F.lit(n))
    return F.when(m == n - 2, "validation").when(m == n - 1, "testing").otherwise("training")


def first_by(df: DataFrame, key: Column, order: str) -> DataFrame:
    """Of each key the row that is first in order, with the number of rows; partial aggregation, the same on every run."""
    return df.groupBy(F.sha2(key.cast("binary"), 256).alias("_key")).agg(F.min_by(F.struct("*"), order).alias("_row"), F.count("*").alias("copies")).select("_row.*", "copies")


def cap(df: DataFrame, category: str, id_col: str, per_category: int, total: int, first: Column | None = None) -> DataFrame:
    """At most per_category rows of each category and then at most total, in the order of the ids' hashes, rows
    where `first` is true before all others; 0: no cap."""
    late = F.lit(1) if first is None else F.when(first, 0).otherwise(1)
    df = df.withColumn("_h", F.struct(late.alias("late"), sha1_hex(F.col(id_col).cast("string")).alias("hash")))
    if per_category:
        df = df.withColumn("_k", F.row_number().over(Window.partitionBy(category).orderBy("_h"))).where(F.col("_k") <= per_category).drop("_k")
    if total:
        df = df.orderBy("_h").limit(total)
    return df.drop("_h")
