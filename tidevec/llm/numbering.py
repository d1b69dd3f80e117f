"""Gapless numbers within classes, without one task per class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialise


def gapless_rank(df: DataFrame, class_col: str, key: Column, order: list[Column], per_bucket: int = 250_000, name: str = "rank") -> DataFrame:
    """Add ``name``: 0, 1, 2, ... within each value of ``class_col`` (few values, any sizes).

    Rows of a class are spread by a hash of ``key`` over as many buckets as make about ``per_bucket`` rows
    each; bucket counts give each bucket its first number, and only a bucket is numbered in one place.
    ``df`` must be a stored table, as it is read three times. Rows equal in ``key`` and ``order`` get
    their numbers in any order.
    """
    sizes = df.groupBy(F.col(class_col).alias("_sized")).agg(F.ceil(F.count(F.lit(1)) / per_bucket).cast("int").alias("_buckets"))  # a row per class
    spread = df.join(F.broadcast(sizes), F.col(class_col).eqNullSafe(F.col("_sized"))).withColumn("_bucket", F.pmod(F.xxhash64(key), F.col("_buckets")).cast("int")).drop("_sized", "_buckets")
    counts = spread.groupBy(class_col, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(class_col).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = materialise(counts.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long"))).drop("_n"), "ranks")
    within = Window.partitionBy(class_col, "_bucket").orderBy(*order)
    numbered = spread.withColumn("_within", F.row_number().over(within).cast("long") - 1)
    joined = numbered.join(first.select(F.col(class_col).alias("_class"), F.col("_bucket").alias("_b"), "_first"), F.col(class_col).eqNullSafe(F.col("_class")) & (F.col("_bucket") == F.col("_b")))
    return joined.withColumn(name, F.col("_within") + F.col("_first")).drop("_bucket", "_within", "_class", "_b", "_first")
