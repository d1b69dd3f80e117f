"""Numbers and running totals over a total order, without moving all rows to one task.

Rows are dealt by ranges of the order and stored; each range is totalled where it lies, and the totals
of the ranges before it (one row per range) complete it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialise


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` stored in ranges of ``order``, with its range in ``_range``. Rows that tie share a range."""
    return materialise(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranged")


def running(df: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Add running sums (this row included) of the expressions in ``sums``; ties of ``order`` should not occur."""
    stored = ranged(df, order)
    here = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = stored.groupBy("_range").agg(*[F.sum(e).alias(c) for c, e in sums.items()])
    offsets = totals.select("_range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before_{c}") for c in sums])
    summed = stored.select("*", *[F.coalesce(F.sum(e).over(here), F.lit(0)).alias(f"_{c}_here") for c, e in sums.items()])
    joined = summed.join(F.broadcast(offsets), "_range")  # a row per range, as many as shuffle partitions
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *[(F.col(f"_{c}_here") + F.col(f"_before_{c}")).alias(c) for c in sums])


def numbered(df: DataFrame, order: list[str], name: str = "seq") -> DataFrame:
    """Add ``name``: 1, 2, ... in ``order``."""
    return running(df, order, {name: F.lit(1).cast("long")})


def with_previous(df: DataFrame, order: list[str], of: str, name: str) -> DataFrame:
    """Add ``name``: the value of column ``of`` in the row before, null for the first."""
    stored = ranged(df, order)
    here = Window.partitionBy("_range").orderBy(*order)
    lasts = stored.groupBy("_range").agg(F.max_by(of, F.struct(*order)).alias("_last"))
    carried = lasts.select("_range", F.lag("_last").over(Window.orderBy("_range")).alias("_carried"))
    rows = stored.select("*", F.row_number().over(here).alias("_row"), F.lag(of).over(here).alias("_lag"))
    joined = rows.join(F.broadcast(carried), "_range")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], F.when(F.col("_row") == 1, F.col("_carried")).otherwise(F.col("_lag")).alias(name))
