"""Joins with keys that hold a large part of all rows, on DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 1000


def salted_join(rows: DataFrame, table: DataFrame, key: str, weight: str, salts: int = 64) -> DataFrame:
    """``rows`` joined with ``table``, which has each ``key`` once and in ``weight`` its number of rows.

    Keys of over 1/1000 of all rows, 1000 of them at most, are told to all tasks; their rows are dealt over
    ``salts`` shares by where they lie, and their row of the table goes to every share.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * SHARE > total
    heavy = table.filter(hot).select(F.col(key).alias("_hot"))
    salt = F.when(F.col("_hot").isNotNull(), F.pmod(F.spark_partition_id(), F.lit(salts))).otherwise(0).alias("_salt")
    dealt = rows.join(F.broadcast(heavy), F.col(key) == F.col("_hot"), "left").select(*[F.col(f"`{c}`") for c in rows.columns], salt)
    shares = table.select("*", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))).alias("_salt"))
    return dealt.join(shares, [key, "_salt"]).drop("_salt")
