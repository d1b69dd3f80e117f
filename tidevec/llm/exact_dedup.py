"""Exact deduplication by skew-safe combining, on DataFrame operations alone.

Copies are merged in three steps, each of which groups on the full text beside its digest:
within the input partition (the map side of the first aggregation), within a salted share of the
digest, and last among the salt winners of a digest. A group of any size thus reaches its last
task as at most ``salts`` rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise
from .skew import salted_join


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def text_winners(keyed: DataFrame, salts: int) -> DataFrame:
    """(_digest, _text, _keep, _size): one row per different text. ``keyed`` has _id, _text, _digest."""
    salted = (
        keyed.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("_digest", "_salt", "_text")
        .agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
    )
    return salted.repartition("_digest").groupBy("_digest", "_text").agg(F.max("_keep").alias("_keep"), F.sum("_size").alias("_size"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest: Callable[[Column], Column] = sha256_hex, normalise: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """One row per row of ``df``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after ``normalise``; the row with the largest id stays. A null text
    counts as empty and groups with empty texts. A null id never wins over another; in a group of null
    ids alone keep_id is null and its rows are kept. Rows that repeat an id and its text count once each
    in group_size and share their decision. An empty table gives an empty result. Other columns of
    ``df`` are ignored, whatever their names.

    Digests only route rows. That each digest stands for one text is checked on the full texts; the
    rows of any digest for which it does not hold are joined by text.
    """
    text = normalise(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    keyed = df.select(F.col(f"`{id_col}`").alias("_id"), text.alias("_text")).withColumn("_digest", digest(F.col("_text")))
    by_digest = materialise(
        text_winners(keyed, salts).groupBy("_digest").agg(F.max("_keep").alias("keep_id"), F.sum("_size").alias("group_size"), F.count(F.lit(1)).alias("_texts")),
        "exact",
    )
    told = keyed.select("_id", "_digest", sha256_hex(F.col("_text")).alias("text_sha256"))
    found = salted_join(told, by_digest.filter("_texts = 1"), "_digest", "group_size")
    shared = by_digest.filter("_texts > 1").select("_digest")
    if not shared.isEmpty():
        doubtful = keyed.join(shared, "_digest", "left_semi")
        by_text = text_winners(doubtful, salts).select("_digest", "_text", F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"))
        more = doubtful.join(by_text, ["_digest", "_text"]).select("_id", "_digest", sha256_hex(F.col("_text")).alias("text_sha256"), "keep_id", "group_size")
        found = found.drop("_texts").unionByName(more)
    return found.select(
        F.col("_id").alias(id_col),
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )
