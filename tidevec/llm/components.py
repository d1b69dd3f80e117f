"""Connected components of a link table by alternating large and small stars, one stored table a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, materialise


def _state(links: DataFrame) -> tuple:
    r = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node that has a link, with the smallest node of its component.

    Each round hangs every node's larger neighbours, then its smaller ones, on the smallest neighbour
    (large-star, small-star); rounds grow with the logarithm of the components' sizes. Minima are
    combined before the shuffle and star centres reach joins as one row of a side, so a large component
    doesn't gather in a task. Loops and repeated links are ignored.
    """
    pair = links.select(F.greatest(F.col(a), F.col(b)).alias("u"), F.least(F.col(a), F.col(b)).alias("v")).filter("u <> v").distinct()
    now = materialise(pair, "links")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialise(small.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct(), "links")
        before, state = state, _state(after)
        discard(now)
        now = after
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
