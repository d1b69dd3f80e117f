"""Per-segment choice between graph and scan, and the merge of both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hnsw import Params, merge_top, search_graphs
from .search import MAX_K, check_k, nearest_batch

EARLY_EXIT = 0.1


def hybrid(vectors: DataFrame, graphs: DataFrame, queries: DataFrame, k: int = 10, params: Params = Params(), early_exit: float | None = None, most: int | None = MAX_K) -> DataFrame:
    """Top k from graphs where segments have one and scans where they don't.

    ``vectors`` has segment_id (null while growing), vid, vec, one version a key. With ``early_exit``,
    queries whose k-th graph distance is that small are not scanned for: faster, and no longer exact.
    """
    check_k(k, most)
    indexed = graphs.select("segment_id").distinct()
    known = search_graphs(graphs, vectors.join(indexed, "segment_id", "left_semi"), queries, k, params, most)
    rest = vectors.join(indexed, "segment_id", "left_anti")
    open_ = queries
    if early_exit is not None:
        done = known.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("worst")).filter((F.col("n") >= k) & (F.col("worst") <= early_exit))
        open_ = queries.join(done, "qid", "left_anti")
    scanned = nearest_batch(rest, open_, k, params.metric, most=most)
    return merge_top(known.select("qid", "vid", "distance").unionByName(scanned.select("qid", "vid", "distance")), k)


def per_segment_top(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine") -> DataFrame:
    """Local top k of every segment_id, then of all: the same as one scan, in one pass."""
    return merge_top(nearest_batch(vectors, queries, k, metric, by_segment=True).select("qid", "vid", "distance"), k)
