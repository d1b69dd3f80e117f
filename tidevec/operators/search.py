"""Exact top-k search: one query as an expression, batches of queries as matrix products."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import distance, rounded
from ..scratch import materialise

MAX_K = 20
BLOCK_BYTES = 64 << 20
TILE_NUMBERS = 1 << 21  # distances in memory at once


class VectorError(ValueError):
    """A wrong argument of a vector operation."""


def check_k(k: int, most: int | None = MAX_K) -> int:
    if not isinstance(k, int) or isinstance(k, bool) or k < 1 or (most is not None and k > most):
        raise VectorError(f"k must be an integer from 1 to {most}, not {k!r}")
    return k


def check_vector(vector, dim: int) -> list[float]:
    found = np.asarray(vector, np.float64)
    if found.ndim != 1 or len(found) != dim:
        raise VectorError(f"a vector of {dim} numbers is needed, not one of shape {found.shape}")
    return found.tolist()


def nearest(vectors: DataFrame, query: list[float], k: int = 10, metric: str = "cosine", most: int | None = MAX_K) -> DataFrame:
    """(rank, vid, distance) of the k vectors nearest to one query; ties by vid.

    A heap of k rows per partition, then one of all: nothing else moves.
    """
    check_k(k, most)
    scored = vectors.select("vid", rounded(distance(F.col("vec"), F.array(*[F.lit(float(x)) for x in query]), metric)).alias("distance"))
    top = scored.orderBy("distance", "vid").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("distance", "vid"))).select("rank", "vid", "distance")


def pairwise(queries: np.ndarray, vectors: np.ndarray, metric: str, digits: int = 6) -> np.ndarray:
    """[query, vector] distances, rounded; a vector without length is at cosine distance 1."""
    if metric == "l2":
        found = np.sqrt(np.maximum((queries**2).sum(1)[:, None] + (vectors**2).sum(1)[None] - 2 * queries @ vectors.T, 0))
    elif metric == "ip":
        found = -(queries @ vectors.T)
    elif metric == "cosine":
        unit = [np.divide(m, n, out=np.zeros_like(m), where=n > 0) for m in (queries, vectors) for n in [np.linalg.norm(m, axis=1, keepdims=True)]]
        found = 1 - unit[0] @ unit[1].T
    else:
        raise VectorError(f"unknown metric: {metric!r}")
    return np.round(found, digits) + 0.0


def matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of equal length as float64."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def _keep(qi: np.ndarray, vid: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k by (distance, vid) of each query."""
    order = np.lexsort((vid, d, qi))
    qi, vid, d = qi[order], vid[order], d[order]
    first = np.searchsorted(qi, qi)
    kept = np.arange(len(qi)) - first < k
    return qi[kept], vid[kept], d[kept]


def query_blocks(queries: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[DataFrame]:
    """The queries in blocks of about ``block_bytes`` of numbers; each block is sent to all tasks in turn."""
    total = queries.agg(F.coalesce(F.sum(F.size("qvec")), F.lit(0))).first()[0] * 8
    n = max(1, -(-total // block_bytes))
    return [queries] if n == 1 else [queries.filter(F.pmod(F.xxhash64("qid"), F.lit(n)) == b) for b in range(n)]


def _closest(d: np.ndarray, vid: np.ndarray, first: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vid, distance) of what may be among the k nearest of each row of ``d``, whose queries count from ``first``."""
    at = min(k, d.shape[1]) - 1
    worst = np.partition(d, at, axis=1)[:, at]
    qi, vi = np.nonzero((d <= worst[:, None]) & np.isfinite(d))
    return qi + first, vid[vi], d[qi, vi]


def _block_search(vectors: DataFrame, held: Broadcast, k: int, metric: str, exclude_self: bool, group: bool, eps: float | None, by_segment: bool, early_break: bool) -> DataFrame:
    """(qid, vid, distance) of each task's k nearest for the queries in ``held``; by segment, of each segment's in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, queries, groups = held.value
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        best: dict = {}
        nearest, going = np.full((len(qids), k), np.inf), np.ones(len(qids), bool)
        for batch in batches:
            if not batch.num_rows or not len(qids):
                continue
            every, vecs = batch.column(0).to_numpy(), matrix(batch.column(1))
            own = np.array(batch.column(2).to_pylist()) if groups is not None else None
            segments = batch.column(batch.num_columns - 1).to_pylist() if by_segment else None
            for segment in dict.fromkeys(segments or [None]):
                at = np.flatnonzero([s == segment for s in segments]) if segments else slice(None)
                vid, step = every[at], max(1, TILE_NUMBERS // max(1, len(every[at])))
                now = best.get(segment, empty)
                for first in range(0, len(qids), step):
                    tile = slice(first, first + step)
                    d = pairwise(queries[tile], vecs[at], metric)
                    if exclude_self:
                        d[qids[tile, None] == vid[None, :]] = np.inf
                    if groups is not None:
                        d[groups[tile, None] != own[at][None, :]] = np.inf
                    if eps is not None:
                        d[d > eps] = np.inf
                    if early_break:
                        d[~going[tile]] = np.inf
                        median = np.median(d, axis=1)
                        near = np.partition(np.concatenate((nearest[tile], d), axis=1), k - 1, axis=1)[:, :k]
                        nearest[tile], going[tile] = near, going[tile] & ~(median < near.max(axis=1))
                    now = tuple(np.concatenate(x) for x in zip(now, _closest(d, vid, first, k), strict=True))
                best[segment] = _keep(*now, k)
        for qi, vid, d in best.values():
            yield pa.record_batch([pa.array(qids[qi]), pa.array(vid), pa.array(d)], names=["qid", "vid", "distance"])

    return vectors.select("vid", "vec", *(["vgroup"] if group else []), *(["segment_id"] if by_segment else [])).mapInArrow(run, "qid long, vid long, distance double")


def for_blocks(queries: DataFrame, search: Callable[[Broadcast], DataFrame], group: bool = False) -> DataFrame:
    """``search`` of each block of the queries: (ids, matrix, groups), sent to all tasks. Of several blocks one is held at a time, and its finds are stored."""
    blocks, found, spark = query_blocks(queries), None, queries.sparkSession
    for block in blocks:
        rows = block.select("qid", "qvec", *(["qgroup"] if group else [])).orderBy("qid").toArrow()
        held = spark.sparkContext.broadcast((rows["qid"].to_numpy(), matrix(rows["qvec"].combine_chunks()), np.array(rows["qgroup"].to_pylist()) if group else None))
        part = search(held)
        if len(blocks) > 1:
            part = materialise(part, "block")
            held.destroy()
        found = part if found is None else found.unionByName(part)
    return found


def nearest_batch(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", exclude_self: bool = False, group: bool = False, eps: float | None = None, most: int | None = MAX_K, by_segment: bool = False, early_break: bool = False) -> DataFrame:
    """(qid, rank, vid, distance): for each query (qid, qvec) its k nearest vectors (vid, vec), ties by vid.

    Every task multiplies its vectors with a block of queries and keeps k per query, so k rows per query
    and task are shuffled. ``group``: only vectors whose vgroup is the query's qgroup. ``eps``: only
    vectors within that distance. ``by_segment``: tasks keep k for each segment_id that they meet; the
    result is the same. ``early_break``: a query is done in a task once half of a batch or segment was
    nearer than the k-th it has; faster, and no longer exact. Queries without a near enough vector have no row.
    """
    check_k(k, most)
    found = for_blocks(queries, lambda held: _block_search(vectors, held, k, metric, exclude_self, group, eps, by_segment, early_break), group)
    order = Window.partitionBy("qid").orderBy("distance", "vid")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("qid", "rank", "vid", "distance")


def recall(approximate: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """(qid, recall): the share of the exact neighbours found."""
    hits = exact.join(approximate.select("qid", "vid", F.lit(1).alias("hit")), ["qid", "vid"], "left")
    return hits.groupBy("qid").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.least(F.lit(k), F.count(F.lit(1)))).alias("recall"))


def vector_sums(vectors: DataFrame, group: str) -> DataFrame:
    """(group, pos, sum, n): element-wise sums."""
    return vectors.select(group, F.posexplode("vec").alias("pos", "x")).groupBy(group, "pos").agg(F.sum(F.col("x").cast("double")).alias("sum"), F.count(F.lit(1)).alias("n"))


def pair_stats(vectors: DataFrame, group: str, metric: str = "cosine", block: int = 2048) -> DataFrame:
    """(group, pairs, min, avg and max distance) over all pairs of different vectors of a group; groups of one have no row.

    A group is cut into blocks of about ``block`` vectors, and each two blocks are multiplied in a task of
    their own: a row a pair of blocks comes out, so a large group takes many tasks, and no pair is a row.
    """
    sizes = vectors.groupBy(F.col(group).alias("_of")).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_n"))
    placed = vectors.select("vid", "vec", F.col(group).alias("_group")).join(sizes, F.col("_group").eqNullSafe(F.col("_of"))).drop("_of")
    mine = placed.withColumn("_own", F.pmod(F.xxhash64("vid"), F.col("_n")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_other")
    sent = mine.select("vid", "vec", "_group", "_own", other).select("vid", "vec", "_group", "_own", F.least("_own", "_other").alias("_a"), F.greatest("_own", "_other").alias("_b"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf["_a"].iloc[0], pdf["_b"].iloc[0]
        left, right = (pdf[pdf["_own"] == x].sort_values("vid") for x in (a, b))
        if left.empty or right.empty:
            return pd.DataFrame()
        d = pairwise(np.stack(left["vec"]).astype(np.float64), np.stack(right["vec"]).astype(np.float64), metric, 15)
        kept = d[np.triu_indices(len(d), 1)] if a == b else d.ravel()
        return pd.DataFrame([(pdf["_group"].iloc[0], len(kept), kept.min(), kept.sum(), kept.max())] if len(kept) else [], columns=["_group", "n", "least", "total", "most"])

    schema = sent.select("_group").schema.add("n", "long").add("least", "double").add("total", "double").add("most", "double")
    parts = sent.groupBy("_group", "_a", "_b").applyInPandas(run, schema).groupBy(F.col("_group").alias(group))
    return parts.agg(F.sum("n").alias("pairs"), rounded(F.min("least")).alias("min_distance"), rounded(F.sum("total") / F.sum("n")).alias("avg_distance"), rounded(F.max("most")).alias("max_distance"))
