"""Corpora, query sets and configurations in; result and execution logs out."""

from __future__ import annotations

import csv
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.distance import truncated
from ..operators.search import VectorError

# The fields that a configuration may have.
CONFIG_FIELDS = frozenset("collection_name dimension index_type metric_type index_params search_params simulation_days time_scale_factor vector_field id_field metadata_fields scenarios".split())


def load_config(path: str) -> dict:
    """A JSON configuration; a field outside ``CONFIG_FIELDS`` is an error."""
    with open(path) as f:
        found = json.load(f)
    if unknown := sorted(set(found) - CONFIG_FIELDS):
        raise ValueError(f"unknown configuration fields: {', '.join(unknown)}")
    return found


def _npy(embeddings: str, metadata: str, dim: int) -> tuple[np.ndarray, list[dict]]:
    vectors = np.load(embeddings, mmap_mode="r")
    if vectors.ndim != 2 or vectors.shape[1] < dim:
        raise VectorError(f"{embeddings}: {dim} columns at least are needed, not {vectors.shape}")
    with open(metadata, newline="") as f:
        rows = list(csv.DictReader(f))
    if len(rows) != len(vectors):
        raise VectorError(f"{len(vectors)} vectors, but {len(rows)} rows of metadata")
    return np.asarray(vectors[:, :dim], np.float32), rows


def corpus_from_npy(spark: SparkSession, embeddings: str, metadata: str, dim: int) -> DataFrame:
    """(vid from 1, vec, the metadata's columns): row by row of a matrix and a CSV file on the driver, cut to ``dim`` columns."""
    vectors, rows = _npy(embeddings, metadata, dim)
    columns = [c for c in (rows[0] if rows else {}) if c not in ("vid", "vec")]
    data = [(i + 1, v.tolist(), *(r[c] for c in columns)) for i, (v, r) in enumerate(zip(vectors, rows, strict=True))]
    return spark.createDataFrame(data, ", ".join(["vid long", "vec array<float>", *(f"`{c}` string" for c in columns)]))


def queries_from_npy(spark: SparkSession, embeddings: str, metadata: str, dim: int) -> DataFrame:
    """(qid from 0, qvec)."""
    vectors, _ = _npy(embeddings, metadata, dim)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "qid long, qvec array<float>")


def vectors_from_parquet(spark: SparkSession, path: str, id_col: str = "vec_id", vec_col: str = "embedding", dim: int | None = None) -> DataFrame:
    """(vid, vec, the other columns) of a Parquet table, cut to ``dim`` numbers if given."""
    df = spark.read.parquet(path)
    vec = F.col(vec_col) if dim is None else truncated(F.col(vec_col), dim)
    return df.select(F.col(id_col).cast("long").alias("vid"), vec.alias("vec"), *[F.col(f"`{c}`") for c in df.columns if c not in (id_col, vec_col)])


def key_of(key) -> int:
    """An unsigned 32-bit key from a number or its decimal digits."""
    found = int(key)
    if not 0 <= found < 1 << 32:
        raise VectorError(f"a key is from 0 to 2**32 - 1, not {key!r}")
    return found


def write_execution_log(ops: DataFrame, path: str, order: str = "position") -> None:
    """seq,op_type rows with a header, in order."""
    ops.orderBy(order).select(F.col(order).alias("seq"), "op_type").write.mode("overwrite").option("header", True).csv(path)


def append_result_lines(lines: DataFrame, path: str) -> None:
    """One text line per query, appended."""
    lines.orderBy("row").select("line").write.mode("append").text(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Whole rows, key and vector."""
    vectors.write.mode("append").parquet(path)
