"""Vector arithmetic as Column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "l2", "ip")


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Zero where either vector has no length."""
    length = norm(a) * norm(b)
    return F.when(length == 0, F.lit(0.0)).otherwise(dot(a, b) / length)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine_similarity(a, b)


def l2_distance(a: Column, b: Column) -> Column:
    return norm(F.zip_with(doubles(a), doubles(b), lambda x, y: x - y))


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Smaller is nearer: 1 - cosine, Euclidean, or the negative inner product."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric!r}")
    return {"cosine": cosine_distance, "l2": l2_distance, "ip": lambda x, y: -dot(x, y)}[metric](a, b)


def rounded(d: Column, digits: int = 6) -> Column:
    """Rounded, with no negative zero."""
    return F.round(d, digits) + F.lit(0.0)


def truncated(v: Column, dim: int) -> Column:
    return F.slice(v, 1, dim)
