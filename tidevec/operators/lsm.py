"""Log-structured segments: sealing, levels, compaction, visibility.

Vectors are numbered in the order of arrival; every ``cap`` distinct keys make a sealed segment, and
levels follow from how many segments were sealed, as compaction depends on counts alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEGMENT_CAP = 4096
GROWING = -1
VISIBILITY = {"compacted": 1, "sealed": 0, "fresh": GROWING}


@dataclass(frozen=True)
class Shape:
    """How levels merge: level i merges ``fan_in[i]`` segments once it holds ``threshold[i]`` (and two at least)."""

    fan_in: tuple[int, ...] = (3, 2, 2)
    threshold: tuple[int, ...] = (3, 399, 19)


@dataclass(frozen=True)
class Segment:
    """Sealed runs [first, last] merged into one segment of a level."""

    segment_id: int
    level: int
    first: int
    last: int


def victims(counts: dict[int, int], shape: Shape = Shape()) -> tuple[int, int] | None:
    """(level, how many of its oldest segments) to merge next, highest level first; None when all is settled."""
    for level in reversed(range(len(shape.fan_in))):
        held = counts.get(level, 0)
        if held >= shape.threshold[level] and held >= max(2, shape.fan_in[level]):
            return level, shape.fan_in[level]
    return None


def directory(sealed: int, shape: Shape = Shape()) -> list[Segment]:
    """The segments after ``sealed`` seals with compaction to a standstill after each."""
    levels: list[list[Segment]] = [[] for _ in range(len(shape.fan_in) + 1)]
    next_id = 0
    for run in range(sealed):
        levels[0].append(Segment(next_id, 0, run, run))
        next_id += 1
        while found := victims({k: len(v) for k, v in enumerate(levels)}, shape):
            level, n = found
            old, levels[level] = levels[level][:n], levels[level][n:]
            levels[level + 1].append(Segment(next_id, level + 1, old[0].first, old[-1].last))
            next_id += 1
    return [s for level in levels for s in level]


def shape_of(n: int, cap: int = SEGMENT_CAP) -> dict[str, int]:
    """The closed form for n distinct keys while level 1 is below its threshold."""
    sealed = max(0, n - 1) // cap
    return {"growing": n - cap * sealed, "level0": sealed % 3, "level1": sealed // 3, "sealed": sealed}


def sealed_run(order: Column, n: Column, cap: int) -> Column:
    """The sealed run (from 0) of the row numbered ``order`` (from 1) of n; null while it is growing. A full buffer seals at the next put."""
    run = F.floor((order - 1) / F.lit(cap))
    return F.when(run < F.floor(F.greatest(n - 1, F.lit(0)) / F.lit(cap)), run)


def assign(numbered: DataFrame, order: str, cap: int = SEGMENT_CAP, shape: Shape = Shape()) -> DataFrame:
    """Add segment_id and level to vectors numbered 1.. in ``order``; the growing rows have segment_id null and level -1."""
    spark = numbered.sparkSession
    n = numbered.agg(F.coalesce(F.max(order), F.lit(0))).first()[0]
    rows = [(run, s.segment_id, s.level) for s in directory(max(0, n - 1) // cap, shape) for run in range(s.first, s.last + 1)]
    table = spark.createDataFrame(rows, "_run long, segment_id long, level int")
    keyed = numbered.withColumn("_run", sealed_run(F.col(order), F.lit(n), cap))
    joined = keyed.join(table, "_run", "left")
    return joined.withColumn("level", F.coalesce("level", F.lit(GROWING))).drop("_run")


def newest(versions: DataFrame, key: str = "vid", order: str = "seq") -> DataFrame:
    """The newest version of each key: one partial aggregation, one shuffle on the key."""
    rest = [c for c in versions.columns if c != key]
    return versions.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_newest")).select(key, "_newest.*")


def merge(segments: DataFrame, key: str = "vid", order: str = "seq") -> DataFrame:
    """Compaction's output: the victims' rows merged newest-wins, sorted by key."""
    return newest(segments, key, order).repartitionByRange(F.col(key)).sortWithinPartitions(key)


def layout(assigned: DataFrame, key: str = "vid") -> DataFrame:
    """(level, segment_id, entries, min_key, max_key) of every segment and of the growing rows."""
    return assigned.groupBy("level", "segment_id").agg(F.count(F.lit(1)).alias("entries"), F.min(key).alias("min_key"), F.max(key).alias("max_key"))


def visible(assigned: DataFrame, visibility: str = "compacted") -> DataFrame:
    """Rows that a search sees: level 1 and above, sealed too, or all."""
    if visibility not in VISIBILITY:
        raise ValueError(f"unknown visibility: {visibility!r}")
    return assigned.filter(F.col("level") >= VISIBILITY[visibility])


def needs_index(segments: DataFrame, snapshot: int | None = None) -> DataFrame:
    """Unindexed segments of level 1 and above, older than the build's snapshot, in the order of building."""
    found = segments.filter((F.col("level") >= 1) & ~F.col("indexed"))
    if snapshot is not None:
        found = found.filter(F.col("segment_id") < snapshot)
    return found.orderBy("level", "segment_id")
