"""Scheduling policies over operation logs, as plans.

Logs have (seq, op_type, arrival_time) and optionally deadline (1 s if absent); schedules have
(position, seq, op_type, arrival_time), where operations that a policy adds have seq null. A log has
one build; SP-P and SLO-P act on the first and drop later ones.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.oplog import BUILD, BUILD_ASYNC, BUILD_WAIT, INSERT, PAUSE, RESUME, SEARCH
from ..operators.prefix import numbered, running


@dataclass(frozen=True)
class Costs:
    """Seconds, from profiling; ``block`` inserts make a growing segment, three of those an unindexed one."""

    build: float = 37.8
    margin: float = 0.3
    indexed: float = 0.00319
    unindexed: float = 0.00533
    insert: float = 0.00000277
    checkpoint: float = 0.06
    resume: float = 0.028
    deadline: float = 1.0
    block: int = 4096
    built_before: int = 0  # unindexed segments when the schedule is made


def tracker_state(ops: DataFrame, block: int = 4096) -> DataFrame:
    """(seq, op_type, inserts, growing, n_indexed, n_unindexed) after each operation; a build indexes what is unindexed."""
    sums = {"inserts": (F.col("op_type") == INSERT).cast("long"), "builds": (F.col("op_type") == BUILD).cast("long")}
    counted = running(ops.select("seq", "op_type"), ["seq"], sums)
    sealed = F.floor(F.floor(F.col("inserts") / block) / 3).cast("long")
    built = counted.filter(F.col("op_type") == BUILD).select(F.col("builds"), sealed.alias("n_indexed"))
    known = counted.join(built, "builds", "left")
    indexed = F.coalesce("n_indexed", F.lit(0).cast("long"))
    return known.select("seq", "op_type", "inserts", F.pmod(F.floor(F.col("inserts") / block), F.lit(3)).cast("long").alias("growing"), indexed.alias("n_indexed"), (sealed - indexed).alias("n_unindexed"))


def with_built(costs: Costs, state: DataFrame) -> Costs:
    """A copy of ``costs`` for a schedule that begins where ``tracker_state``'s log ends: its unindexed segments are built first."""
    last = state.agg(F.max_by("n_unindexed", "seq")).first()[0]
    return replace(costs, built_before=int(last or 0))


def _first_build(ops: DataFrame) -> tuple[int, float] | None:
    found = ops.filter(F.col("op_type") == BUILD).agg(F.min("seq").alias("seq"), F.min_by("arrival_time", "seq").alias("at")).first()
    return None if found["seq"] is None else (found["seq"], found["at"])


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    return numbered(rows, order, "position").select("position", "seq", "op_type", "arrival_time")


def np_policy(ops: DataFrame) -> DataFrame:
    """As they came."""
    return _placed(ops, ["seq"])


def sp_np(ops: DataFrame) -> DataFrame:
    """A build waits while searches follow it and runs before the next other operation; if that is a build, the first is dropped."""
    others = numbered(ops.filter(F.col("op_type") != SEARCH).select("seq", "op_type"), ["seq"], "nth")
    after = others.select((F.col("nth") - 1).alias("nth"), F.col("seq").alias("next_seq"), F.col("op_type").alias("next_type"))
    builds = others.filter(F.col("op_type") == BUILD).join(after, "nth", "left").select(F.col("seq").alias("built"), "next_seq", "next_type")
    held = ops.filter(F.col("op_type") == BUILD).join(builds, F.col("seq") == F.col("built")).filter(F.coalesce(F.col("next_type"), F.lit("")) != BUILD)
    moved = held.select("seq", "op_type", "arrival_time", F.coalesce(F.col("next_seq") - 0.5, F.lit(float("inf"))).alias("place"))
    rest = ops.filter(F.col("op_type") != BUILD).select("seq", "op_type", "arrival_time", F.col("seq").cast("double").alias("place"))
    return _placed(rest.unionByName(moved), ["place", "seq"])


def _added(ops: DataFrame, rows: list[tuple[int, str, float]]) -> DataFrame:
    made = ops.sparkSession.createDataFrame([(g, t, a) for g, t, a in rows], "place int, op_type string, arrival_time double")
    return made.select("place", F.lit(None).cast("long").alias("seq"), "op_type", "arrival_time")


def _grouped(ops: DataFrame, place: Column, rows: list[tuple[int, str, float]]) -> DataFrame:
    kept = ops.withColumn("place", place).filter("place IS NOT NULL").select("place", "seq", "op_type", "arrival_time")
    return _placed(kept.unionByName(_added(ops, rows)), ["place", "seq"])


def sp_p(ops: DataFrame) -> DataFrame:
    """Start the build, pause it for all later searches, resume, then all later inserts, then wait for it."""
    build = _first_build(ops)
    if build is None:
        return np_policy(ops)
    at, t = build
    later = ops.filter(F.col("seq") > at).groupBy("op_type").agg(F.max_by("arrival_time", "seq").alias("last"))
    last = {r["op_type"]: r["last"] for r in later.collect()}
    rows = [(1, BUILD_ASYNC, t), (6, BUILD_WAIT, last.get(INSERT, t))]
    if SEARCH in last:
        rows += [(2, PAUSE, t), (4, RESUME, last[SEARCH])]
    return _grouped(ops, F.when(F.col("seq") < at, 0).when(F.col("seq") == at, None).when(F.col("op_type") == SEARCH, 3).when(F.col("op_type") == INSERT, 5), rows)


def admissions(ops: DataFrame, costs: Costs = Costs()) -> tuple[DataFrame, tuple[int, float]] | None:
    """The later inserts and searches with ``admitted``, and the build; None without a build.

    A search is admitted if it meets its deadline and fewer searches were admitted than the build's own
    deadline leaves time for. That bound never rises along the log, so the searches that meet their
    deadlines are admitted while their number is within the bound at their place.
    """
    build = _first_build(ops)
    if build is None:
        return None
    at, _ = build
    log = ops if "deadline" in ops.columns else ops.withColumn("deadline", F.lit(costs.deadline))
    inserted = log.filter((F.col("seq") < at) & (F.col("op_type") == INSERT)).count()
    search_s = (inserted // costs.block // 3) * costs.unindexed
    in_time = F.coalesce(F.lit(costs.checkpoint + search_s + costs.resume) <= F.col("deadline"), F.lit(False))
    later = log.filter((F.col("seq") > at) & F.col("op_type").isin(INSERT, SEARCH)).withColumn("in_time", (F.col("op_type") == SEARCH) & in_time)
    counted = running(later, ["seq"], {"n_insert": (F.col("op_type") == INSERT).cast("long"), "n_search": F.col("in_time").cast("long")})
    room = F.lit(costs.build * (1 + costs.margin)) - F.lit(costs.build * costs.built_before) - F.lit(costs.checkpoint) - F.lit(costs.resume) - F.col("n_insert") * F.lit(costs.insert)
    room = room - F.lit(costs.resume + costs.checkpoint)
    most = F.greatest(F.lit(0).cast("long"), (room / F.lit(search_s)).cast("long")) if search_s > 0 else F.lit(0).cast("long")
    admitted = (F.col("op_type") == INSERT) | (F.col("in_time") & (F.col("n_search") <= most))
    return counted.withColumn("admitted", admitted), build


def slo_p(ops: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """Start the build, pause it for inserts and the admitted searches, resume, then the rejected searches, then wait."""
    found = admissions(ops, costs)
    if found is None:
        return np_policy(ops)
    later, (at, t) = found
    last = later.filter("admitted").agg(F.max_by("arrival_time", "seq")).first()[0]
    rows = [(1, BUILD_ASYNC, t), (6, BUILD_WAIT, (t if last is None else last) + 1e-6)]
    if last is not None:
        rows += [(2, PAUSE, t), (4, RESUME, last)]
    prefix = ops.filter(F.col("seq") < at).select(F.lit(0).alias("place"), "seq", "op_type", "arrival_time")
    placed = later.select(F.when(F.col("admitted"), 3).otherwise(5).alias("place"), "seq", "op_type", "arrival_time")
    return _placed(prefix.unionByName(placed).unionByName(_added(ops, rows)), ["place", "seq"])


POLICIES = {"NP": np_policy, "SP-NP": sp_np, "SP-P": sp_p, "SLO-P": slo_p}


def schedule(ops: DataFrame, policy: str, costs: Costs = Costs()) -> DataFrame:
    if policy not in POLICIES:
        raise ValueError(f"unknown policy: {policy!r}")
    return slo_p(ops, costs) if policy == "SLO-P" else POLICIES[policy](ops)
