"""Operation logs: mapping from events, run lengths, statistics, arrivals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import numbered, running, with_previous

INSERT, SEARCH, BUILD = "VECTOR_INSERT", "VECTOR_SEARCH", "INDEX_BUILD"
BUILD_ASYNC, BUILD_WAIT, PAUSE, RESUME = "INDEX_BUILD_ASYNC", "INDEX_BUILD_WAIT", "PAUSE_BUILD", "RESUME_BUILD"
OP_TYPES = (INSERT, SEARCH, BUILD, BUILD_ASYNC, BUILD_WAIT, PAUSE, RESUME)
INSERT_EVENTS = ("click", "purchase", "signup")


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def ops_from_events(events: DataFrame) -> DataFrame:
    """(seq, op_type, arrival_time, value): click, purchase and signup insert, view searches; the first error at or after
    half of the inserts builds the index, other errors are dropped. Order: (ts, event_id)."""
    insert = F.col("event_type").isin(*INSERT_EVENTS)
    kept = events.select("event_id", "event_type", "value", seconds(F.col("ts")).alias("arrival_time")).filter(insert | F.col("event_type").isin("view", "error"))
    counted = running(kept, ["arrival_time", "event_id"], {"inserted": insert.cast("long")})
    total = kept.filter(insert).count()
    trigger = counted.filter((F.col("event_type") == "error") & (F.col("inserted") * 2 >= total)).orderBy("arrival_time", "event_id").limit(1).select("event_id").collect()
    build = F.col("event_id") == (trigger[0][0] if trigger else None)
    ops = counted.filter((F.col("event_type") != "error") | build)
    typed = ops.select("event_id", F.when(insert, INSERT).when(F.col("event_type") == "view", SEARCH).otherwise(BUILD).alias("op_type"), "arrival_time", "value")
    return numbered(typed, ["arrival_time", "event_id"]).select("seq", "op_type", "arrival_time", "value")


def run_lengths(ops: DataFrame) -> DataFrame:
    """(start_seq, op_type, length) of every run of equal operations: a row's number less its number within its type stays the same in a run."""
    within = running(ops.select("seq", "op_type"), ["seq"], {f"n_{t}": (F.col("op_type") == t).cast("long") for t in OP_TYPES})
    own = F.coalesce(*[F.when(F.col("op_type") == t, F.col(f"n_{t}")) for t in OP_TYPES])
    return within.groupBy("op_type", (F.col("seq") - own).alias("run")).agg(F.min("seq").alias("start_seq"), F.count(F.lit(1)).alias("length")).drop("run")


def op_stats(ops: DataFrame, latency: str = "value", every: int = 100) -> DataFrame:
    """(op_type, n, avg_latency, sampled, avg_sampled): all, and each ``every``-th of a type."""
    within = running(ops.select("seq", "op_type", latency), ["seq"], {f"n_{t}": (F.col("op_type") == t).cast("long") for t in OP_TYPES})
    own = F.coalesce(*[F.when(F.col("op_type") == t, F.col(f"n_{t}")) for t in OP_TYPES])
    sampled = own % every == 0
    return within.groupBy("op_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(latency), 6).alias("avg_latency"),
        F.count_if(sampled).alias("sampled"),
        F.round(F.avg(F.when(sampled, F.col(latency))), 6).alias("avg_sampled"),
    )


def command_stats(ops: DataFrame, total: str, flash: str, copy: str, printed: Column) -> DataFrame:
    """(print, op_type, n, avg_total, avg_compute, avg_flash): statistics as each print finds them; a print resets them.

    ``printed`` tells the rows that print; they count for the print after them. Compute time is what flash and copying leave of the total.
    """
    counted = running(ops.select("seq", "op_type", total, flash, copy, printed.alias("_printed")), ["seq"], {"upto": F.col("_printed").cast("long")})
    return counted.groupBy(F.col("upto").alias("print"), "op_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(total), 6).alias("avg_total"),
        F.round(F.avg(F.col(total) - F.col(flash) - F.col(copy)), 6).alias("avg_compute"),
        F.round(F.avg(flash), 6).alias("avg_flash"),
    )


def interarrival(events: DataFrame, id_col: str = "event_id") -> DataFrame:
    """(id, gap, elapsed): seconds since the row before and since the first row."""
    timed = events.select(id_col, F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    first = timed.agg(F.min("us")).first()[0] or 0
    before = with_previous(timed, ["us", id_col], "us", "previous")
    return before.select(id_col, ((F.col("us") - F.coalesce("previous", "us")) / F.lit(1e6)).alias("gap"), ((F.col("us") - F.lit(first)) / F.lit(1e6)).alias("elapsed"))


def merge_arrivals(*streams: DataFrame) -> DataFrame:
    """(seq, source, arrival_time, id): streams of (source, arrival_time, id) merged by time; ties by source, then id."""
    merged = streams[0]
    for s in streams[1:]:
        merged = merged.unionByName(s)
    return numbered(merged, ["arrival_time", "source", "id"]).select("seq", "source", "arrival_time", "id")


def result_lines(results: DataFrame, trace: str) -> DataFrame:
    """(row, line): a query's results as trace,row,vid,distance groups joined by tabs in the order of rank."""
    group = F.concat_ws(",", F.lit(trace), F.col("qid").cast("string"), F.col("vid").cast("string"), F.format_string("%.6f", F.col("distance")))
    lists = results.select("qid", F.struct("rank", group.alias("text")).alias("item")).groupBy("qid").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return lists.select(F.col("qid").alias("row"), F.array_join(F.transform("items", lambda x: x["text"]), "\t").alias("line"))
