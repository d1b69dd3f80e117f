"""Streams: vectors into a store, and windows over operation logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..scratch import place
from ..store import VectorStore


def ingest(vectors: DataFrame, store: VectorStore, checkpoint: str | None = None, order: str | None = "seq", once: bool = True, name: str = "stream", late: tuple[str, str] | None = None) -> StreamingQuery:
    """Upsert a stream of (vid, vec[, seq]) batch by batch: each batch is put, sealed and compacted before the next.

    The store keeps the last batch of each stream ``name``: a batch that comes again after a failure is
    put once. ``late`` (a time column, a delay): rows that repeat a key and time within the delay are
    dropped, with a watermark.
    """
    if late:
        vectors = vectors.withWatermark(*late).dropDuplicatesWithinWatermark(["vid", late[0]])

    def put(batch: DataFrame, number: int) -> None:
        store.put_batch(batch, order if order in batch.columns else None, stream=name, batch_id=number)

    writer = vectors.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint or place(vectors.sparkSession, "ingest"))
    return writer.trigger(availableNow=True).start() if once else writer.start()


_GROWING = "vids array<long>, vecs array<array<float>>, runs long"


def sealed_runs(vectors: DataFrame, cap: int, shards: int = 8) -> DataFrame:
    """(shard, run, vid, vec) of a stream of (vid, vec, seq): the growing segment of each shard (vid modulo ``shards``) as
    state, sealed when a key comes that would be more than ``cap``. A key that comes again replaces its vector
    while it grows. State holds ``cap`` rows a shard at most; what grows at the end doesn't come out.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        vids, vecs, number = state.get if state.exists else ([], [], 0)
        held = dict(zip(vids, vecs, strict=True))
        rows = pd.concat(list(batches)).sort_values(["seq", "vid"], kind="stable")
        for vid, vec in zip(rows["vid"].tolist(), rows["vec"].tolist(), strict=True):
            if vid not in held and len(held) == cap:
                ordered = sorted(held)
                yield pd.DataFrame({"shard": int(key[0]), "run": number, "vid": ordered, "vec": [held[x] for x in ordered]})
                held, number = {}, number + 1
            held[vid] = [float(x) for x in vec]
        state.update((list(held), list(held.values()), number))

    keyed = vectors.select(F.pmod("vid", F.lit(shards)).cast("int").alias("shard"), "vid", "vec", "seq")
    return keyed.groupBy("shard").applyInPandasWithState(run, "shard int, run long, vid long, vec array<float>", _GROWING, "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, width: str = "10 minutes", slide: str | None = None, late: str | None = None, ts: str = "ts", kind: str = "event_type") -> DataFrame:
    """(window_start, window_end, kind, n) over a batch or a stream; ``late`` sets the watermark of a stream."""
    timed = events.withColumn("_at", F.col(ts).cast("timestamp"))
    if late:
        timed = timed.withWatermark("_at", late)
    spans = F.window("_at", width, slide) if slide else F.window("_at", width)
    return timed.groupBy(spans.alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), kind, "n")


def session_counts(events: DataFrame, gap: str = "5 minutes", late: str | None = None, ts: str = "ts", key: str = "user_id") -> DataFrame:
    """(window_start, window_end, key, n): runs of a key's events with no longer gap than ``gap``."""
    timed = events.withColumn("_at", F.col(ts).cast("timestamp"))
    if late:
        timed = timed.withWatermark("_at", late)
    return timed.groupBy(F.session_window("_at", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "n")


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is available and return its last result, or in mode "append" all of it, stored."""
    spark = stream.sparkSession
    root = place(spark, "drained")
    state = {"path": None, "all": []}

    def keep(batch: DataFrame, number: int) -> None:
        state["path"] = f"{root}/{number}"
        batch.write.mode("overwrite").parquet(state["path"])
        state["all"].append(state["path"])

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", place(spark, "drained-state")).trigger(availableNow=True).start().awaitTermination()
    wanted = state["all"] if mode == "append" else state["all"][-1:]
    return spark.read.schema(stream.schema).parquet(*dict.fromkeys(wanted)) if wanted else spark.createDataFrame([], stream.schema)
