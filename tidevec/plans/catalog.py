"""Every query of the engine by name, with its SQL where SQL can express it.

Searches take every vector whose id is divisible by 20 as a query, against all vectors. Segments hold
64 vectors here, so that small tables have levels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distance as dist
from ..functions import scalar
from ..operators import hnsw, lsm, oplog, planner, search
from ..operators.prefix import numbered
from ..scratch import materialise, place
from ..sources.loaders import vectors_from_parquet
from ..store import VectorStore
from ..streaming import ingest
from ..workload import generators
from . import schedule

CAP, DIM, ONE, EPS = 64, 64, 0, 0.8
COSTS = schedule.Costs(block=64)
Q = Callable[[SparkSession, str], DataFrame]


def vectors(spark: SparkSession, sf: str, dim: int | None = None) -> DataFrame:
    return vectors_from_parquet(spark, f"{sf}/embeddings.parquet", dim=dim)


def asked(v: DataFrame) -> DataFrame:
    """The queries: (qid, qvec, qgroup)."""
    return v.filter(F.col("vid") % 20 == 0).select(F.col("vid").alias("qid"), F.col("vec").alias("qvec"), F.col("label").alias("qgroup"))


def one(v: DataFrame) -> list[float]:
    found = v.filter(F.col("vid") == ONE).select("vec").first()
    return list(found[0]) if found else [0.0] * DIM


def segmented(spark: SparkSession, sf: str) -> DataFrame:
    return lsm.assign(numbered(vectors(spark, sf), ["vid"], "ord"), "ord", CAP)


def events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet")


def ops(spark: SparkSession, sf: str) -> DataFrame:
    return materialise(oplog.ops_from_events(events(spark, sf)), "ops")


def puts(spark: SparkSession, sf: str) -> DataFrame:
    """Events as puts: key user_id, payload value, newest by (ts, event_id); errors are deletes."""
    e = events(spark, sf)
    return e.select(F.col("user_id").alias("vid"), "event_id", "value", (F.col("event_type") == "error").alias("deleted"), F.struct("ts", "event_id").alias("seq"))


# -- search ----------------------------------------------------------------------------------------


def knn_exact_single(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    return search.nearest(v, one(v), 10)


def knn_exact_batch(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    return search.nearest_batch(v, asked(v), 5)


def knn_exclude_self(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    return search.nearest_batch(v, asked(v), 5, exclude_self=True)


def knn_filtered(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    return search.nearest_batch(v.withColumn("vgroup", F.col("label")), asked(v), 5, group=True)


def knn_eps(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    return search.nearest_batch(v, asked(v), 20, eps=EPS)


def knn_l2(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    return search.nearest_batch(v, asked(v), 5, "l2")


def knn_inner_product(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    return search.nearest_batch(v, asked(v), 5, "ip")


def knn_with_metadata(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    return search.nearest_batch(v, asked(v), 5).join(v.select("vid", "label"), "vid").select("qid", "rank", "vid", "label", "distance")


def dim_truncate_knn(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf, 32)
    return search.nearest_batch(v, asked(v), 10)


def label_distance_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Mean distance of a label's pairs, from the sum of its unit vectors, and the range of distances from that sum."""
    v = vectors(spark, sf).withColumn("len", dist.norm(F.col("vec")))
    unit = v.select("vid", "label", F.transform("vec", lambda x: F.when(F.col("len") > 0, x.cast("double") / F.col("len")).otherwise(0.0)).alias("vec"))
    sums = search.vector_sums(unit, "label").groupBy("label").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "sum"))), lambda x: x["sum"]).alias("centre"))
    near = unit.join(F.broadcast(sums), "label").select("label", "n", "centre", dist.cosine_distance(F.col("vec"), F.col("centre")).alias("d"))  # a row per label
    pairs = F.first("n") * (F.first("n") - 1) / 2
    mean = F.when(F.first("n") > 1, 1 - (dist.dot(F.first("centre"), F.first("centre")) - F.first("n")) / 2 / pairs)
    return near.groupBy("label").agg(F.first("n").alias("n"), dist.rounded(mean).alias("mean_distance"), dist.rounded(F.min("d")).alias("nearest"), dist.rounded(F.max("d")).alias("farthest"))


def cosine_pairs_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Least, mean and greatest distance over each label's pairs."""
    return search.pair_stats(vectors(spark, sf), "label")


def vector_norms(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).select("vid", dist.rounded(dist.norm(F.col("vec"))).alias("norm"))


def vector_sum_by_label(spark: SparkSession, sf: str) -> DataFrame:
    return search.vector_sums(vectors(spark, sf), "label").select("label", "pos", dist.rounded(F.col("sum"), 4).alias("sum"))


def zero_norm_distance(spark: SparkSession, sf: str) -> DataFrame:
    zero = F.array_repeat(F.lit(0.0), DIM)
    return vectors(spark, sf).select("vid", dist.rounded(dist.cosine_distance(F.col("vec"), zero)).alias("distance"))


# -- segments --------------------------------------------------------------------------------------


def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    return lsm.newest(puts(spark, sf)).select("vid", "event_id", "value")


def get_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Lookups of every key that a search event names."""
    wanted = events(spark, sf).filter(F.col("event_type") == "view").select(F.col("user_id").alias("vid")).distinct()
    return lsm.newest(puts(spark, sf).join(wanted, "vid", "left_semi")).filter(~F.col("deleted")).select("vid", "value")


def delete_tombstone(spark: SparkSession, sf: str) -> DataFrame:
    gone = lsm.newest(puts(spark, sf)).filter("deleted").select("vid")
    return events(spark, sf).select(F.col("user_id").alias("vid")).distinct().join(gone, "vid", "left_anti")


def seal_assign(spark: SparkSession, sf: str) -> DataFrame:
    return segmented(spark, sf).select("vid", "segment_id", "level")


def lsm_layout(spark: SparkSession, sf: str) -> DataFrame:
    return lsm.layout(segmented(spark, sf)).select("level", "entries", "min_key", "max_key")


def compaction_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Three overlapping runs of events by key, merged newest-wins."""
    e = events(spark, sf).withColumn("run", F.col("event_id") % 3)
    runs = e.groupBy("run", F.col("user_id").alias("vid")).agg(F.max_by(F.struct("event_id", "value", F.struct("ts", "event_id").alias("seq")), F.struct("ts", "event_id")).alias("r"))
    return lsm.merge(runs.select("vid", "r.event_id", "r.value", "r.seq")).select("vid", "event_id", "value")


def compaction_plan(spark: SparkSession, sf: str) -> DataFrame:
    """What the next merge takes, for 0 to 450 segments at each of two levels."""
    rows = [(a, b, *(lsm.victims({0: a, 1: b}) or (-1, 0))) for a in range(5) for b in range(451)]
    return spark.createDataFrame(rows, "level0 int, level1 int, victim_level int, victims int")


def visibility_counts(spark: SparkSession, sf: str) -> DataFrame:
    s = materialise(segmented(spark, sf).select("vid", "level"), "levels")
    parts = [lsm.visible(s, v).agg(F.count(F.lit(1)).alias("visible")).select(F.lit(v).alias("visibility"), "visible") for v in lsm.VISIBILITY]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def search_compacted_only(spark: SparkSession, sf: str) -> DataFrame:
    s = materialise(segmented(spark, sf), "levels")
    return search.nearest_batch(lsm.visible(s), asked(s), 10)


def segments_needing_index(spark: SparkSession, sf: str) -> DataFrame:
    """Of the layout, with every segment of an even id indexed, those that a build would index, by place."""
    s = lsm.layout(segmented(spark, sf)).filter("segment_id IS NOT NULL").withColumn("indexed", F.col("segment_id") % 2 == 0)
    return numbered(lsm.needs_index(s).select("level", "segment_id"), ["level", "segment_id"], "place")


def per_segment_topk_merge(spark: SparkSession, sf: str) -> DataFrame:
    s = materialise(segmented(spark, sf), "levels")
    return planner.per_segment_top(s, asked(s), 5)


# -- graphs ----------------------------------------------------------------------------------------


def _graphs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    s = materialise(segmented(spark, sf), "levels")
    return s, materialise(hnsw.build_graphs(s.filter("level >= 1")), "graphs")


def hnsw_build_graph(spark: SparkSession, sf: str) -> DataFrame:
    return _graphs(spark, sf)[1]


def hnsw_degree_stats(spark: SparkSession, sf: str) -> DataFrame:
    return hnsw.degree_stats(_graphs(spark, sf)[1])


def hnsw_degree_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return hnsw.degree_histogram(_graphs(spark, sf)[1])


def hnsw_search(spark: SparkSession, sf: str) -> DataFrame:
    s, g = _graphs(spark, sf)
    return hnsw.search_graphs(g, s.filter("level >= 1"), asked(s), 10)


def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    s, g = _graphs(spark, sf)
    return planner.hybrid(s, g, asked(s), 10)


def hnsw_recall(spark: SparkSession, sf: str) -> DataFrame:
    s, g = _graphs(spark, sf)
    return search.recall(planner.hybrid(s, g, asked(s), 10), search.nearest_batch(s, asked(s), 10), 10)


def store_search(spark: SparkSession, sf: str) -> DataFrame:
    """The store end to end: put, seal, compact, build, search what is compacted."""
    v = vectors(spark, sf)
    store = VectorStore(spark, place(spark, "store"), dim=DIM, cap=CAP).open()
    store.put_batch(v.withColumn("seq", F.col("vid")), "seq")
    store.build_index(wait=True)
    return store.search(asked(v), 10, visibility="fresh")


def store_search_changed(spark: SparkSession, sf: str) -> DataFrame:
    """A store whose keys change after the index is built: keys divisible by 7 get the reversed vector, those divisible by 11 are deleted. k is 5, metadata hold the label."""
    v = vectors(spark, sf)
    store = VectorStore(spark, place(spark, "store"), dim=DIM, cap=CAP, params=hnsw.Params(ef_search=400)).open()
    store.put_batch(v.withColumn("seq", F.col("vid")), "seq", metadata=("label",))
    store.build_index(wait=True)
    store.put_batch(v.filter("vid % 7 = 0").select("vid", F.reverse("vec").alias("vec"), F.col("vid").alias("seq"), "label"), "seq", metadata=("label",))
    store.delete(*[r[0] for r in v.filter("vid % 11 = 0").select("vid").collect()])
    return store.search(asked(v), 5, visibility="fresh", where=F.col("meta")["label"] != "3")


# -- logs and schedules ----------------------------------------------------------------------------


def ops_from_events(spark: SparkSession, sf: str) -> DataFrame:
    return oplog.ops_from_events(events(spark, sf)).select("seq", "op_type")


def tracker_state(spark: SparkSession, sf: str) -> DataFrame:
    return schedule.tracker_state(ops(spark, sf), COSTS.block).select("seq", "growing", "n_indexed", "n_unindexed")


def _schedule(policy: str) -> Q:
    return lambda spark, sf: schedule.schedule(ops(spark, sf), policy, COSTS).select("position", "seq", "op_type")


def slo_admission_summary(spark: SparkSession, sf: str) -> DataFrame:
    later, _ = schedule.admissions(ops(spark, sf), COSTS)
    return later.groupBy("op_type", "admitted").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


def op_run_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return oplog.run_lengths(ops(spark, sf))


def op_stats(spark: SparkSession, sf: str) -> DataFrame:
    return oplog.op_stats(ops(spark, sf))


def command_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Totals from the log, flash a quarter and copying a twentieth of each; every build prints and resets."""
    log = ops(spark, sf).select("seq", "op_type", F.col("value").alias("total"), (F.col("value") / 4).alias("flash"), (F.col("value") / 20).alias("copy"))
    return oplog.command_stats(log, "total", "flash", "copy", F.col("op_type") == oplog.BUILD)


def interarrival(spark: SparkSession, sf: str) -> DataFrame:
    return oplog.interarrival(events(spark, sf)).select("event_id", F.round("gap", 6).alias("gap"), F.round("elapsed", 6).alias("elapsed"))


def merge_arrivals(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).select("event_type", oplog.seconds(F.col("ts")).alias("arrival_time"), F.col("event_id").alias("id"))
    streams = [e.filter(F.col("event_type") == t).select(F.lit(t).alias("source"), "arrival_time", "id") for t in ("click", "view")]
    return oplog.merge_arrivals(*streams).select("seq", "source", "id")


def _workload(name: str) -> Q:
    return lambda spark, sf: generators.build_summary(generators.operations(spark, name))


def _workload_sql(name: str) -> str:
    """By the scenario's numbers alone."""
    p, rule = generators.SCENARIOS[name], generators.RULES[name]
    kept = f"({p['req']} - {int(rule.counted)})"
    inserts = f"CAST(floor({kept} * {rule.inserts}) AS BIGINT)"
    waited = f"CAST(ceil(({inserts if rule.inserts else kept}) * {p.get('build_trigger_ratio', rule.build_after)}) AS BIGINT)"
    rows = [f"SELECT 'VECTOR_INSERT' AS op_type, {inserts} AS n, CAST(NULL AS BIGINT) AS before_build", f"SELECT 'VECTOR_SEARCH', {kept} - {inserts}, NULL"]
    if rule.build_after:
        rows.append(f"SELECT 'INDEX_BUILD', 1, {waited}")
    return f"SELECT op_type, CAST(n AS BIGINT) AS n, before_build FROM ({' UNION ALL '.join(rows)}) WHERE n > 0"


def result_csv_line(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    return oplog.result_lines(search.nearest_batch(v, asked(v), 5), "trace")


def bytes_to_nlb(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", scalar.bytes_to_nlb(F.octet_length("text")).alias("blocks"))


def block_slices(spark: SparkSession, sf: str) -> DataFrame:
    found = scalar.slice_of(F.col("doc_id"))
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", found[0].alias("slice"), found[1].alias("place"))


def lcg_sequence(spark: SparkSession, sf: str) -> DataFrame:
    return scalar.lcg_sequence(spark, 100)


# -- streams ---------------------------------------------------------------------------------------


def _stream(spark: SparkSession, sf: str, table: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf}/{table}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{table}.parque[t]")


def stream_ingest_seal(spark: SparkSession, sf: str) -> DataFrame:
    """A stream of vectors into a store: the directory equals a batch's."""
    store = VectorStore(spark, place(spark, "stream"), dim=DIM, cap=CAP).open()
    arriving = _stream(spark, sf, "embeddings").select(F.col("vec_id").alias("vid"), F.col("embedding").alias("vec"), F.col("vec_id").alias("seq"))
    ingest.ingest(arriving, store).awaitTermination()
    return store.segments_df().select("level", "total_entry", "min_key", "max_key")


def stream_growing_state(spark: SparkSession, sf: str) -> DataFrame:
    """Growing segments of four shards kept as a stream's state: the runs that were sealed."""
    arriving = _stream(spark, sf, "embeddings").select(F.col("vec_id").alias("vid"), F.col("embedding").alias("vec"), F.col("vec_id").alias("seq"))
    found = ingest.drained(ingest.sealed_runs(arriving, CAP // 4, 4), "append")
    return found.groupBy("shard", "run").agg(F.count(F.lit(1)).alias("n"), F.min("vid").alias("min_key"), F.max("vid").alias("max_key"))


def _windows(found: DataFrame) -> DataFrame:
    return found.select(F.unix_seconds("window_start").alias("window_start"), "event_type", "n")


def op_windows(spark: SparkSession, sf: str) -> DataFrame:
    return _windows(ingest.windowed_counts(events(spark, sf)))


def stream_op_windows(spark: SparkSession, sf: str) -> DataFrame:
    return _windows(ingest.drained(ingest.windowed_counts(_stream(spark, sf, "events"))))


def op_sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    return _windows(ingest.windowed_counts(events(spark, sf), "10 minutes", "5 minutes"))


def op_sessions(spark: SparkSession, sf: str) -> DataFrame:
    found = ingest.session_counts(events(spark, sf), "30 minutes")
    return found.select("user_id", F.unix_seconds("window_start").alias("session_start"), "n")


def queries() -> dict[str, Q]:
    found = (
        knn_exact_single, knn_exact_batch, knn_exclude_self, knn_filtered, knn_eps, knn_l2, knn_inner_product, knn_with_metadata, dim_truncate_knn, cosine_pairs_stats, label_distance_stats, vector_norms, vector_sum_by_label, zero_norm_distance,
        upsert_latest, get_latest, delete_tombstone, seal_assign, lsm_layout, compaction_merge, compaction_plan, visibility_counts, search_compacted_only, segments_needing_index, per_segment_topk_merge,
        hnsw_build_graph, hnsw_degree_stats, hnsw_degree_histogram, hnsw_search, hybrid_search, hnsw_recall, store_search, store_search_changed,
        ops_from_events, tracker_state, slo_admission_summary, op_run_lengths, op_stats, command_stats, interarrival, merge_arrivals, result_csv_line, bytes_to_nlb, block_slices, lcg_sequence,
        stream_ingest_seal, stream_growing_state, op_windows, stream_op_windows, op_sliding_windows, op_sessions,
    )
    named = {f.__name__: f for f in found}
    named |= {f"schedule_{p.lower().replace('-', '_')}": _schedule(p) for p in schedule.POLICIES}
    return named | {f"workload_{'insert_only' if n == 'insertonly' else n}": _workload(n) for n in generators.RULES}


# -- SQL -------------------------------------------------------------------------------------------


def _distance(metric: str, a: str, b: str) -> str:
    if metric == "l2":
        return f"sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"
    if metric == "ip":
        return f"-list_inner_product({a}, {b})"
    return f"CASE WHEN list_inner_product({a}, {a}) = 0 OR list_inner_product({b}, {b}) = 0 THEN 1.0 ELSE 1 - list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b}))) END"


def _v(dim: int | None = None) -> str:
    return f"v AS (SELECT vec_id AS vid, CAST({'embedding' if dim is None else f'embedding[1:{dim}]'} AS DOUBLE[]) AS vec, label FROM embeddings)"


def _knn(k: int, metric: str = "cosine", where: str = "TRUE", dim: int | None = None, rows: str = "v", columns: str = "qid, rank, vid, distance", more: str = "") -> str:
    return f"""
WITH {_v(dim)}{more}, d AS (
  SELECT q.vid AS qid, x.vid, x.label, round({_distance(metric, 'q.vec', 'x.vec')}, 6) + 0.0 AS distance
  FROM v q, {rows} x WHERE q.vid % 20 = 0 AND {where}
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY distance, vid) AS INTEGER) AS rank FROM d)
SELECT {columns} FROM r WHERE rank <= {k}"""


_LEVELS = f""", n AS (SELECT *, row_number() OVER (ORDER BY vid) AS ord, count(*) OVER () AS total FROM v),
run AS (SELECT *, CASE WHEN (ord - 1) // {CAP} < (total - 1) // {CAP} THEN (ord - 1) // {CAP} END AS run, (total - 1) // {CAP} AS sealed FROM n),
seg AS (SELECT *, CASE WHEN run IS NULL THEN -1 WHEN run // 3 < sealed // 3 THEN 1 ELSE 0 END AS level,
  CASE WHEN run IS NULL THEN NULL WHEN run // 3 < sealed // 3 THEN 4 * (run // 3) + 3 ELSE 4 * (run // 3) + run % 3 END AS segment_id FROM run)"""

_OPS = """e AS (SELECT event_id, epoch_us(ts) / 1e6 AS t, event_type, value,
    sum(CASE WHEN event_type IN ('click', 'purchase', 'signup') THEN 1 ELSE 0 END) OVER (ORDER BY ts, event_id) AS inserted,
    (SELECT count(*) FROM events WHERE event_type IN ('click', 'purchase', 'signup')) AS total
  FROM events WHERE event_type IN ('click', 'purchase', 'signup', 'view', 'error')),
b AS (SELECT event_id FROM e WHERE event_type = 'error' AND 2 * inserted >= total ORDER BY t, event_id LIMIT 1),
ops AS (SELECT row_number() OVER (ORDER BY t, event_id) AS seq, t, value,
    CASE WHEN event_type = 'view' THEN 'VECTOR_SEARCH' WHEN event_type = 'error' THEN 'INDEX_BUILD' ELSE 'VECTOR_INSERT' END AS op_type
  FROM e WHERE event_type <> 'error' OR event_id IN (SELECT event_id FROM b)),
built AS (SELECT min(seq) AS build_seq FROM ops WHERE op_type = 'INDEX_BUILD')"""

_ADMITTED = f"""{_OPS},
cost AS (SELECT ((SELECT count(*) FROM ops, built WHERE seq < build_seq AND op_type = 'VECTOR_INSERT') // {COSTS.block} // 3) * CAST({COSTS.unindexed} AS DOUBLE) AS search_s),
later AS (SELECT seq, op_type,
    sum(CASE WHEN op_type = 'VECTOR_INSERT' THEN 1 ELSE 0 END) OVER (ORDER BY seq) AS n_insert,
    sum(CASE WHEN op_type = 'VECTOR_SEARCH' THEN 1 ELSE 0 END) OVER (ORDER BY seq) AS n_search
  FROM ops, built WHERE seq > build_seq AND op_type IN ('VECTOR_INSERT', 'VECTOR_SEARCH')),
admitted AS (SELECT seq, op_type, op_type = 'VECTOR_INSERT' OR (CAST({COSTS.checkpoint} AS DOUBLE) + search_s + {COSTS.resume} <= {COSTS.deadline}
    AND n_search <= CASE WHEN search_s > 0 THEN greatest(0, trunc((CAST({COSTS.build * (1 + COSTS.margin)!r} AS DOUBLE) - {COSTS.checkpoint} - {COSTS.resume} - n_insert * CAST({COSTS.insert:.8f} AS DOUBLE) - {COSTS.resume + COSTS.checkpoint}) / search_s)) ELSE 0 END) AS admitted
  FROM later, cost)"""


def _placed(rows: str, with_: str = _OPS) -> str:
    return f"WITH {with_}, placed AS ({rows}) SELECT row_number() OVER (ORDER BY place, seq) AS position, seq, op_type FROM placed"


_PUTS = "puts AS (SELECT user_id AS vid, event_id, value, event_type = 'error' AS deleted, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)"


def oracle_sql() -> dict[str, str]:
    workloads = {f"workload_{'insert_only' if n == 'insertonly' else n}": _workload_sql(n) for n in generators.RULES}
    added = "SELECT {0} AS place, CAST(NULL AS BIGINT) AS seq, '{1}' AS op_type"
    return workloads | {
        "cosine_pairs_stats": f"WITH {_v()}, d AS (SELECT x.label, {_distance('cosine', 'x.vec', 'y.vec')} AS d FROM v x JOIN v y ON x.label = y.label AND x.vid < y.vid) SELECT label, count(*) AS pairs, round(min(d), 6) + 0.0 AS min_distance, round(avg(d), 6) + 0.0 AS avg_distance, round(max(d), 6) + 0.0 AS max_distance FROM d GROUP BY label",
        "knn_exact_single": f"WITH {_v()}, d AS (SELECT x.vid, round({_distance('cosine', 'q.vec', 'x.vec')}, 6) + 0.0 AS distance FROM v q, v x WHERE q.vid = {ONE}) SELECT CAST(row_number() OVER (ORDER BY distance, vid) AS INTEGER) AS rank, vid, distance FROM d QUALIFY rank <= 10",
        "knn_exact_batch": _knn(5),
        "knn_exclude_self": _knn(5, where="q.vid <> x.vid"),
        "knn_filtered": _knn(5, where="q.label = x.label"),
        "knn_eps": _knn(20, where=f"round({_distance('cosine', 'q.vec', 'x.vec')}, 6) <= {EPS}"),
        "knn_l2": _knn(5, "l2"),
        "knn_inner_product": _knn(5, "ip"),
        "knn_with_metadata": _knn(5, columns="qid, rank, vid, label, distance"),
        "dim_truncate_knn": _knn(10, dim=32),
        "label_distance_stats": f"""WITH {_v()}, u AS (SELECT vid, label, list_transform(vec, lambda x: CASE WHEN list_inner_product(vec, vec) > 0 THEN x / sqrt(list_inner_product(vec, vec)) ELSE 0.0 END) AS vec FROM v),
s AS (SELECT label, pos, sum(x) AS x FROM (SELECT label, unnest(vec) AS x, unnest(range(len(vec))) AS pos FROM u) GROUP BY label, pos),
c AS (SELECT label, list(x ORDER BY pos) AS centre FROM s GROUP BY label),
d AS (SELECT u.label, centre, {_distance('cosine', 'u.vec', 'centre')} AS d FROM u JOIN c ON u.label = c.label)
SELECT label, count(*) AS n, CASE WHEN count(*) > 1 THEN round(1 - (list_inner_product(any_value(centre), any_value(centre)) - count(*)) / (count(*) * (count(*) - 1.0)), 6) + 0.0 END AS mean_distance, round(min(d), 6) + 0.0 AS nearest, round(max(d), 6) + 0.0 AS farthest FROM d GROUP BY label""",
        "vector_norms": f"WITH {_v()} SELECT vid, round(sqrt(list_inner_product(vec, vec)), 6) + 0.0 AS norm FROM v",
        "vector_sum_by_label": f"WITH {_v()} SELECT label, CAST(pos AS INTEGER) AS pos, round(sum(x), 4) + 0.0 AS sum FROM (SELECT label, unnest(vec) AS x, unnest(range(len(vec))) AS pos FROM v) GROUP BY label, pos",
        "zero_norm_distance": "SELECT vec_id AS vid, CAST(1.0 AS DOUBLE) AS distance FROM embeddings",
        "upsert_latest": f"WITH {_PUTS} SELECT vid, event_id, value FROM puts WHERE r = 1",
        "get_latest": f"WITH {_PUTS} SELECT vid, value FROM puts WHERE r = 1 AND NOT deleted AND vid IN (SELECT user_id FROM events WHERE event_type = 'view')",
        "delete_tombstone": f"WITH {_PUTS} SELECT vid FROM puts WHERE r = 1 AND NOT deleted",
        "store_search_changed": f"""WITH {_v()}, live AS (SELECT vid, CASE WHEN vid % 7 = 0 THEN list_reverse(vec) ELSE vec END AS vec FROM v WHERE vid % 11 <> 0 AND label <> 3),
d AS (SELECT q.vid AS qid, x.vid, round({_distance('cosine', 'q.vec', 'x.vec')}, 6) + 0.0 AS distance FROM v q, live x WHERE q.vid % 20 = 0)
SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY distance, vid) AS INTEGER) AS rank, vid, distance FROM d QUALIFY rank <= 5""",
        "seal_assign": f"WITH {_v()}{_LEVELS} SELECT vid, CAST(segment_id AS BIGINT) AS segment_id, level FROM seg",
        "lsm_layout": f"WITH {_v()}{_LEVELS} SELECT level, count(*) AS entries, min(vid) AS min_key, max(vid) AS max_key FROM seg GROUP BY level, segment_id",
        "compaction_merge": f"WITH {_PUTS} SELECT vid, event_id, value FROM puts WHERE r = 1",
        "compaction_plan": "SELECT CAST(a AS INTEGER) AS level0, CAST(b AS INTEGER) AS level1, CASE WHEN b >= 399 THEN 1 WHEN a >= 3 THEN 0 ELSE -1 END AS victim_level, CASE WHEN b >= 399 THEN 2 WHEN a >= 3 THEN 3 ELSE 0 END AS victims FROM range(5) x(a), range(451) y(b)",
        "visibility_counts": f"WITH {_v()}{_LEVELS} SELECT 'compacted' AS visibility, count(*) FILTER (WHERE level >= 1) AS visible FROM seg UNION ALL SELECT 'sealed', count(*) FILTER (WHERE level >= 0) FROM seg UNION ALL SELECT 'fresh', count(*) FROM seg",
        "search_compacted_only": _knn(10, where="x.level >= 1", rows="seg", more=_LEVELS),
        "segments_needing_index": f"WITH {_v()}{_LEVELS} SELECT level, CAST(segment_id AS BIGINT) AS segment_id, row_number() OVER (ORDER BY level, segment_id) AS place FROM (SELECT DISTINCT level, segment_id FROM seg WHERE level >= 1 AND segment_id % 2 = 1)",
        "per_segment_topk_merge": _knn(5),
        "ops_from_events": f"WITH {_OPS} SELECT seq, op_type FROM ops",
        "tracker_state": f"""WITH {_OPS}, c AS (SELECT seq, op_type, sum(CASE WHEN op_type = 'VECTOR_INSERT' THEN 1 ELSE 0 END) OVER (ORDER BY seq) AS n FROM ops),
f AS (SELECT coalesce(max(n // {COSTS.block} // 3) FILTER (WHERE op_type = 'INDEX_BUILD'), 0) AS built FROM c)
SELECT seq, CAST(n // {COSTS.block} % 3 AS BIGINT) AS growing, CAST(CASE WHEN seq >= (SELECT build_seq FROM built) THEN built ELSE 0 END AS BIGINT) AS n_indexed, CAST(n // {COSTS.block} // 3 - CASE WHEN seq >= (SELECT build_seq FROM built) THEN built ELSE 0 END AS BIGINT) AS n_unindexed FROM c, f""",
        "schedule_np": f"WITH {_OPS} SELECT seq AS position, seq, op_type FROM ops",
        "schedule_sp_np": _placed("SELECT CASE WHEN op_type = 'INDEX_BUILD' THEN coalesce((SELECT min(o.seq) FROM ops o, built WHERE o.seq > build_seq AND o.op_type <> 'VECTOR_SEARCH') - 0.5, 1e18) ELSE seq END AS place, seq, op_type FROM ops"),
        "schedule_sp_p": _placed(
            f"""SELECT CASE WHEN seq < build_seq THEN 0 WHEN op_type = 'VECTOR_SEARCH' THEN 3 ELSE 5 END AS place, seq, op_type FROM ops, built WHERE seq < build_seq OR (seq > build_seq AND op_type IN ('VECTOR_SEARCH', 'VECTOR_INSERT'))
UNION ALL {added.format(1, 'INDEX_BUILD_ASYNC')} UNION ALL {added.format(6, 'INDEX_BUILD_WAIT')}
UNION ALL SELECT * FROM ({added.format(2, 'PAUSE_BUILD')} UNION ALL {added.format(4, 'RESUME_BUILD')}) WHERE EXISTS (SELECT 1 FROM ops, built WHERE seq > build_seq AND op_type = 'VECTOR_SEARCH')"""
        ),
        "schedule_slo_p": _placed(
            f"""SELECT 0 AS place, seq, op_type FROM ops, built WHERE seq < build_seq UNION ALL SELECT CASE WHEN admitted THEN 3 ELSE 5 END, seq, op_type FROM admitted
UNION ALL {added.format(1, 'INDEX_BUILD_ASYNC')} UNION ALL {added.format(6, 'INDEX_BUILD_WAIT')}
UNION ALL SELECT * FROM ({added.format(2, 'PAUSE_BUILD')} UNION ALL {added.format(4, 'RESUME_BUILD')}) WHERE EXISTS (SELECT 1 FROM admitted WHERE admitted)""",
            _ADMITTED,
        ),
        "slo_admission_summary": f"WITH {_ADMITTED} SELECT op_type, admitted, count(*) AS n, min(seq) AS first_seq FROM admitted GROUP BY op_type, admitted",
        "op_run_lengths": f"WITH {_OPS}, g AS (SELECT *, seq - row_number() OVER (PARTITION BY op_type ORDER BY seq) AS run FROM ops) SELECT op_type, min(seq) AS start_seq, count(*) AS length FROM g GROUP BY op_type, run",
        "op_stats": f"WITH {_OPS}, g AS (SELECT *, row_number() OVER (PARTITION BY op_type ORDER BY seq) AS k FROM ops) SELECT op_type, count(*) AS n, round(avg(value), 6) AS avg_latency, count(*) FILTER (WHERE k % 100 = 0) AS sampled, round(avg(value) FILTER (WHERE k % 100 = 0), 6) AS avg_sampled FROM g GROUP BY op_type",
        "command_stats": f"WITH {_OPS}, g AS (SELECT *, count(*) FILTER (WHERE op_type = 'INDEX_BUILD') OVER (ORDER BY seq) AS print FROM ops) SELECT print, op_type, count(*) AS n, round(avg(value), 6) AS avg_total, round(avg(value - value / 4 - value / 20), 6) AS avg_compute, round(avg(value / 4), 6) AS avg_flash FROM g GROUP BY print, op_type",
        "block_slices": "SELECT doc_id, doc_id // 4 AS slice, doc_id % 4 AS place FROM documents",
        "stream_growing_state": f"WITH n AS (SELECT vec_id, CAST(vec_id % 4 AS INTEGER) AS shard, (row_number() OVER (PARTITION BY vec_id % 4 ORDER BY vec_id) - 1) // {CAP // 4} AS run, (count(*) OVER (PARTITION BY vec_id % 4) - 1) // {CAP // 4} AS sealed FROM embeddings) SELECT shard, run, count(*) AS n, min(vec_id) AS min_key, max(vec_id) AS max_key FROM n WHERE run < sealed GROUP BY shard, run",
        "interarrival": "SELECT event_id, round(coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts, event_id), 0) / 1e6, 6) AS gap, round((epoch_us(ts) - min(epoch_us(ts)) OVER ()) / 1e6, 6) AS elapsed FROM events",
        "merge_arrivals": "SELECT row_number() OVER (ORDER BY ts, event_type, event_id) AS seq, event_type AS source, event_id AS id FROM events WHERE event_type IN ('click', 'view')",
        "result_csv_line": f"SELECT qid AS row, string_agg(concat_ws(',', 'trace', CAST(qid AS VARCHAR), CAST(vid AS VARCHAR), printf('%.6f', distance)), chr(9) ORDER BY rank) AS line FROM ({_knn(5)}) GROUP BY qid",
        "bytes_to_nlb": "SELECT doc_id, CAST(ceil(strlen(text) / 4096.0) AS BIGINT) AS blocks FROM documents",
        "lcg_sequence": f"WITH RECURSIVE s(i, value) AS (SELECT CAST(1 AS BIGINT), ({scalar.LCG_SEED}::BIGINT * {scalar.LCG_A} + {scalar.LCG_C}) % {scalar.LCG_M} UNION ALL SELECT i + 1, (value * {scalar.LCG_A} + {scalar.LCG_C}) % {scalar.LCG_M} FROM s WHERE i < 100) SELECT i, value FROM s",
        "op_windows": "SELECT epoch_us(ts) // 600000000 * 600 AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
        "stream_op_windows": "SELECT epoch_us(ts) // 600000000 * 600 AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
        "op_sliding_windows": "SELECT w AS window_start, event_type, count(*) AS n FROM (SELECT event_type, unnest([epoch_us(ts) // 300000000 * 300, epoch_us(ts) // 300000000 * 300 - 300]) AS w FROM events) GROUP BY ALL",
        "op_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 1800000000 THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, epoch_us(min(ts)) // 1000000 AS session_start, count(*) AS n FROM s GROUP BY user_id, session",
        "stream_ingest_seal": f"WITH {_v()}{_LEVELS} SELECT level, count(*) AS total_entry, min(vid) AS min_key, max(vid) AS max_key FROM seg WHERE level >= 0 GROUP BY level, segment_id",
    }
