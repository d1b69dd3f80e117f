import numpy as np
import pytest

from tidevec.functions.scalar import babylonian_sqrt_product, fast_rsqrt, level_of
from tidevec.operators import hnsw, planner, search

AXIS = [(0, [1.0, 0.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0, 0.0]), (2, [-1.0, 0.0, 0.0, 0.0]), (3, [0.0, -1.0, 0.0, 0.0]), (4, [0.0, 0.0, 0.0, 0.0])]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vid long, vec array<float>")


def test_axis_zero_and_ties(spark):
    got = search.nearest(frame(spark, AXIS), [1.0, 0, 0, 0], 5).orderBy("rank").collect()
    assert [(r.vid, r.distance) for r in got] == [(0, 0.0), (1, 1.0), (3, 1.0), (4, 1.0), (2, 2.0)]


def test_batch_equals_single(spark):
    v = frame(spark, AXIS)
    q = v.selectExpr("vid AS qid", "vec AS qvec")
    batch = {(r.qid, r.rank): (r.vid, r.distance) for r in search.nearest_batch(v, q, 3).collect()}
    for qid, vec in AXIS:
        assert [batch[qid, k] for k in (1, 2, 3)] == [(r.vid, r.distance) for r in search.nearest(v, vec, 3).orderBy("rank").collect()]


def test_query_blocks_give_the_same(spark, monkeypatch):
    v = frame(spark, AXIS)
    q = v.selectExpr("vid AS qid", "vec AS qvec")
    want = sorted(search.nearest_batch(v, q, 2).collect())
    blocks = search.query_blocks
    monkeypatch.setattr(search, "query_blocks", lambda queries: blocks(queries, 40))
    assert sorted(search.nearest_batch(v, q, 2).collect()) == want


@pytest.mark.parametrize("k", [0, -1, 21, True, 1.5])
def test_k_is_checked(k):
    with pytest.raises(search.VectorError):
        search.check_k(k)


def test_vector_is_checked():
    with pytest.raises(search.VectorError):
        search.check_vector([1.0, 2.0], 3)
    with pytest.raises(search.VectorError):
        search.check_vector([[1.0, 2.0, 3.0]], 3)


def test_empty_tables(spark):
    v, none = frame(spark, AXIS), frame(spark, AXIS).limit(0)
    assert search.nearest(none, [1.0, 0, 0, 0], 3).count() == 0
    assert search.nearest_batch(none, v.selectExpr("vid AS qid", "vec AS qvec"), 3).count() == 0
    assert search.nearest_batch(v, none.selectExpr("vid AS qid", "vec AS qvec"), 3).count() == 0


def test_graph_invariants_and_recall():
    rng = np.random.default_rng(3)
    x, keys = rng.normal(size=(600, 16)), np.arange(600) * 7
    params = hnsw.Params()
    g = hnsw.build(keys, x, params)
    again = hnsw.build(keys[::-1], x[::-1], params)
    assert g.links == again.links and g.top == again.top
    for level, by in enumerate(g.links):
        for node, links in by.items():
            assert len(links) <= params.links(level) and node not in links and len(set(links)) == len(links)
            assert all(0 <= n < 600 and g.levels[n] >= level for n in links)
    exact = np.argsort(search.pairwise(x[:50], x, "cosine"), axis=1, kind="stable")[:, :10]
    hits = [len({k for _, k in g.search(x[i], 10)} & set((keys[exact[i]]).tolist())) for i in range(50)]
    assert np.mean(hits) / 10 >= 0.9


def test_small_graphs():
    for n in (1, 2, 3):
        g = hnsw.build(np.arange(n), np.eye(3)[:n])
        assert [k for _, k in g.search(np.eye(3)[0], 5)][0] == 0 and len(g.search(np.eye(3)[0], 5)) == n


def test_early_exit_skips_scans_of_satisfied_queries(spark):
    rows = [(0, i, [1.0, 0.001 * i]) for i in range(6)] + [(1, 10 + i, [1.0, 0.0005 * i]) for i in range(3)]
    v = spark.createDataFrame(rows, "segment_id long, vid long, vec array<float>")
    graphs = hnsw.build_graphs(v.filter("segment_id = 0"))
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, qvec array<float>")
    exact = {r.vid for r in planner.hybrid(v, graphs, q, 3).collect()}
    early = {r.vid for r in planner.hybrid(v, graphs, q, 3, early_exit=0.1).collect()}
    assert exact & {10, 11, 12} and not early & {10, 11, 12}


def test_approximations():
    x = np.array([0.0, 0.25, 1.0, 2.0, 1e6], np.float32)
    assert np.allclose(fast_rsqrt(x)[1:], 1 / np.sqrt(x[1:]), rtol=1e-4) and fast_rsqrt(x)[0] == 0
    assert abs(babylonian_sqrt_product(9, 16) - 12) < 1e-9 and babylonian_sqrt_product(0, 4) == 0
    levels = level_of(np.arange(20000))
    assert levels.max() == 2 and 0.08 < (levels >= 1).mean() < 0.12
