import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidevec.operators import lsm
from tidevec.operators.prefix import numbered, running, with_previous

CAP = 8


@given(st.integers(0, 1100))
@settings(max_examples=60, deadline=None)
def test_directory_follows_the_closed_form(sealed):
    found = lsm.directory(sealed)
    by = {k: sum(s.level == k for s in found) for k in range(4)}
    assert sum(s.last - s.first + 1 for s in found) == sealed
    if sealed // 3 < 399:
        shape = lsm.shape_of(sealed * CAP + 1, CAP)
        assert (by[0], by[1]) == (shape["level0"], shape["level1"])
    assert by[0] < 3 and by[1] < 399


@pytest.mark.parametrize("n", [0, 1, CAP - 1, CAP, CAP + 1, 3 * CAP, 3 * CAP + 1])
def test_put_shapes(spark, n):
    rows = spark.range(n).selectExpr("id AS vid", "id + 1 AS ord")
    by = {r.level: r["count"] for r in lsm.assign(rows, "ord", CAP).groupBy("level").count().collect()}
    shape = lsm.shape_of(n, CAP)
    assert by.get(-1, 0) == shape["growing"] and by.get(0, 0) == shape["level0"] * CAP and by.get(1, 0) == shape["level1"] * 3 * CAP


def test_newest_wins(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 3), (1, "c", 2), (2, "x", 1)], "vid long, v string, seq long")
    assert sorted((r.vid, r.v) for r in lsm.newest(rows).collect()) == [(1, "b"), (2, "x")]


def test_highest_level_goes_first():
    assert lsm.victims({0: 3, 1: 399}) == (1, 2) and lsm.victims({0: 3}) == (0, 3) and lsm.victims({0: 2}) is None and lsm.victims({2: 19}) == (2, 2)


def test_unknown_visibility(spark):
    with pytest.raises(ValueError):
        lsm.visible(spark.range(1).selectExpr("id AS level"), "all")


def test_prefix_operators(spark):
    rows = spark.range(1000).selectExpr("(id * 7919) % 1000 AS k", "id % 3 AS x").repartition(7)
    got = {r.k: (r.n, r.total) for r in running(rows, ["k"], {"n": F.lit(1), "total": F.col("x")}).collect()}
    total = 0
    for k, x in sorted((r.k, r.x) for r in rows.collect()):
        total += x
        assert got[k] == (k + 1, total)
    assert sorted((r.seq, r.k) for r in numbered(rows, ["k"]).collect()) == [(i + 1, i) for i in range(1000)]
    before = {r.k: r.p for r in with_previous(rows, ["k"], "k", "p").collect()}
    assert before[0] is None and all(before[k] == k - 1 for k in range(1, 1000))


def test_prefix_operators_on_nothing(spark):
    none = spark.range(0).selectExpr("id AS k")
    assert numbered(none, ["k"]).count() == 0 and with_previous(none, ["k"], "k", "p").count() == 0
