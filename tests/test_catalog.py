import pytest

from tests.oracle import connection, same
from tidevec.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    same(QUERIES[name](spark, sf_dir), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_graph_recall(spark, sf_dir):
    rows = QUERIES["hnsw_recall"](spark, sf_dir).collect()
    assert sum(r["recall"] for r in rows) / len(rows) >= 0.9
