import pytest

from rankloom.plans import fact_queries, general_queries, retrieval_queries
from tests.oracle import assert_same, connect

MODULES = (general_queries, retrieval_queries, fact_queries)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, data, con, name):
    assert_same(QUERIES[name](spark, data), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns
    assert df.count() >= 0


def test_every_sql_has_a_query():
    assert not set(SQL) - set(QUERIES)
