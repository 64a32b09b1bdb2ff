import pytest

from rankloom.llm import queries as q
from tests.oracle import assert_same, connect


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_equals_sql(spark, data, con, name):
    assert_same(q.QUERIES[name](spark, data), con, q.SQL[name])


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.SQL)))
def test_runs_without_sql(spark, data, name):
    assert q.QUERIES[name](spark, data).count() >= 0
