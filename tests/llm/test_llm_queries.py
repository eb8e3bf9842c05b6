import pytest
from compare import SMALL, assert_same, connect

from tidemark.llm import queries


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, con, name):
    assert_same(queries.QUERIES[name](spark, SMALL), con, queries.ORACLES[name])
