import pytest

from hunkweave.llm import registry
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_agrees_with_sql(spark, data, duck, name):
    same(registry.QUERIES[name](spark, data), duck.execute(registry.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_runs(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() >= 0
