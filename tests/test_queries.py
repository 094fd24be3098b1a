import pytest

from hunkweave.plans import registry
from tests.oracle import same

WITHOUT_SQL = sorted(set(registry.QUERIES) - set(registry.SQL))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_agrees_with_sql(spark, data, duck, name):
    same(registry.QUERIES[name](spark, data), duck.execute(registry.SQL[name]).df())


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_query_runs(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() >= 0


def test_every_sql_has_a_query():
    assert set(registry.SQL) <= set(registry.QUERIES)
