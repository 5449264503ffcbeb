import pytest

import __spark_entry__ as e
from driftgate import queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_its_sql(spark, oracle, name):
    oracle(spark, queries.QUERIES[name], queries.SQL[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_other_queries_give_rows(spark, name):
    assert queries.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
