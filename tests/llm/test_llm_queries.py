import pytest

import __spark_entry__ as e

pytest.importorskip("driftgate.llm.registry")
from driftgate.llm import registry  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_agrees_with_its_sql(spark, oracle, name):
    oracle(spark, registry.QUERIES[name], registry.SQL[name], SMALL)


def test_operators_and_the_pipeline():
    names = [n for n in e.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 1 + len(names)))
    assert "pipeline" in e.queries()
