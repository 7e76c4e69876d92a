import pytest
from compare import assert_same

from treeline import registry

ORACLES = registry.oracle_sql()
EMPTY_AT_SMALL = {"large_nodes", "missing_embeddings"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    n = assert_same(spark, registry.queries()[name], ORACLES[name], "sf0.001")
    assert n > 0 or name in EMPTY_AT_SMALL


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(ORACLES)))
def test_query_runs(spark, name):
    registry.queries()[name](spark, "/root/testdata/sf0.001").collect()
