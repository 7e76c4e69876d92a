import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import assert_same

from treeline.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert assert_same(spark, registry.queries()[name], registry.oracle_sql()[name], "sf0.001") > 0
