from compare import assert_same

from treeline import registry
from treeline.operators import search


def test_doc_score_counts_every_hit(spark, monkeypatch):
    """All hits of a question count; none is dropped by a top-k on the way."""
    monkeypatch.setattr(search, "top", lambda rows, by, k, *a, **b: rows.limit(3))
    assert assert_same(spark, registry.queries()["doc_score"], registry.oracle_sql()["doc_score"], "sf0.001") > 0
