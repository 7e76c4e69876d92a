"""Registered queries of the document engine and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from treeline.plans.queries import ALL

FLAGSHIP = "bm25_topk"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q.run for k, q in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q.sql for k, q in ALL.items() if q.sql}
