"""Sinks: tree files, JSON lines, staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.operators import tree


def write_trees(nodes: DataFrame, documents: DataFrame, path: str) -> None:
    """One JSON object per line and document: doc_name, doc_description if any, structure."""
    nested = tree.nest(nodes).join(documents.select("doc_id", "doc_name", "doc_description"), "doc_id")
    head = F.to_json(F.struct("doc_name", F.nullif("doc_description", F.lit("")).alias("doc_description")))
    line = F.concat(F.expr("substring(h, 1, length(h) - 1)"), F.lit(', "structure": '), "tree", F.lit("}"))
    nested.withColumn("h", head).select("doc_id", line.alias("value")).write.mode("overwrite").partitionBy("doc_id").text(path)


def write_candidates(questions: DataFrame, path: str) -> None:
    """Drafted questions as JSON lines, least overlap first."""
    questions.orderBy("overlap", "id").write.mode("overwrite").json(path)


def stage(df: DataFrame, path: str) -> DataFrame:
    """Write a stage and read it back: a later failure resumes here, and lineage is cut."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
