"""Connected components by repeated contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import Workspace


def components(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(node, label) for every node of edges (a, b): label is one of the component's nodes.

    Each round, every node points at the smallest of itself and its neighbours, pointers are followed once
    more, and the graph is contracted to the nodes pointed at. The graph shrinks by a constant factor or
    better, so rounds grow with the logarithm of the longest path. Each round is a written table;
    nothing but its emptiness comes to the driver.
    """
    edges = work.table(edges.select("a", "b").where("a <> b").distinct(), f"{name}-edges-0")
    labels = None
    turn = 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to"))
        step = work.table(step, f"{name}-step-{turn}")
        further = step.select(F.col("a").alias("to"), F.col("to").alias("on"))
        step = work.table(step.join(further, "to", "left").select("a", F.coalesce("on", "to").alias("to")), f"{name}-jump-{turn}")
        if labels is None:
            labels = step.select(F.col("a").alias("node"), F.col("to").alias("label"))
        else:
            moved = step.select(F.col("a").alias("label"), "to")
            labels = labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
            labels = work.table(labels, f"{name}-labels-{turn}")
        left = edges.join(step, "a").select("b", F.col("to").alias("x"))
        right = left.join(step.withColumnRenamed("a", "b"), "b").select("x", F.col("to").alias("y")).where("x <> y")
        turn += 1
        edges = work.table(right.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), f"{name}-edges-{turn}")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
