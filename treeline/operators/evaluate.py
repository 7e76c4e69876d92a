"""Retrieval quality: gold resolution, ranks, MRR, recall at k, per-tag breakdown, and drawing question sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KS = (1, 5, 10, 20)


def resolve_gold(questions: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gold, unresolved counts): gold rows (id, doc_id, node_id or null) that exist in the index. questions: id,
    relevant array<struct<doc_id, node_id>>."""
    from treeline.operators.navigate import resolve_node_ids

    wanted = questions.select("id", F.explode("relevant").alias("r")).select("id", F.col("r.doc_id").alias("doc_id"), F.col("r.node_id").alias("asked")).distinct()
    docs = nodes.select("doc_id").distinct()
    whole = wanted.where("asked is null").join(docs, "doc_id", "left_semi").select("id", "doc_id", F.lit(None).cast("string").alias("node_id"))
    pinned = wanted.where("asked is not null")
    found = resolve_node_ids(pinned.select("doc_id", "asked"), nodes)
    hit = pinned.join(found, ["doc_id", "asked"], "left")
    gold = whole.unionByName(hit.where("node_id is not null").select("id", "doc_id", "node_id")).distinct()
    lost = wanted.groupBy("id").agg(F.count("*").alias("wanted")).join(gold.groupBy("id").agg(F.count("*").alias("found")), "id", "left")
    return gold, lost.select("id", (F.col("wanted") - F.coalesce("found", F.lit(0))).alias("unresolved"))


def question_ranks(ranking: DataFrame, gold: DataFrame) -> DataFrame:
    """(id, doc_id, node_id, rank): place of each gold entry in the ranking (id, rank, doc_id, node_id) once repeats are
    gone; a document's place is that of its first node. Null: not found."""
    first = ranking.groupBy("id", "doc_id", "node_id").agg(F.min("rank").alias("r"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("r")).cast("int"))
    docs = ranked.groupBy("id", "doc_id").agg(F.min("rank").alias("rank"))
    nodes = gold.where("node_id is not null").join(ranked.select("id", "doc_id", "node_id", "rank"), ["id", "doc_id", "node_id"], "left")
    whole = gold.where("node_id is null").join(docs, ["id", "doc_id"], "left")
    return nodes.select("id", "doc_id", "node_id", "rank").unionByName(whole.select("id", "doc_id", "node_id", "rank"))


def doc_ranks(ranking: DataFrame, gold: DataFrame) -> DataFrame:
    """(id, doc_id, rank) of every gold document, pinned to a node or not."""
    first = ranking.groupBy("id", "doc_id", "node_id").agg(F.min("rank").alias("r"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("r")).cast("int"))
    docs = ranked.groupBy("id", "doc_id").agg(F.min("rank").alias("rank"))
    return gold.select("id", "doc_id").distinct().join(docs, ["id", "doc_id"], "left")


def per_question(ranks: DataFrame, prefix: str = "r", ks: tuple[int, ...] = KS) -> DataFrame:
    """(id, rr, <prefix>@k...): reciprocal rank of the best gold entry and recall at each k."""
    recall = [(F.count_if(F.col("rank") <= k) / F.count("*")).alias(f"{prefix}{k}") for k in ks]
    return ranks.groupBy("id").agg(F.coalesce(F.lit(1.0) / F.min("rank"), F.lit(0.0)).alias("rr"), *recall)


def aggregate(node: DataFrame, doc: DataFrame, ks: tuple[int, ...] = KS, by: list[str] | None = None) -> DataFrame:
    """Means over questions: node figures over questions with node gold, document figures over those with any. node
    and doc: per_question results, with the columns of `by` if given."""
    mean = lambda df, names: df.groupBy(*(by or [])).agg(F.count("*").alias(names[0]), *[F.round(F.avg(c), 6).alias(c) for c in names[1:]])
    a = mean(node.withColumnRenamed("rr", "mrr"), ["n_node", "mrr", *[f"r{k}" for k in ks]])
    b = mean(doc, ["n_doc", *[f"doc_r{k}" for k in ks]])
    return a.join(b, by, "full_outer") if by else a.join(b)


def by_tag(per: DataFrame, questions: DataFrame) -> DataFrame:
    """per-question figures once per tag."""
    return per.join(questions.select("id", F.explode("tags").alias("tag")), "id")


def draw_nodes(nodes: DataFrame, n: int = 30, per_doc: int = 1, least: int = 800, most: int = 8000, seed: int = 0) -> DataFrame:
    """n nodes to draft questions from: per_doc of every document first, then any; order by a seeded hash of the key."""
    from treeline.operators.navigate import node_lengths

    draw = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.col("node_id"))
    rows = node_lengths(nodes, least, most).withColumn("draw", draw)
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("draw", "node_id"))
    return rows.withColumn("late", nth > per_doc).orderBy("late", "draw", "doc_id", "node_id").limit(n)
