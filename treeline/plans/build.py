"""Whole journeys: Markdown to trees, pages to trees, questions to evidence, rankings to quality figures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.operators import evaluate, search, toc, tree
from treeline.plans import seam
from treeline.session import settled


def markdown_trees(files: DataFrame, thin_tokens: int | None = None, summarise: Callable[[Column], Column] | None = None, with_summaries: bool = False) -> DataFrame:
    """Flat tree rows of Markdown texts (doc_id, text)."""
    sections = tree.markdown_sections(tree.markdown_lines(files))
    rows = tree.depths(tree.parents_from_levels(sections))
    if thin_tokens:
        rows = tree.thinned(tree.section_tokens(rows), thin_tokens).drop("subtree_tokens")
    rows = tree.subtree_ends(tree.numbered(rows))
    return seam.summaries(rows, summarise) if with_summaries else rows


def page_trees(pages: DataFrame, toc_text: DataFrame | None = None) -> DataFrame:
    """Flat tree rows (as codes_to_tree gives them) of documents in pages.

    Contents pages are found by their looks and parsed; items are aligned by the most frequent offset, verified one
    and all, and repaired. Documents without usable contents are outlined by their headings instead. Every step looks at the
    items several times, so each is settled before the next.
    """
    run = toc.toc_pages(pages, toc.looks_like_toc("page_text"))
    texts = settled(pages.join(run, ["doc_id", "page_no"]).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "page_text"))), lambda x: x["page_text"]), "\n").alias("text"), F.max("page_no").alias("last_toc_page")))
    parsed = settled(toc.parse(texts))
    kept = settled(toc.keep_last(parsed))
    good = settled(toc.accepted(toc.parse_stats(texts, parsed, kept)).select("doc_id"))
    kept = settled(kept.join(good, "doc_id", "left_semi"))
    body = pages.join(texts.select("doc_id", "last_toc_page"), "doc_id").where("page_no > last_toc_page").drop("last_toc_page")
    found = settled(seam.find_indices(kept.withColumn("physical_index", F.lit(None).cast("int")), body))
    offsets = toc.page_offset(found)
    items = toc.add_offset(kept, offsets)
    items = toc.truncate_indices(items, pages.groupBy("doc_id").agg(F.count("*").alias("n_pages")))
    items = settled(seam.find_indices(items, pages))
    _, wrong = toc.verify(items, pages, every=True)
    items = settled(toc.without_index(toc.repair(items, wrong, pages)).drop("page"))
    rest = pages.join(good, "doc_id", "left_anti")
    items = items.select("doc_id", "seq", "structure", "title", "physical_index").unionByName(seam.heading_items(rest))
    items = tree.with_preface(items.join(pages.groupBy("doc_id").agg(F.max("page_no").alias("__n")), "doc_id").where("physical_index <= __n").drop("__n"))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")) - 1
    items = settled(items).withColumn("seq", order.cast("int"))
    at = pages.select("doc_id", F.col("page_no").alias("physical_index"), "page_text")
    from treeline.functions.text import title_at_start

    items = items.join(at, ["doc_id", "physical_index"], "left").withColumn("appear_start", F.coalesce(title_at_start("title", "page_text", latest=0), F.lit("no"))).drop("page_text")
    items = settled(items)
    ends = pages.groupBy("doc_id").agg(F.max("page_no").alias("end"))
    return tree.codes_to_tree(tree.assign_spans(items, ends))


def evidence_for(
    nodes: DataFrame, keys: list[str], columns: list[str], questions: DataFrame, qkey: str = "id", qcolumn: str = "question", vectors: DataFrame | None = None,
    qvectors: DataFrame | None = None, mode: str = "auto", pool: int = 50, k: int = 8, per_doc: int = 0, scorer: Callable | None = None, node_cap: int = 8000, total_cap: int = 60000,
) -> tuple[DataFrame, str]:
    """Evidence for every question, and how it was found: BM25 and vectors (keys, embedding) for the questions' own
    (qkey, embedding), fused, reranked, diversified, cut to k, and only then joined with texts under a budget."""
    by = [qkey]
    lexical = search.search(nodes, keys, columns, questions, qkey, qcolumn, pool)
    near = search.vector_search_all(vectors, keys, "embedding", qvectors, qkey, "embedding", pool) if vectors is not None and qvectors is not None else None
    rows, used = search.hybrid(lexical, near, keys, mode, by)
    if scorer:
        asked = questions.select(qkey, F.col(qcolumn).alias("__question"))
        pool_rows = rows.join(nodes, keys).join(asked, qkey)
        rows = search.rerank(pool_rows, F.col("__question"), F.concat_ws("\n", *columns), scorer, by=by).select(*rows.columns, "rerank")
    rows = search.diversify(rows, per_doc, keys[0], by=by)
    rows = search.top(rows, [F.col("position")], k, by, "__nth").drop("__nth")
    # k rows a question: texts come to them, and only those of their nodes are moved.
    few = questions.limit(search.BROADCAST_QUERIES + 1).count() <= search.BROADCAST_QUERIES
    rows = (F.broadcast(rows) if few else rows).join(nodes.select(*keys, columns[-1]), keys)
    return search.evidence(rows, columns[-1], node_cap, total_cap, by=by), used


def answer_evidence(
    nodes: DataFrame, keys: list[str], columns: list[str], question: str, query_vector: list[float] | None = None, vectors: DataFrame | None = None, **options
) -> tuple[DataFrame, str]:
    """evidence_for one question, given as a text and perhaps a vector."""
    spark = nodes.sparkSession
    asked = spark.range(1).select(F.lit(0).alias("__id"), F.lit(question).alias("question"))
    vector = spark.createDataFrame([(0, [float(x) for x in query_vector])], "__id int, embedding array<double>") if query_vector else None
    rows, used = evidence_for(nodes, keys, columns, asked, "__id", "question", vectors, vector, **options)
    return rows.drop("__id"), used


CONFIGURATIONS = ("bm25", "vector", "hybrid", "hybrid+rerank")


def compared(
    nodes: DataFrame, keys: tuple[str, str], columns: list[str], questions: DataFrame, vectors: DataFrame | None = None, qvectors: DataFrame | None = None,
    scorer: Callable = search.overlap_scorer, pool: int = 50, configurations: tuple[str, ...] = CONFIGURATIONS,
) -> DataFrame:
    """Figures of every configuration over a fixture, a row each (configuration first). Questions are (id, question,
    relevant); vectors (keys, embedding), qvectors (id, embedding). All questions are one plan."""
    known = nodes.select(F.col(keys[0]).alias("doc_id"), F.col(keys[1]).cast("string").alias("node_id"))
    gold, _ = evaluate.resolve_gold(questions, known)
    lexical = search.search(nodes, list(keys), columns, questions, "id", "question", pool)
    near = search.vector_search_all(vectors, list(keys), "embedding", qvectors, "id", "embedding", pool) if vectors is not None else None
    out = None
    for name in configurations:
        if name != "bm25" and near is None:
            continue
        mode = {"bm25": "bm25", "vector": "vector"}.get(name, "auto")
        rows, _ = search.hybrid(lexical, near, list(keys), mode, ["id"])
        if name.endswith("+rerank"):
            full = rows.join(nodes, list(keys)).join(questions.select("id", F.col("question").alias("__question")), "id")
            rows = search.rerank(full, F.col("__question"), F.concat_ws("\n", *columns), scorer, by=["id"])
        rows = rows.where(F.col("position") <= pool)
        ranking = rows.select("id", F.col("position").alias("rank"), F.col(keys[0]).alias("doc_id"), F.col(keys[1]).cast("string").alias("node_id"))
        pinned = evaluate.per_question(evaluate.question_ranks(ranking, gold.where("node_id is not null")))
        whole = evaluate.per_question(evaluate.doc_ranks(ranking, gold), "doc_r").drop("rr")
        one = evaluate.aggregate(pinned, whole).select(F.lit(name).alias("configuration"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def quality(nodes: DataFrame, keys: tuple[str, str], columns: list[str], questions: DataFrame, pool: int = 50) -> DataFrame:
    """Figures of BM25 over a fixture: one row. All questions are one plan."""
    doc, node = keys
    ranking = search.search(nodes, [doc, node], columns, questions, "id", "question", pool)
    ranking = ranking.select("id", "rank", F.col(doc).alias("doc_id"), F.col(node).cast("string").alias("node_id"))
    known = nodes.select(F.col(doc).alias("doc_id"), F.col(node).cast("string").alias("node_id"))
    gold, _ = evaluate.resolve_gold(questions, known)
    pinned = evaluate.per_question(evaluate.question_ranks(ranking, gold.where("node_id is not null")))
    whole = evaluate.per_question(evaluate.doc_ranks(ranking, gold), "doc_r").drop("rr")
    return evaluate.aggregate(pinned, whole)
