"""Operators that no registered query reaches, on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from treeline.functions import text as T
from treeline.operators import index, search, toc, tree
from treeline.plans import seam
from treeline.sources import readers, sinks


def values(spark, column, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in rows.select("i", column("t").alias("v")).orderBy("i").collect()]


def test_text_functions(spark):
    assert values(spark, T.dots_to_colon, "One ...... 3", "Two . . . . . . 4", "a... b") == ["One :  3", "Two : 4", "a... b"]
    assert values(spark, T.safe_name, "a/b/c", "", None, "plain") == ["a-b-c", "Untitled", "Untitled", "plain"]
    drafted = ['{"question": "Why so?"}', 'Question: "What is it?"\nmore', "\n  who? ", "", None]
    assert values(spark, T.question_text, *drafted) == ["Why so?", "What is it?", "who?", None, None]
    rows = spark.createDataFrame([(0.5, 0.1, -2.0), (None, 0.1, -2.0), (None, None, -2.0)], "a double, b double, c double")
    assert [r.v for r in rows.select(T.score_label("a", "b", "c").alias("v")).collect()] == ["rerank=0.500", "rrf=0.1000", "score=-2.000"]


def levels(spark, n=12):
    rows = [(d, i, 1 + i % 3, f"t{i}", "x" * i) for d in (1, 2) for i in range(n)]
    nodes = tree.depths(tree.parents_from_levels(spark.createDataFrame(rows, "doc_id int, seq int, level int, title string, text string")))
    return tree.subtree_ends(tree.numbered(nodes))


def test_tails_columns_and_order(spark):
    items = spark.createDataFrame([(d, i) for d in (1, 2) for i in range(20)], "doc_id int, seq int")
    assert sorted((r.doc_id, r.seq) for r in toc.tail(items, 3).collect()) == [(d, i) for d in (1, 2) for i in (17, 18, 19)]
    nodes = levels(spark)
    assert "text" not in tree.without(nodes, "text", "absent").columns
    assert tree.ordered(nodes, ["title", "absent", "doc_id"]).columns[:2] == ["title", "doc_id"]


def test_descriptions_and_their_views(spark):
    nodes = levels(spark).withColumn("summary", F.concat(F.lit("about "), "title"))
    got = {r.doc_id: r.doc_description for r in seam.descriptions(nodes).collect()}
    assert got[1] == "; ".join(f"t{i}" for i in range(0, 12, 3))
    view = tree.description_view(nodes.where("doc_id = 1"), 1, 5).collect()
    assert {r.depth for r in view} == {0} and all(r.summary == "about…" for r in view)
    every = nodes.where("doc_id = 1").collect()
    size = lambda d, c: sum(len(r.title) + min(len(r.summary), c) + 8 for r in every if d is None or r.depth < d)
    for budget in (10_000, 50, 40, 30, 20, 12, 1):
        want = next((i for i, (d, c) in enumerate(tree.DESCRIPTION_LADDER) if (size(d, c) + 3) // 4 <= budget), len(tree.DESCRIPTION_LADDER) - 1)
        assert {r.rung for r in tree.description_rung(nodes, budget).collect()} == {want}


def test_expand_large(spark):
    pages = spark.createDataFrame([(d, n, "w" * 40, 10) for d in (1, 2) for n in range(1, 41)], "doc_id int, page_no int, page_text string, n_tokens int")
    nodes = spark.createDataFrame([(1, 0, "a", 1, 40), (2, 0, "b", 1, 3), (2, 1, "c", 4, 20)], "doc_id int, seq int, title string, start_index int, end_index int")

    def halves(big, _):
        half = F.floor((F.col("start_index") + F.col("end_index")) / 2).cast("int")
        cut = big.select("doc_id", F.col("seq").alias("parent_seq"), "title", "start_index", "end_index", half.alias("half"))
        left = cut.select("doc_id", "parent_seq", F.concat("title", F.lit("l")).alias("title"), "start_index", F.col("half").alias("end_index"))
        right = cut.select("doc_id", "parent_seq", F.concat("title", F.lit("r")).alias("title"), (F.col("half") + 1).alias("start_index"), "end_index")
        return left.unionByName(right)

    out = tree.expand_large(nodes, pages, halves, max_pages=10, max_tokens=50).collect()
    spans = {(r.doc_id, r.title): (r.seq, r.start_index, r.end_index) for r in out}
    assert len({(r.doc_id, r.seq) for r in out}) == len(out)
    assert spans[1, "a"][1:] == (1, 1) and spans[2, "b"] == (0, 1, 3) and spans[2, "c"][2] == 4
    leaves = [v for (d, t), v in spans.items() if d == 1 and not any((1, t + x) in spans for x in "lr")]
    assert sorted(v[1:] for v in leaves) == [(1, 10), (11, 20), (21, 30), (31, 40)]


def test_sinks_and_sources(spark, tmp_path):
    nodes = levels(spark, 4).withColumn("node_id", F.lpad(F.col("node_seq").cast("string"), 4, "0"))
    documents = spark.createDataFrame([(1, "one", "about one"), (2, "two", "")], "doc_id int, doc_name string, doc_description string")
    sinks.write_trees(nodes, documents, f"{tmp_path}/trees")
    raw = {r.doc_id: json.loads(r.value) for r in spark.read.text(f"{tmp_path}/trees").collect()}
    assert raw[1]["doc_name"] == "one" and raw[1]["doc_description"] == "about one" and "doc_description" not in raw[2]
    assert [n["title"] for n in raw[1]["structure"]] == ["t0", "t3"]
    questions = spark.createDataFrame([(1, "b?", 0.5), (2, "a?", 0.1)], "id int, question string, overlap double")
    sinks.write_candidates(questions, f"{tmp_path}/questions")
    assert [r.id for r in spark.read.json(f"{tmp_path}/questions").orderBy("overlap").collect()] == [2, 1]
    kept = sinks.stage(questions, f"{tmp_path}/stage")
    assert kept.schema == questions.schema and kept.count() == 2
    (tmp_path / "md").mkdir()
    (tmp_path / "md" / "x.md").write_text("# A\nb\n")
    (tmp_path / "md" / "y.txt").write_text("no")
    got = readers.markdown_files(spark, f"{tmp_path}/md").collect()
    assert [(r.doc_id, r.text, r.line_count) for r in got] == [("x", "# A\nb\n", 3)]


@pytest.mark.parametrize("limit", [10_000, 2])
def test_many_query_vectors_in_blocks(spark, monkeypatch, limit):
    monkeypatch.setattr(search, "BROADCAST_QUERIES", limit)
    rows = [(i, [float((i * j) % 7 - 3) for j in range(1, 5)]) for i in range(30)] + [(99, [1.0, 2.0]), (98, None), (97, [0.0] * 4)]
    vectors = spark.createDataFrame(rows, "k int, embedding array<double>")
    asked = vectors.where("k in (1, 2, 3, 5, 97, 98, 99)").withColumnRenamed("k", "id")
    got = search.vector_search_all(vectors, ["k"], "embedding", asked, "id", "embedding", 4)
    for q in (1, 2, 3, 5, 99):
        one = search.vector_search(vectors, ["k"], "embedding", dict(rows)[q], 4).collect()
        assert sorted((r.rank, r.k) for r in got.where(F.col("id") == q).collect()) == sorted((r.rank, r.k) for r in one)
    assert got.where("id in (97, 98)").count() == 0


def test_rows_for_large_rankings(spark, monkeypatch):
    nodes = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "k int, text string")
    ranked = spark.createDataFrame([(i, 20 - i) for i in range(10)], "k int, rank int")
    want = [r.text for r in index.rows_for_keys(nodes, ranked, ["k"]).collect()]
    monkeypatch.setattr(index, "BROADCAST_KEYS", 3)
    assert [r.text for r in index.rows_for_keys(nodes, ranked, ["k"]).collect()] == want == [f"t{i}" for i in reversed(range(10))]


def test_budgets():
    from treeline.functions.budgets import Server

    hosted, own = Server.of("gpt"), Server.of("litellm/vllm/some")
    assert (hosted.group_tokens(), hosted.summary_tokens(), hosted.answer_tokens(10**6)) == (20000, None, None)
    assert own.group_tokens() == min(16384 - 2048 - 256 - 1600, 8192) and own.summary_tokens() == 16384 - 2048 - 256 - 256 - 80
    assert own.answer_tokens(1000) == 2048 and own.answer_tokens(16384 - 256 - 300) == 300
    with pytest.raises(ValueError):
        own.answer_tokens(16384 - 256 - 255)
    small = Server.of("hosted_vllm/x", {"context": 3000, "output": 0, "margin": 0})
    assert (small.group_tokens(), small.summary_tokens(), small.answer_tokens(10)) == (2000, 1024, None)
