import random

import pytest
from pyspark.sql import functions as F

from treeline.operators import search


@pytest.mark.parametrize("seed", range(2))
def test_search_is_the_head_of_all_scores(spark, monkeypatch, seed):
    """As the first k of every score: copies, keys on several rows, null keys and texts, blocks and batches of a few rows."""
    r = random.Random(seed)
    text = lambda: r.choice([None, "", "... !", *[" ".join(r.choice(["ab", "bc", "cd", "DE", "ef", "fg", "gh", "words"]) for _ in range(r.randint(1, 12))) for _ in range(9)]])
    copies = [(text(), text()) for _ in range(40)]
    rows = {(r.choice([None, "a", "b", "ä"]), r.randint(0, 99)): r.choice(copies) for _ in range(300)}
    rows = [(*key, *texts) for key, texts in rows.items() for _ in range(r.choice([1, 1, 3]))]
    r.shuffle(rows)
    nodes = spark.createDataFrame(rows, "doc string, nr int, head string, body string").repartition(3).cache()
    asked = [(f"q{i}", q) for i, q in enumerate(["ab bc cd", "de", "none of these", "", None, "gh fg words words", "ab"])]
    asked = spark.createDataFrame(asked, "q string, question string").cache()
    every = search.bm25(nodes, ["doc", "nr"], ["head", "body"], asked, "q", "question").withColumn("score", F.round("score", 9))
    want = search.top(every, [F.col("score"), F.col("doc"), F.col("nr")], 7, ["q"]).select("q", "doc", "nr", "score", "rank").collect()
    assert len(want) == 28 > len({(x.q, x.score) for x in want})
    monkeypatch.setattr(search, "bm25", None)  # all scores of all nodes are never listed
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for block, batch in ((250_000, 10_000), (30, 11)):
            monkeypatch.setattr(search, "BLOCK_SCORES", block)
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            got = search.search(nodes, ["doc", "nr"], ["head", "body"], asked, "q", "question", 7)
            assert dict(got.dtypes) == {"q": "string", "doc": "string", "nr": "int", "score": "double", "rank": "int"}
            assert sorted(map(tuple, got.select("q", "doc", "nr", "score", "rank").collect()), key=repr) == sorted(map(tuple, want), key=repr)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_one_key_on_rows_of_many_batches(spark):
    """Rows of one key are one node: its counts add up, and it counts once for a term."""
    nodes = spark.createDataFrame([(1, "ab " * (i + 1)) for i in range(5)] + [(2, "cd ef"), (3, "cd ef"), (4, None)], "k int, text string")
    asked = spark.createDataFrame([(1, "ab cd"), (1, "ab cd"), (2, "")], "q int, question string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        got = [(x.q, x.k, x["rank"], x.score) for x in search.search(nodes, ["k"], ["text"], asked, "q", "question", 2).orderBy("rank").collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    import math

    part = lambda df, tf, size: math.log((8 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / (19 / 8)))
    assert got == [(1, 1, 1, round(-part(1, 15, 1), 9)), (1, 2, 2, round(-part(2, 1, 2), 9))]


def test_search_without_questions_or_nodes(spark):
    nodes = spark.createDataFrame([(1, "ab")], "k int, text string")
    asked = spark.createDataFrame([(1, "ab")], "q int, question string")
    assert search.search(nodes, ["k"], ["text"], asked.where("q > 1"), "q", "question").count() == 0
    assert search.search(nodes.where("k > 1"), ["k"], ["text"], asked, "q", "question").count() == 0
