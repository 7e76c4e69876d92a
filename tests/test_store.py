"""The index store, sources and sinks, streams, and text search against SQLite."""

import json
import random
import sqlite3
import time

import pytest
from pyspark.sql import functions as F

from treeline.functions import answers
from treeline.functions import text as T
from treeline.operators import index, search, tree
from treeline.plans import build, seam
from treeline.sources import readers, sinks
from treeline.streaming import refresh

LEAF = {"title": "Leaf", "node_id": "0001", "start_index": 1, "end_index": 2, "summary": "about whales"}
DOC = {"doc_name": "One", "doc_description": "first", "structure": [{"title": "Root", "node_id": "0000", "start_index": 1, "end_index": 3, "nodes": [LEAF]}]}


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "trees"
    d.mkdir()
    (d / "one.json").write_text(json.dumps(DOC))
    (d / "two.json").write_text(json.dumps([{"title": "Lines", "line_num": 7, "text": "ships sail"}]))
    (d / "bad.json").write_text("{not json")
    (d / "empty.json").write_text('{"structure": []}')
    (d / "_meta.json").write_text("[]")
    (d / "x.partial.json").write_text(json.dumps(DOC))
    return d


def test_store_refreshes(spark, folder, tmp_path):
    store = index.IndexStore(spark, str(tmp_path / "store"))
    first = store.build(str(folder))
    assert (first["added"], first["removed"], first["nodes_indexed"]) == (2, 0, 3)
    docs = {r.doc_id: r for r in store.table("documents").collect()}
    assert (docs["one"].doc_type, docs["one"].size, docs["one"].doc_name) == ("pdf", 3, "One")
    assert (docs["two"].doc_type, docs["two"].size, docs["two"].doc_name) == ("md", 7, "two")
    assert store.build(str(folder))["skipped"] >= 2
    assert store.build_embeddings(index.hashing_embedder(16)) == 3 and store.build_embeddings(index.hashing_embedder(16)) == 0
    with pytest.raises(ValueError):
        (folder / "three.json").write_text(json.dumps(DOC))
        store.build(str(folder))
        store.build_embeddings(index.hashing_embedder(8))
    time.sleep(0.01)
    (folder / "two.json").write_text("broken now")
    (folder / "one.json").unlink()
    third = store.build(str(folder))
    assert third["removed"] == 1
    assert {r.doc_id for r in store.table("documents").collect()} == {"two", "three"}, "an unreadable file keeps its last good version"
    asked = spark.createDataFrame([("q", "whales")], "id string, question string")
    assert [r.doc_id for r in store.search(asked).collect()] == ["three"]
    assert store.meta()["embed_dim"] == 16 and store.stats().first().documents == 2


def test_fixtures_and_configuration(spark, tmp_path):
    p = tmp_path / "q.jsonl"
    p.write_text('{"question": "a?", "relevant": [{"doc_id": "d"}]}\n\nbroken\n{"id": "x", "question": "b?", "relevant": [{"doc_id": "d", "node_id": "1"}], "tags": ["t"]}\n{"question": "no gold", "relevant": []}\n')
    got = readers.fixtures(spark, str(p)).collect()
    assert [(r.id, r.tags) for r in got] == [("q001", []), ("x", ["t"])]
    assert readers.configuration({"model": "m", "toc_check_page_num": None})["toc_check_page_num"] == 20
    with pytest.raises(ValueError):
        readers.configuration({"nope": 1})
    assert readers.setting("TREELINE_NO_SUCH", 5) == 5 and readers.setting("x", False, "yes") is True


def test_trees_round_trip(spark, folder, tmp_path):
    good, rejected = readers.readable(readers.tree_files(spark, str(folder)))
    assert {r.reason for r in rejected.collect()} == {"not JSON", "no structure"}
    nodes = tree.flatten(good)
    sinks.write_trees(nodes, readers.load_documents(good), str(tmp_path / "out"))
    back = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    one = next(b for b in back if b["doc_name"] == "One")
    assert one["structure"][0]["nodes"][0]["title"] == "Leaf" and one["doc_description"] == "first"


def test_bm25_equals_sqlite(spark):
    r = random.Random(3)
    vocabulary = ["whale", "foobar", "ship", "sea", "the", "of", "naïve", "x", "ray", "x-ray"]
    rows = [(i, " ".join(r.choices(vocabulary, k=r.randint(0, 12))), " ".join(r.choices(vocabulary[:6], k=r.randint(0, 4)))) for i in range(60)]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(id UNINDEXED, a, b)")
    db.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)
    nodes = spark.createDataFrame(rows, "id int, a string, b string").withColumn("a", F.translate("a", T.FOLD_FROM, T.FOLD_TO))
    for question in ("whale ship", "the foobar", "naive ray"):
        match = " OR ".join(f'"{w}"' for w in question.split())
        want = {i: round(s, 9) for i, s in db.execute("SELECT id, bm25(t) FROM t WHERE t MATCH ?", (match,))}
        asked = spark.createDataFrame([(0, question)], "q int, text string")
        got = {x.id: round(x.score, 9) for x in search.bm25(nodes, ["id"], ["a", "b"], asked, "q", "text").collect()}
        assert got == pytest.approx(want, abs=1e-9)


def test_answers():
    assert answers.first_json('<think>{"a": 2}</think>text {"a": 1} more') == {"a": 1}
    assert answers.first_json("```json\n[1, 2,]\n``` x") == [1, 2]
    assert answers.first_json("none here") == {} and answers.first_json(None) == {}
    assert answers.first_json('[{"a": 1} {"b": None}]') == [{"a": 1}, {"b": None}]
    assert answers.complete_objects('[{"a": 1}, {"b": {"c": 2}}, {"d": ') == [{"a": 1}, {"b": {"c": 2}}]
    assert answers.complete_objects('{"table_of_contents": [{"a": 1}, 5]}') == [{"a": 1}]


def test_seam_and_fallbacks(spark):
    def model(kind, prompts):
        if "fail" in prompts[0]:
            raise RuntimeError
        return [f"{kind}:{p}" for p in prompts]

    ask = lambda t: spark.createDataFrame([(t,)], "t string").select(seam.complete(model, "k", retries=2, wait=0)(F.col("t"))).first()[0]
    assert ask("hello") == "k:hello" and ask("fail") == ""
    lexical = spark.createDataFrame([(1, 1, -2.0), (2, 2, -1.0)], "id int, rank int, score double")
    rows, used = search.hybrid(lexical, lexical.where("false"), ["id"], "vector")
    assert used == "bm25" and rows.count() == 2
    fused, used = search.hybrid(lexical, lexical.where("id = 2"), ["id"])
    assert used == "hybrid" and fused.where("id = 2").first().match_sources == [0, 1]


def test_pages_with_contents_become_trees(spark):
    front = "Contents\n" + "\n".join(f"{c} {t} ..... {p}" for c, t, p in [("1", "Alpha", 1), ("1.1", "Beta", 2), ("1.2", "Gamma", 3), ("2", "Delta", 4), ("2.1", "Epsilon", 5), ("2.2", "Zeta", 6), ("3", "Eta", 7), ("3.1", "Theta", 8)])
    body = ["Alpha\nx", "Beta\nx", "Gamma\nx", "Delta\nx", "Epsilon\nx", "Zeta\nx", "Eta\nx", "Theta\nx", "tail"]
    pages_ = spark.createDataFrame([("d", 1, "Title page"), ("d", 2, front)] + [("d", i + 3, t) for i, t in enumerate(body)], "doc_id string, page_no int, page_text string")
    got = {r.title: (r.start_index, r.end_index, r.depth) for r in build.page_trees(pages_).collect()}
    assert got["Alpha"] == (3, 3, 0) and got["Gamma"] == (5, 5, 1) and got["Theta"] == (10, 11, 1) and "Preface" in got


def test_streams(spark, folder, tmp_path):
    for _ in range(2):
        refresh.ingest(spark, str(folder), str(tmp_path / "s"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "s")).count() >= 3
    events = spark.readStream.schema("event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").parquet("/root/testdata/sf0.001/events.parquet".rsplit("/", 1)[0] + "/events*")
    q = refresh.event_counts(events).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from counted").first()[0] == 1000
