"""Each stage of the pipeline on its own input, against brute force."""

import random
import sys
from pathlib import Path

import pytest
sys.path.insert(0, str(Path(__file__).parent))
from test_suffix_dedup import brute as brute_suffix  # noqa: E402

import corpus_pipeline as P

DOCS = "doc_id long, text string, lang string, source string, n_chars long, __kept string"
BAD = ["vile", "rotten", "scummy"]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    r = random.Random(9)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(800)]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [" ".join(say(25)) for _ in range(5)]
    passage = " ".join(say(60))
    texts, kind = [], []
    for i in range(320):
        w = say(r.randint(30, 90))
        k = "toxic" if i % 8 == 0 else "leak" if i % 31 == 1 else "near" if i % 16 == 3 else "passage" if i % 20 == 5 else "plain"
        if k == "toxic":
            for _ in range(6):
                w[r.randrange(len(w))] = r.choice(BAD)
        if k == "leak":
            copy = r.choice(items).split()
            copy[3] = copy[15] = "changed"
            w[10:10] = copy
        if k == "passage":
            w[5:5] = passage.split()
        texts.append(" ".join(w))
        kind.append(k)
        if k == "near":
            w[len(w) // 2] = "edited"
            texts += [" ".join(w), texts[-1]]
            kind += ["copy", "copy"]
    rows = [(i, t, "en", "s", len(t), "clash") for i, t in enumerate(texts)] + [(9000, None, "en", "s", None, None), (9001, "", "en", "s", 0, None), (None, "no id here", "en", "s", 10, None)]
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = [(i, 1, int(k == "toxic")) for i, k in enumerate(kind)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), dict(enumerate(texts)), dict(enumerate(kind))


def read(spark, made):
    return spark.read.parquet(f"{made[0]}/documents.parquet")


def test_toxic_documents_go_and_clean_ones_stay(spark, made):
    out = P.drop_toxic(spark, read(spark, made), made[0])
    left = {r.doc_id for r in out.collect()}
    assert out.columns == read(spark, made).columns and {None, 9000, 9001} <= left
    gone = set(made[1]) - left
    assert gone == {i for i, k in made[2].items() if k == "toxic"}


def test_one_of_each_near_duplicate_group_stays(spark, made):
    docs = read(spark, made)
    left = sorted((r.doc_id for r in P.drop_near_duplicates(spark, docs, made[0]).collect()), key=str)
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in made[1].items())}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    assert left == sorted([i for i in ids if find(i) == i] + [9000, 9001, None], key=str)
    again = P.drop_near_duplicates(spark, docs.unionByName(docs), made[0])
    assert sorted((r.doc_id for r in again.where("doc_id is not null").collect()), key=str) == [i for i in left if i is not None]


def test_repeated_passages_go(spark, made):
    docs = read(spark, made)
    out = P.drop_repeated_passages(spark, docs, made[0])
    assert out.columns == docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    want = brute_suffix([*made[1].values(), "no id here"])
    for i, (n, gone, _, _) in zip(made[1], want):
        assert len(rows[i].text) == n - gone == rows[i].n_chars
    assert rows[9000].text is None and rows[None].text == "no id here"


def test_leaks_go(spark, made):
    docs = read(spark, made)
    left = {r.doc_id for r in P.drop_benchmark_leaks(spark, docs, made[0]).collect()}
    assert set(made[1]) - left == {i for i, k in made[2].items() if k == "leak"} and {None, 9000, 9001} <= left


def test_run_packs_what_is_left(spark, made):
    out = P.run(spark, made[0]).collect()
    ids = {r.doc_id for r in out}
    own = [i for i in ids if i in made[2]]
    assert not any(made[2][i] in ("toxic", "leak") for i in own) and len({made[1][i] for i in own}) == len(own)
    assert {i for i, k in made[2].items() if k in ("plain", "passage")} <= ids
    assert [n for n, _ in P.STAGES] == ["toxicity", "ngram_jaccard_join", "suffix_array_dedup", "benchmark_decontamination", "best_fit_packing"]
    assert P.ORACLE_SQL is None


def test_empty_tables(spark, made):
    docs = read(spark, made).where("false")
    for _, stage in P.STAGES:
        assert stage(spark, docs, made[0]).count() == 0
