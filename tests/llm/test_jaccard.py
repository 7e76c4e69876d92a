import random

import numpy as np
import pytest

from treeline.llm import jaccard
from treeline.llm.components import components
from treeline.llm.common import Workspace

DOCS = "doc_id long, text string, fp long, label string"


def brute(rows, words, num, den):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    return sorted((d, len(sets[i]), min(rows[j][0] for j in range(len(rows)) if find(j) == find(i))) for i, (d, _) in enumerate(rows))


def corpus(seed, n=160):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    bases = [[r.choice(vocabulary) for _ in range(r.choice([3, 5, 8, 12, 20, 40, 80, 150, 400]))] for _ in range(25)]
    passage = [r.choice(vocabulary) for _ in range(30)]
    rows = []
    for i in range(n):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        if r.random() < 0.3:
            w += passage
        rows.append((i * 3 + 7, r.choice([" ", "\n", "\t "]).join(x.upper() if r.random() < 0.1 else x for x in w)))
    return rows + [(1, None), (2, ""), (4, " \n"), (5, "one"), (6, "ONE"), (9000, rows[0][1]), (9001, "é É"), (9002, "é É")]


@pytest.mark.parametrize("seed,words,num", [(0, 4, 85), (1, 5, 80), (2, 2, 60)])
def test_components_equal_brute_force(spark, seed, words, num):
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, 1, "clash") for d, t in rows], DOCS).repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(docs, words, num, 100).collect())
    assert got == brute(rows, words, num, 100)


@pytest.mark.parametrize("sample,least", [(2000, 1), (7, 3), (0, 1)])
def test_hot_signatures_have_the_same_centres(spark, monkeypatch, sample, least):
    r = random.Random(sample)
    rows = [(r.randrange(1000), [r.randrange(40) for _ in range(r.randrange(6))]) for _ in range(300)] + [(5, None)]
    rows += [(i, [99]) for i in range(200)]
    monkeypatch.setattr(jaccard, "HOT_SAMPLE", sample)
    monkeypatch.setattr(jaccard, "HOT_NODES", least)
    got = {(x.fp, x.centre): x.votes for x in jaccard._shared(spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "doc_id long, fp long, sigs array<long>").repartition(3)).collect()}
    met = [(fp, s) for fp, sigs in rows for s in sigs or []]
    centre = {s: min(fp for fp, o in met if o == s) for _, s in met}
    want = {}
    for fp, s in met:
        if fp != centre[s]:
            want[fp, centre[s]] = want.get((fp, centre[s]), 0) + 1
    assert got == want


def test_hot_group_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP", 10)
    r = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randrange(7)):
            w[r.randrange(120)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows] + [(None, rows[0][1], 1, "x")], DOCS)
    got = jaccard.join(docs).collect()
    assert [(r.n_shingles > 0, r.component_id) for r in got if r.doc_id is None] == [(True, None)]
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == brute(rows, 4, 85, 100)
    assert jaccard.join(docs.where("false")).count() == 0


@pytest.mark.parametrize("n", [1, 4, 6, 9, 13, 20, 33, 60, 200])
def test_similar_sets_share_a_signature(n):
    r = np.random.default_rng(n)
    for _ in range(60):
        a = r.integers(0, 2**63, n, dtype=np.uint64)
        drop = r.integers(0, n + 1)
        b = np.r_[a[drop:], r.integers(0, 2**63, r.integers(0, n + 1), dtype=np.uint64)]
        both = n - drop
        if not len(b) or 100 * both < 85 * (n + len(b) - both):
            continue
        doc = np.r_[np.zeros(n, int), np.ones(len(b), int)]
        h = np.r_[np.sort(a), np.sort(b)]
        d, s = jaccard.signatures(doc, h, np.array([n, len(b)]), 85, 100)
        assert set(s[d == 0]) & set(s[d == 1]) or set(a) == set(b)


def test_sketch_distance_is_a_lower_bound():
    r = np.random.default_rng(0)
    a, b = r.integers(0, 2**63, 900, dtype=np.uint64), r.integers(0, 2**63, 30, dtype=np.uint64)
    cells, at = jaccard.sketches(np.r_[np.zeros(900, int), np.ones(880, int)], np.r_[a, a[50:], b], np.array([900, 880]))
    s = jaccard.folded(cells, at, np.arange(2), 64).astype(int)
    assert abs(s[0] - s[1]).sum() <= 80


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (200, 200)]
    got = components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "test"), "x").collect()
    labels = {r.node: r.label for r in got}
    assert len({labels[i] for i in range(41)}) == 1 and labels[100] == labels[102] != labels[0] and len(labels) == 44


@pytest.mark.parametrize("words", [4, 5])
@pytest.mark.parametrize("n", [1, 2, 3])
def test_a_slice_of_one_short_text(words, n):
    """Fewer words in all than a shingle has: the text is one element, as beside other texts."""
    text = " ".join("abc"[:n])
    doc, h = jaccard.shingle_sets([text], words)
    at, beside = jaccard.shingle_sets([text, "one two three four five six"], words)
    assert doc.tolist() == [0] and h.tolist() == beside[at == 0].tolist()


def test_triples_whose_ends_meet_only_in_the_middle(spark):
    """A base, the base without its first 6-13 % of words, and the base with as many new words appended: a bucket's
    centre that nobody voted for must still meet the other components."""
    r = random.Random(11)
    rows = []
    for g in range(600):
        n = r.randrange(60, 420)
        base = [f"g{g}w{r.randrange(5000)}" for _ in range(n)]
        cut = int(n * r.uniform(0.06, 0.13))
        for w in (base, base[cut:], base + [f"n{g}x{i}" for i in range(cut)]):
            rows.append((len(rows), " ".join(w)))
    order = list(range(len(rows)))
    r.shuffle(order)
    docs = spark.createDataFrame([(d, rows[d][1], 1, "") for d in order], DOCS).repartition(4)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.join(docs, 4, 85, 100).collect()}
    for g in range(0, len(rows), 3):
        want = brute(rows[g : g + 3], 4, 85, 100)  # words of different groups differ
        assert [(d, *got[d]) for d in range(g, g + 3)] == want


def test_chain_over_bands_and_large_group_of_unlinked_copies(spark):
    """A chain that grows by a tenth at each step runs over many size bands; copies with a fifth of their words
    changed each share buckets without being linked."""
    r = random.Random(12)
    chain, rows = [f"c{i}" for i in range(40)], []
    while len(chain) < 700:
        rows.append((len(rows), " ".join(chain)))
        chain = chain + [f"c{len(chain) + i}" for i in range(max(1, len(chain) // 10))]
    base = [f"b{i}" for i in range(150)]
    for _ in range(250):
        w = list(base)
        for i in r.sample(range(150), r.choice([3, 6, 9, 12])):
            w[i] = f"x{r.randrange(10**9)}"
        rows.append((len(rows), " ".join(w)))
    docs = spark.createDataFrame([(d, t, 1, "") for d, t in rows], DOCS).repartition(3)
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in jaccard.join(docs, 4, 85, 100).collect())
    assert got == brute(rows, 4, 85, 100)


def test_allowed_pairs_hold_every_link_and_few_others():
    import pyarrow as pa

    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 600).astype(np.uint64)
    sets = [np.unique(np.r_[base[r.random(600) > s], r.integers(0, 2**63, int(600 * s)).astype(np.uint64)]) for s in r.uniform(0, 0.3, 80)]
    doc, h = np.repeat(np.arange(80), [len(x) for x in sets]), np.concatenate(sets)
    size = np.array([len(x) for x in sets])
    cells, at = jaccard.sketches(doc, h, size)
    sketch = pa.array([cells[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())
    t = pa.table({"side": np.zeros(80, np.int64), "same": [True] * 80, "label": np.arange(80), "n": size, "sketch": sketch})
    left, right, _ = jaccard.allowed(t, np.array([0]), 1 << 30, 85, 100)
    got = set(zip(left.tolist(), right.tolist()))
    true = {(i, j) for i in range(80) for j in range(i + 1, 80) if jaccard._linked(sets[i].tobytes(), sets[j].tobytes(), 85, 100)}
    assert true <= got and true and len(got) < 2 * len(true) + 100
    few = jaccard.allowed(t, np.array([0]), 1, 85, 100)
    assert set(zip(few[0].tolist(), few[1].tolist())) <= got and set(few[0]) | set(few[1]) == {x for p in got for x in p}


def test_null_id_does_not_speak_for_its_copies(spark):
    rows = [(None, "a b c d e f g h i j k l m n o p q r s t u v w x y z", 1, ""), (3, "a b c d e f g h i j k l m n o p q r s t u v w x y z", 1, ""), (4, "a b c d e f g h i j k l m n o p q r s t u v w x y z0", 1, "")]
    docs = spark.createDataFrame(rows, DOCS).coalesce(1)
    assert {(x.doc_id, x.component_id) for x in jaccard.join(docs, 4, 85, 100).collect()} == {(None, None), (3, 3), (4, 3)}
