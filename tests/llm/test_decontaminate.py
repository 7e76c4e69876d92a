import random

from treeline.llm import decontaminate

DOCS = "doc_id long, text string, item_id string, n_words int"
ITEMS = "item_id long, text string, doc_id long"


def by_hand(doc, item):
    """(agreeing words, passage) of the best line, or None, over all lines of an item."""
    best = None
    for line in range(-len(item) + 1, len(doc)):
        n = now = top = 0
        for t, w in enumerate(item):
            same = 0 <= line + t < len(doc) and doc[line + t] == w
            n += same
            now = max(0, now + (1 if same else -4))
            top = max(top, now)
        if n >= 0.8 * len(item) or top >= 13:
            best = (max(n, best[0]), max(top, best[1])) if best else (n, top)
    return best


def found(spark, docs, items):
    d = spark.createDataFrame([(i, " ".join(w), "clash", 1) for i, w in enumerate(docs)], DOCS)
    b = spark.createDataFrame([(i, " ".join(w), 5) for i, w in enumerate(items)], ITEMS)
    return {(r.doc_id, r.item_id): (r.n_matched, r.passage) for r in decontaminate.overlaps(d, b).collect()}


def test_recall_with_substituted_words_by_aligning_everything(spark):
    """Items of 5 words and more with a fifth of their words substituted anywhere: brute force finds all."""
    r = random.Random(3)
    items = [[f"i{k}w{j}" for j in range(n)] for k, n in enumerate([*range(5, 25), 30, 40, 60] * 4)]
    docs = []
    for item in items:
        w = list(item)
        for p in r.sample(range(len(w)), len(w) // 5):
            w[p] = "other"
        docs.append([f"a{r.randrange(99)}" for _ in range(r.randrange(12))] + w + [f"b{r.randrange(99)}" for _ in range(r.randrange(12))])
    got = found(spark, docs, items)
    want = {(i, i): by_hand(d, it) for i, (d, it) in enumerate(zip(docs, items))}
    assert all(want.values()) and set(got) <= set(want)
    assert all(got[k] == want[k] for k in got)
    assert len(got) >= 0.98 * len(want)
    short = [k for k in want if len(items[k[0]]) <= 9]
    assert all(k in got for k in short)


def test_every_single_substitution_in_short_items(spark):
    items, docs = [[f"w{j}" for j in range(n)] for n in (5, 6)], []
    for item in items:
        docs += [["x", *item[:p], "other", *item[p + 1 :], "y"] for p in range(len(item))]
    got = found(spark, docs, items)
    assert {d for d, _ in got} == set(range(len(docs)))


def test_parts_and_inserted_words(spark):
    item = [f"w{j}" for j in range(59)]
    forty = [f"v{j}" for j in range(40)]
    docs = [
        item[:44],  # three quarters, word for word
        forty[:20] + ["new"] + forty[20:],  # a word put in
        forty[:19] + forty[20:],  # a word left out
        item[:12],  # too little
        ["z"] * 30,
        [],
    ]
    got = found(spark, docs, [item, forty])
    assert got == {(0, 0): (44, 44), (1, 1): (20, 20), (2, 1): (20, 20)}


def test_null_empty_repeated_and_clashing(spark):
    w = "one two three four five six seven"
    rows = [(1, w, "c", 0), (1, w, "c", 0), (None, w, "c", 0), (2, None, None, None), (3, "", "c", 1), (4, w + " " + "pad " * 30_000, "c", 0)]
    items = [(7, w, 1), (7, w, 1), (8, w.upper(), 2), (None, w, 3), (9, None, 4), (10, "too short", 5)]
    d, b = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS)
    got = sorted((r.doc_id, r.item_id, r.n_matched) for r in decontaminate.overlaps(d, b).collect())
    assert got == [(1, 7, 7), (1, 8, 7), (4, 7, 7), (4, 8, 7)]
    assert decontaminate.overlaps(d.where("false"), b).count() == 0 == decontaminate.overlaps(d, b.where("false")).count()
