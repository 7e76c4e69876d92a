import random
import zlib

import numpy as np
import pytest

from treeline.llm import calibration, decontaminate, licences, quality, topk_search, toxicity

DOCS = "doc_id long, text string, lang string, score string, label int"


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(ids[i] if ids else i, t, "en", "clash", 3) for i, t in enumerate(texts)], DOCS)


def test_pav_is_monotone_and_averages():
    x, y = calibration.pav(np.array([1, 2, 3, 4.0]), np.array([0, 1, 0, 1.0]), np.ones(4))
    assert list(y) == [0, 0.5, 1] and list(x) == [1, 2.5, 4]


def brute_segments(values):
    """All maximal-scoring segments by definition: best segment first, then left and right of it."""
    def rec(a, b):
        best = None
        for i in range(a, b):
            for j in range(i + 1, b + 1):
                s = sum(values[i:j])
                if s > 0 and (best is None or s > best[0] + 1e-12 or (abs(s - best[0]) <= 1e-12 and (j - i) < best[2] - best[1])):
                    best = (s, i, j)
        return [] if best is None else rec(a, best[1]) + [(best[1], best[2] - 1, round(best[0], 9))] + rec(best[2], b)

    return rec(0, len(values))


@pytest.mark.parametrize("seed", range(40))
def test_segments_equal_definition(seed):
    r = random.Random(seed)
    values = [r.choice([-0.37, -r.random(), r.random(), 1.0 + r.random()]) for _ in range(25)]
    got = toxicity.segments(np.array(values))
    assert [(a, b, round(s, 9)) for a, b, s in got] == brute_segments(values)


def test_toxic_rows_are_found_without_held_out_labels(spark):
    r = random.Random(2)
    plain = [f"word{i}" for i in range(60)]
    texts, toxic = [], []
    for i in range(400):
        w = [r.choice(plain) for _ in range(40)]
        toxic.append(int(i % 5 == 0))
        if toxic[-1]:
            for _ in range(5):
                w[r.randrange(40)] = r.choice(["vile", "scummy", "rotten"])
        texts.append(" ".join(w))
    extra = [None, "", "...", texts[0], "vile rotten " * 50_000]
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)] + [(0, 1, 1), (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in toxicity.scan(frame(spark, texts + extra), labels).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert np.mean([got[i].predicted == toxic[i] for i in range(400) if got[i].held_out]) > 0.95
    assert got[404].predicted == 1 and len(got[404].passages) == 1
    assert [got[400 + i].predicted for i in range(3)] == [0, 0, 0]
    none = toxicity.scan(frame(spark, ["a b", None]), labels.where("false")).collect()
    assert [x.score for x in none] == [0, 0]
    assert toxicity.scan(frame(spark, []), labels).count() == 0


def test_quality_on_held_out_rows(spark):
    r = random.Random(3)
    texts, good = [], []
    for i in range(400):
        w = "".join(r.choice("abcdefgh ") for _ in range(300))
        good.append(int(i % 4 != 0))
        texts.append(w if good[-1] else w.upper().replace(" ", "!! "))
    labels = spark.createDataFrame([(i, q, 0) for i, q in enumerate(good)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality.score(frame(spark, texts + [None, "", "\n", "x" * 200_000]), labels).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i in held) and sum(x.held_out for x in got.values()) >= len(held)
    assert np.mean([got[i].predicted == good[i] for i in held]) > 0.95
    assert all(0 <= x.score <= 1 for x in got.values()) and len(got) == 404
    assert [x.score for x in quality.score(frame(spark, ["a"]), labels.where("false")).collect()] == [0]
    assert quality.score(frame(spark, []), labels).count() == 0


def test_licences(spark):
    r = random.Random(4)
    plain = ["".join(r.choice("aeioulmnst") for _ in range(r.randint(2, 9))) for _ in range(300)]
    body = lambda: " ".join(r.choice(plain) for _ in range(30))
    texts = [body() + "\n" + body() for _ in range(60)]
    texts += [body() + "\nReleased under the MIT License.", "Licensed under CC BY-NC 4.0.\n" + body(), body() + "\nThis file is covered by the Acme proprietary licence agreement of the vendor, all rights reserved."]
    texts += [None, "", body() + " license " + body()]
    got = {x.doc_id: x for x in licences.scan(frame(spark, texts)).collect()}
    assert got[60].families == ["MIT"] and got[60].confirmed and got[60].matches[0].paragraph == 1
    assert got[61].families == ["CC-BY-NC"]
    assert got[62].families == ["unknown"] and not got[62].confirmed
    assert not any(got[i].n_licences for i in range(60)) and got[63].n_paragraphs == 0
    assert licences.scan(frame(spark, [])).count() == 0


def test_overlaps_tolerate_substitution(spark):
    r = random.Random(6)
    vocabulary = [f"w{i}" for i in range(500)]
    items = [[r.choice(vocabulary) for _ in range(20)] for _ in range(8)]
    bench = [(k, " ".join(w), "x") for k, w in enumerate(items)] + [(8, None, "x"), (9, "too short", "x"), (10, " ".join(items[0]), "x"), (None, "a b c d e f", "x")]
    benchmark = spark.createDataFrame(bench, "item_id long, text string, doc_id string")
    texts, want = [], set()
    for d in range(60):
        w = [r.choice(vocabulary) for _ in range(r.choice([30, 200]))]
        if d % 3 == 0:
            k, subs = r.randrange(8), r.choice([0, 2, 4, 5])
            copy = list(items[k])
            for p in r.sample(range(20), subs):
                copy[p] = "other"
            at = r.choice([0, 15, len(w)])
            w[at:at] = copy
            if subs <= 4:
                want |= {(d, k)} | ({(d, 10)} if k == 0 else set())
        texts.append(", ".join(w).upper() if d % 2 else "\n".join(w))
    texts += [None, "", "...", " ".join(items[1])]
    ids = [*range(63), 61]
    want.add((61, 1))
    docs = frame(spark, texts, ids)
    got = {(x.doc_id, x.item_id) for x in decontaminate.overlaps(docs, benchmark).collect()}
    assert got == want
    assert {(x.doc_id, x.item_id) for x in decontaminate.overlaps(docs, benchmark, broadcast_seeds=3).collect()} == want
    kept = decontaminate.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == set(ids) - {d for d, _ in want}
    assert decontaminate.overlaps(docs.where("false"), benchmark).count() == 0
    assert decontaminate.overlaps(docs, benchmark.where("false")).count() == 0


def top_k_by_hand(v, every=50, k=5):
    """v: id -> integers (Python's, padded)."""
    out = set()
    for q in (i for i in v if i % every == 0):
        score = {i: sum(a * b for a, b in zip(v[q], v[i])) for i in v if i != q}
        best = sorted(score, key=lambda i: (-score[i], i))[:k]
        out |= {(q, n + 1, i, score[i]) for n, i in enumerate(best)}
    return out


def test_top_k_equals_brute_force(spark):
    r = np.random.default_rng(1)
    x = np.vstack([r.normal(0, 1, (900, 8)), np.tile(r.normal(0, 1, 8), (300, 1)), np.zeros((20, 8))]).astype(np.float32)
    rows = [(i, [float(c) for c in v], 1, 2) for i, v in enumerate(x)]
    rows += [(5000, None, 1, 2), (5050, [1.0, None] + [0.0] * 6, 1, 2), (5100, [float("nan")] * 8, 1, 2), (5150, [1.0] * 3, 1, 2), (None, [1.0] * 8, 1, 2), (5151, [], 1, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, score int")
    v = {i: np.floor(256 * w.astype(np.float64)).astype(int).tolist() for i, w in enumerate(x)}
    v |= {5150: [256] * 3 + [0] * 5, 5151: [0] * 8}
    got = [tuple(x) for x in topk_search.top_k(df, page=128, block=7).collect()]
    assert set(got) == top_k_by_hand(v) and len(got) == len(set(got))
    assert topk_search.top_k(df.where("vec_id < 3")).count() == 2
    assert topk_search.top_k(df.where("false")).count() == 0


def test_top_k_of_clustered_and_of_huge_integers(spark):
    r = np.random.default_rng(5)
    centres = r.normal(0, 50, (12, 16))
    x = centres[r.integers(0, 12, 1500)] + r.normal(0, 0.5, (1500, 16))
    for scale, every in ((1.0, 50), (2.0**13, 500)):  # the second has products beyond 2^53
        rows = [(i, [float(c) for c in w * scale]) for i, w in enumerate(x)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        v = {i: [int(np.floor(256 * c)) for c in w] for i, w in rows}
        assert {tuple(t) for t in topk_search.top_k(df, every=every, page=200, block=16).collect()} == top_k_by_hand(v, every)


def test_products_are_exact_at_every_size():
    r = np.random.default_rng(6)
    for bits in (10, 24, 29, 40):
        a, b = r.integers(-(2**bits), 2**bits, (5, 16)), r.integers(-(2**bits), 2**bits, (7, 16))
        got = topk_search.products(a, b)
        for i in range(5):
            for j in range(7):
                want = sum(int(p) * int(q) for p, q in zip(a[i], b[j]))
                assert got[i, j] == max(-(2**63) + 1, min(2**63 - 1, want))


def test_a_page_rules_out_by_stored_distances():
    """In clustered data most leaves are never opened; radii cover and stored distances are right."""
    r = np.random.default_rng(7)
    centres = r.normal(0, 100, (20, 12))
    v = np.floor(centres[r.integers(0, 20, 4000)] + r.normal(0, 1, (4000, 12))).astype(np.int64)
    top = float((v.astype(float) ** 2).sum(1).max())
    pivot = topk_search._lift(v[:1], top)[0]
    page = topk_search.Page.unpack(topk_search.Page(np.arange(4000), v, top, pivot).pack())
    x = topk_search._lift(page.vectors, top)
    assert sorted(page.ids.tolist()) == list(range(4000)) and not page.leaf[0] and page.leaf.sum() > 20

    def below(node):
        if page.leaf[node]:
            return list(range(page.first[node], page.last[node]))
        return [e for c in range(page.first[node], page.last[node]) for e in below(c)]

    for node in range(len(page.leaf)):
        d = topk_search._distances(x[below(node)], page.centre[node][None])[:, 0]
        assert d.max() <= page.radius[node] + 1e-3
        if not page.leaf[node]:
            for c in range(page.first[node], page.last[node]):
                assert abs(topk_search._distances(page.centre[c : c + 1], page.centre[node][None])[0, 0] - page.to_parent[c]) < 1e-3
    q = v[:10]
    exact = np.sort(q @ v.T, 1)[:, -6:]
    bound = exact[:, 0]
    to_pivot = topk_search._distances(topk_search._asked(q), pivot[None])[:, 0]
    opened = page._leaves(topk_search._asked(q), topk_search.reach(q, top, bound), to_pivot)
    assert sum(len(o[2]) for o in opened) < 0.7 * 10 * page.leaf.sum()
    qid, score, _ = page.search(np.arange(10), q, top, 5, bound, to_pivot)
    want = [sorted((int(s) for j, s in enumerate(v @ q[i]) if j != i), reverse=True)[:5] for i in range(10)]
    assert [sorted(score[qid == i].tolist(), reverse=True) for i in range(10)] == want


def test_calibration_weights_stand_for_rows():
    """A thinned class with weights has the rates of the whole one."""
    r = np.random.default_rng(4)
    label = (r.random(6000) < 0.1).astype(float)
    scores = np.round(r.normal(label, 1.0), 1)
    keep = (label == 1) | (np.arange(6000) % 9 == 0)
    weights = np.where(label == 1, 1.0, (label == 0).sum() / (keep & (label == 0)).sum())[keep]
    at = np.linspace(-1, 2, 7)
    whole = calibration.apply(*calibration.isotonic(scores, label, 64), at)
    part = calibration.apply(*calibration.isotonic(scores[keep], label[keep], 64, weights=weights), at)
    assert np.abs(whole - part).max() < 0.1


def test_toxicity_keeps_the_base_rate_where_the_sample_is_capped(spark):
    r = random.Random(8)
    texts = [" ".join(f"w{r.randrange(50)}" for _ in range(20)) for _ in range(800)]
    labels = spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(800)], "doc_id long, quality int, toxic int")
    got = toxicity.scan(frame(spark, texts), labels, sample=30).collect()
    assert abs(np.mean([x.score for x in got]) - 0.1) < 0.05 and not any(x.predicted for x in got)


def test_quality_keeps_the_base_rate_where_the_sample_is_capped(spark):
    labels = spark.createDataFrame([(i, int(i % 10 != 0), 0) for i in range(600)], "doc_id long, quality int, toxic int")
    got = quality.score(frame(spark, ["the same text in every row"] * 600), labels, sample=20).collect()
    assert abs(np.mean([x.score for x in got]) - 0.9) < 0.1, sorted({x.score for x in got})
