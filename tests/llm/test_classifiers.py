"""The trained operators against plain formulas."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from treeline.llm import calibration, lang_id, quality, toxicity
from treeline.llm.common import Workspace

DOCS = "doc_id long, text string, lang string, score string, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "clash", 3) for i, t, lang in rows], DOCS)


def test_log_odds_by_the_formula():
    r = np.random.default_rng(0)
    tokens, texts = r.integers(0, 400, (50, 2)).astype(float), r.integers(0, 60, (50, 2)).astype(float)
    totals = tokens.sum(0) + 100
    got = toxicity.log_odds(tokens, texts, totals)
    for i in range(50):
        (b, a), (tb, ta) = tokens[i], texts[i]
        own, every = toxicity.PRIOR * (a + b), toxicity.PRIOR * totals.sum()
        odds = lambda x, n: math.log((x + own) / (n + every - x - own))
        delta = odds(a, totals[1]) - odds(b, totals[0])
        more = toxicity.PRIOR * (ta + tb)
        left = abs(delta) - toxicity.SHRINK * math.sqrt(1 / (ta + more) + 1 / (tb + more)) if ta + tb else -1
        assert got[i] == pytest.approx(math.copysign(left, delta) if left > 0 else 0)
    assert (got > 0).any() and (got < 0).any() and (got == 0).any()
    assert not toxicity.log_odds(tokens, texts, np.array([5.0, 0.0])).any()


def test_lambda_is_the_root_and_k_fits_random_text():
    r = np.random.default_rng(1)
    words = [f"w{i}" for i in range(2000)]
    p = np.full(2000, 0.0004)
    scores = np.where(r.random(2000) < 0.1, r.gamma(2, 0.5, 2000), -r.random(2000))  # many words, so few ties
    m = toxicity.Model(words, scores, p, drift=1.0)  # little drift, so best segments have several tokens
    s = np.array([m.weights.get(w, 0.0) - m.penalty for w in words])
    assert (p * np.exp(m.lam * s)).sum() + 0.2 * math.exp(-m.lam * m.penalty) == pytest.approx(1, abs=1e-6)
    best = []
    for _ in range(400):
        text = r.choice(words + ["other"], size=500, p=np.r_[p, 0.2]).tolist()
        best.append(m.lam * max(x[2] for x in m.found(text)))
    k = toxicity.fit_k(np.full(400, 500.0), np.array(best), np.ones(400))
    for x in np.quantile(best, [0.55, 0.7, 0.8, 0.9, 0.97]):  # the law holds for the scan's better scores
        assert abs(math.exp(-k * 500 * math.exp(-x)) - np.mean(np.array(best) < x)) < 0.08


def test_sum_evidence():
    assert toxicity.sum_evidence([-3.0, -5.0]) == -3.0
    assert toxicity.sum_evidence([7.0]) == 7.0
    two = 13.0 - math.log(13.0) + math.log(2) - math.log(2)
    assert toxicity.sum_evidence([6.0, 7.0]) == pytest.approx(two)
    assert toxicity.sum_evidence([9.0, 0.01]) == 9.0


def test_copies_count_once_and_token_counts_are_whole(spark):
    """Copied texts of a label weigh as one in the counts; all their rows stay in the calibration's sample."""
    texts = [(i, "vile stuff here now " + f"tail{i} " * 3, "en") for i in range(9)]
    texts += [(100 + i, "a copied text with a rare word", "en") for i in range(30)]
    labels = [(i, 1, 1) for i in range(9)] + [(100 + i, 1, 0) for i in range(30)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    m = toxicity.train(frame(spark, texts), labels)
    assert len(m.knots[0]) >= 1 and not any(math.isnan(v) for v in m.knots[1])
    got = toxicity.scan(frame(spark, texts + [(7, "vile stuff here now", "en"), (None, None, None)]), labels).collect()
    assert len(got) == len(texts) + 2
    same = {x.score for x in got if x.doc_id is not None and x.doc_id >= 100}
    assert len(same) == 1  # ties


def test_calibration_is_flat_in_blocks():
    r = np.random.default_rng(2)
    scores = r.normal(0, 1, 5000)
    labels = (scores > 1).astype(float)
    x, y = calibration.isotonic(scores, labels, bins=64)
    assert (np.diff(y) >= 0).all() and calibration.apply(x, y, np.array([0.5]))[0] < 0.01
    assert calibration.apply(x, y, np.array([1.2]))[0] > 0.9


def test_features_approximate_the_kernel_and_the_solve_is_ridge(spark):
    k = len(quality.STATS)
    r = np.random.default_rng(3)
    model = quality.Model(np.zeros(k), np.ones(k), np.zeros(1), (np.array([0.0]), np.array([0.0])), features=20_000)
    x = r.normal(0, 1, (12, k))
    z = model.features(x)[:, :20_000]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * quality.WIDTH**2))
    assert np.abs(z @ z.T - exact).max() < 0.05
    rows = [(i, r.normal(0, 1, k).tolist()) for i in range(300)]
    label = [int(v[0] + v[1] > 0) for _, v in rows]
    stats = spark.createDataFrame(rows, "doc_id long, stats array<double>").repartition(3)
    chosen = spark.createDataFrame([(i, y, 1.0 + i % 2) for i, y in enumerate(label)], "doc_id long, label int, weight double")
    got = quality.train(stats, chosen, Workspace(spark, "test"))
    w = np.array([1.0 + i % 2 for i in range(300)])
    s = np.array([v for _, v in rows])
    mean = (w @ s) / w.sum()
    assert np.allclose(got.mean, mean) and np.allclose(got.scale, np.sqrt((w @ (s * s)) / w.sum() - mean**2) + 1e-6)
    z = got.features(s)
    want = np.linalg.solve((z.T * w) @ z / w.sum() + quality.RIDGE / 100 * np.eye(z.shape[1]), (z.T * w) @ np.array(label) / w.sum())
    assert np.allclose(got.weights, want, atol=1e-6)


def grams(text):
    c = Counter()
    word = ""
    for ch in text.lower() + " ":
        if ch.isalpha():
            word += ch
        elif word:
            padded = f" {word} "
            for n in (1, 2, 3):
                c.update(g for g in (padded[i : i + n] for i in range(len(padded) - n + 1)) if g != " ")
            word = ""
    return c


def code(g):
    out = 0
    for ch in g:
        out = (out << 21) | ord(ch)
    return out


def ranked(c):
    return [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], code(x[0])))[: lang_id.PROFILE]]


def test_languages_by_out_of_place_distance(spark):
    r = random.Random(4)
    alphabets = {"aa": "abcdefgé", "bb": "efghijkl", "cc": "klmnoabc"}
    rows = []
    for i in range(150):
        lang = r.choice(sorted(alphabets))
        words = ["".join(r.choice(alphabets[lang] + "xyz") for _ in range(r.randint(1, 9))) for _ in range(r.choice([1, 3, 40]))]
        rows.append((i, " ".join(words), lang))
    rows += [rows[0], (200, None, "aa"), (201, "", None), (202, "12 !", "bb"), (None, rows[3][1], "cc"), (203, "b e " * 30_000, None)]
    sums = {}
    for i, t, lang in rows:
        if i is not None and lang and t and zlib.crc32(str(i).encode()) % 3 != 1:
            sums.setdefault(lang, Counter()).update(grams(t))
    profiles = {k: {g: n for n, g in enumerate(ranked(c))} for k, c in sums.items()}
    got = sorted(((x.doc_id, x.lang_pred, round(x.score, 9)) for x in lang_id.identify(frame(spark, rows)).collect()), key=repr)
    want = []
    for i, t, _ in rows:
        own = ranked(grams(t or ""))
        if not own:
            want.append((i, "und", 0.0))
            continue
        far = {k: sum(abs(p[g] - n) if g in p else lang_id.PROFILE for n, g in enumerate(own)) for k, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        other = sum(v for k, v in far.items() if k != best) / (len(far) - 1)
        want.append((i, best, round(min(1.0, max(0.0, 1 - far[best] / other)), 9)))
    assert got == sorted(want, key=repr)


@pytest.fixture(scope="module")
def licence_model():
    from treeline.llm import licences

    r = random.Random(5)
    plain = ["".join(r.choice("aeioulmnst") for _ in range(r.randint(2, 9))) for _ in range(300)] + "the of is to and by mit".split()
    return licences.Model([" ".join(r.choice(plain) for _ in range(r.randint(1, 40))) for _ in range(800)])


def test_licence_probabilities_by_the_formula(licence_model):
    from treeline.llm import licences

    texts = ["Released under the MIT License.\nmit und\n\nLicensed under  CC BY 4.0. the the", "", "no word known here xyz", "all Rights\treserved"]
    got, lines = licence_model.probabilities(texts)
    assert lines.tolist() == [4, 1, 1, 1]
    names = licence_model.index
    for p, line in zip(got, [x for t in texts for x in t.split("\n")]):
        w = licences.words(line)
        ids = {names[x] for x in w if x in names}
        pairs = {names[a] * len(names) + names[b] for a, b in zip(w, w[1:]) if a in names and b in names} & set(licence_model.pairs.tolist())
        ids |= {len(names) + int(np.searchsorted(licence_model.pairs, x)) for x in pairs}
        z = licence_model.weights[-1] + sum((licence_model.weights[i] / math.sqrt(len(w)) for i in ids), np.zeros(len(p)))
        e = np.exp((z - z.max()) / licence_model.temperature)
        assert np.allclose(p, e / e.sum(), atol=1e-4)


def test_wrapped_notices_and_ordinary_words(licence_model):
    grant = (
        "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation "
        'files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights'
    )
    header = (
        "    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as "
        "published by\n    the Free Software Foundation, either version 3 of the License, or\n    (at your option) any later version."
    )
    (n, hits), (_, ordinary), (empty, none) = licence_model.scan([f"aeio stnm\n{grant}\nlmno aei\n{header}\nend", "mit.\naeio is the of stn ulm aei", ""])
    assert [(h["paragraph"], h["family"]) for h in hits] == [(1, "MIT"), (5, "GPL-3.0")] and n < 10
    assert ordinary == [] and (empty, none) == (0, [])
    assert all(licence_model.judge(t)[0] == f for f, ts in __import__("treeline.llm.licences", fromlist=["x"]).TEMPLATES.items() for t in ts[:1])


def test_licence_ties_repeats_and_long_texts(spark):
    from treeline.llm import licences

    rows = [(1, "Released under the MIT License.", "en"), (1, "Released under the MIT License.", "en"), (None, "aeio " * 40_000 + "\nSPDX-License-Identifier: MIT", "en"), (2, None, None), (3, "aeio stn", "en")]
    got = sorted(((x.doc_id, tuple(x.families), x.n_paragraphs) for x in licences.scan(frame(spark, rows)).collect()), key=repr)
    assert got == sorted([(1, ("MIT",), 1), (1, ("MIT",), 1), (None, ("MIT",), 2), (2, (), 0), (3, (), 1)], key=repr)
