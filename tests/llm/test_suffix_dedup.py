import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from treeline.llm import suffix_dedup

DOCS = "doc_id long, text string, key string, spans long"


def brute(texts, window=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + window] for d in data for i in range(len(d) - window + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, np.int8)
        for i in range(len(d) - window + 1):
            if seen[d[i : i + window]] > 1:
                gone[i : i + window] = 1
        gone = gone[: len(d)]
        kept = bytes(b for b, g in zip(d, gone) if not g)
        starts = int((np.diff(np.r_[0, gone]) == 1).sum())
        out.append((len(d), int(gone.sum()), starts, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé日") for _ in range(r.randint(1, 9))) for _ in range(400)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passages = [say(n) for n in (15, 36, 40, 60, 200, 500)]
    texts = []
    for _ in range(70):
        t = say(r.randint(1, 150))
        for _ in range(r.choice([0, 1, 1, 2])):
            p = r.choice(passages)
            cut = r.randint(0, len(p) // 3)
            t += r.choice([" ", "\n", ""]) + p[cut : len(p) - r.randint(0, len(p) // 4)] + say(r.randint(0, 30))
        texts.append(t)
    line = "this line of about a hundred and twenty bytes is in every one of these documents and is never long enough alone..."
    texts += [say(20) + line + say(25) for _ in range(60)]
    texts += [None, "", "x", texts[3], texts[3], "ab" * 700, "z" * 450, "q" * 199, "q" * 200, texts[5] + "!", say(300) * 2]
    return texts


@pytest.mark.parametrize("seed,limit,hot", [(0, 512, 0.02), (1, 8, 9.0), (2, 512, 0.001), (3, 1, 9.0), (4, 30, 0.001), (5, 10**6, 9.0)])
def test_digest_equals_brute_force(spark, monkeypatch, seed, limit, hot):
    monkeypatch.setattr(suffix_dedup, "LIMIT", limit)
    monkeypatch.setattr(suffix_dedup, "HOT_SHARE", hot)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 20_000)
    monkeypatch.setattr(suffix_dedup.repeated, "__defaults__", (200, 64, limit))
    texts = corpus(seed)
    rows = [(i if i != 9 else None, t, "clash", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digest(docs).collect())
    want = sorted((i if i != 9 else -1, *x) for i, x in enumerate(brute(texts)))
    assert got == want
    assert suffix_dedup.digest(docs.where("false")).count() == 0


def test_remove_keeps_columns_and_valid_text(spark):
    texts = corpus(3)
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], DOCS)
    out = suffix_dedup.remove(docs)
    assert out.columns == docs.columns
    want = brute(texts)
    for r in out.collect():
        n, gone, *_ = want[r.doc_id]
        assert (r.text is None) == (texts[r.doc_id] is None)
        assert n - gone - 12 <= len((r.text or "").encode()) <= n - gone


@pytest.mark.parametrize("seed", range(6))
def test_block_sort_finds_repeated_windows(seed):
    r = random.Random(seed)
    base = bytes(r.choice(b"ab") for _ in range(900))
    contents = [base[r.randint(0, 300) :][: r.randint(100, 500)] for _ in range(12)] + [bytes(300), b"ab" * 120, b"ab" * 120]
    groups = [r.randint(0, 1) for _ in contents]
    sizes = [len(c) - 100 + 1 for c in contents]
    got = suffix_dedup.repeated_suffixes(contents, sizes, groups, 100)
    seen = Counter((g, c[i : i + 100]) for g, c, s in zip(groups, contents, sizes) for i in range(s))
    for g, c, s, hit in zip(groups, contents, sizes, got):
        assert hit.tolist() == [seen[g, c[i : i + 100]] > 1 for i in range(s)]


def test_difference_cover_and_sliding_minimum():
    cover, shift = suffix_dedup.difference_cover(57)
    assert len(cover) <= 12 and all((a + shift[a, b]) % 57 in cover and (b + shift[a, b]) % 57 in cover for a in range(57) for b in range(57))
    x = np.random.default_rng(0).integers(0, 99, 500).astype(np.uint64)
    assert suffix_dedup._sliding_min(x, 37).tolist() == [x[i : i + 37].min() for i in range(464)]


def test_contents_of_unlike_runs_differ_where_a_polynomial_would_not():
    """Thue-Morse strings, equal under any polynomial hash modulo 2^64, are unlike contents."""
    a = [0]
    while len(a) < 1024:
        a += [1 - x for x in a]
    head, tail = b"h" * 64 + bytes(range(60)) * 2, b"t" * 300
    pieces = [(i, 0, head + bytes(97 + (x ^ i) for x in a) + tail) for i in (0, 1)]
    doc, position, size, bucket, contents, _ = suffix_dedup.find_runs(pieces, 1400, 64)
    seen = {}
    for d, p, n, b, c in zip(doc.tolist(), position.tolist(), size.tolist(), bucket.tolist(), contents.tolist()):
        seen.setdefault((b, c), set()).add(pieces[d][2][p : p + n + 1399])
    assert all(len(v) == 1 for v in seen.values())
