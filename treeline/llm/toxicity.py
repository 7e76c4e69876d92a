"""Toxicity by maximum-scoring segments of token log-odds.

Every token's score is its log-odds of the toxic against the clean class under an informative Dirichlet prior,
shrunk towards zero by its standard error, less a penalty that makes ordinary text drift downwards. One
linear scan per document finds every maximal-scoring segment. Their scores follow an extreme-value law
(Karlin-Altschul): lambda comes from the background token distribution, K from the best segments of clean
documents. The r best segments of a document are judged together by the sum statistic of that law, and isotonic
calibration makes the evidence a probability. K and the calibration use scores of documents by models that
were learned without them.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm import calibration
from treeline.llm.common import Workspace, bounded_labels, fold, id_text, slices, tidy

#: Training documents per label value at most: the smallest by hash of the id.
SAMPLE_PER_LABEL = 12_000
#: Weight of the Dirichlet prior as a share of all counts; it is spread over words by their overall frequency.
PRIOR = 0.1
#: Standard errors by which log-odds shrink towards zero.
SHRINK = 3.0
#: Words in fewer texts of the sample score zero, as their shrunken log-odds would.
MIN_TEXTS = 2
#: Parts of the sample that are scored by a model of the other parts.
FOLDS = 4
#: The penalty takes from ordinary text this many times what its tokens above zero give it. With so much the best
#: segments of clean text are mostly single tokens, where the law is rough; the calibration makes up for that.
DRIFT = 4.0
#: Expected number of segments by chance, below which a passage is significant.
E_VALUE = 0.01
#: Evidence of a text without any token that scores above zero.
NOTHING = -50.0
#: A text and its near copies count as one text together, in whole numbers of such a part of a token.
UNIT = 1 << 20
_WORDS = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def log_odds(tokens: np.ndarray, texts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Shrunken log-odds of words, toxic against clean, from how many tokens and how many texts of either class
    (columns: clean, toxic) have each, and from all tokens of either. The standard error counts texts, as the
    repeats of a word within one text are not independent."""
    if not (totals > 0).all():
        return np.zeros(len(tokens))
    with_prior = lambda x: x + PRIOR * x.sum(1, keepdims=True)
    share = with_prior(tokens) / (totals + PRIOR * totals.sum())
    with np.errstate(divide="ignore", invalid="ignore"):
        logit = np.log(share) - np.log1p(-share)
        delta = logit[:, 1] - logit[:, 0]
        sure = np.abs(delta) - SHRINK * np.sqrt((1 / with_prior(texts)).sum(1))
    return np.where((sure > 0) & np.isfinite(sure), np.sign(delta) * sure, 0.0)


def sketch(tokens: list[str]) -> int:
    """Smallest hash of the text's word triples: near copies mostly share it."""
    return min((zlib.crc32(" ".join(t).encode()) for t in zip(tokens, tokens[1:], tokens[2:])), default=zlib.crc32(" ".join(tokens).encode()))


def segments(values: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first token, last token, score) of tokens with these scores. Linear: each
    candidate is joined or closed once."""
    total = np.r_[0.0, np.cumsum(values)]
    at = np.flatnonzero(values > 0)
    stack: list[list] = []
    for p, left, right in zip(at.tolist(), total[at].tolist(), total[at + 1].tolist()):
        current = [p, p, left, right]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= current[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= current[3]:
                current.append(j)
                stack.append(current)
                break
            current = [stack[j][0], current[1], stack[j][2], current[3]]
            del stack[j:]
    return [(a, b, right - left) for a, b, left, right, _ in stack]


def sum_evidence(normal: list[float]) -> float:
    """-log of the chance that r independent segments reach the sum T of the r best normalised scores, at the r that
    gives most: exp(-T) T^(r-1) / (r! (r-1)!), which holds from T > r (r - 1), times 2^r for having tried
    several r. A single segment below zero keeps its score: no evidence, but comparable."""
    top = sorted(normal, reverse=True)
    best, total = top[0], 0.0
    for r, x in enumerate(top, 1):
        total += x
        if x <= 0 or total <= r * (r - 1):
            break
        best = max(best, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r) - (r - 1) * math.log(2))
    return best


def fit_k(n: np.ndarray, top: np.ndarray, weight: np.ndarray) -> float:
    """Maximum likelihood of K for best scores (in units of lambda) with P(top < x) = exp(-K n exp(-x)). The law is
    one of large scores, so texts up to the median count only as not being above it."""
    if not len(n):
        return 1.0
    u = float(np.median(top))
    above = float(weight[top > u].sum())
    return float(np.clip(above / float((weight * n * np.exp(-np.maximum(top, u))).sum()), 1e-6, 1.0))


class Model:
    """Token scores, the penalty, and extreme-value parameters of the background."""

    def __init__(self, vocabulary: list[str], scores: np.ndarray, background: np.ndarray, drift: float = DRIFT):
        """background: how often clean text has each word (a share of its tokens); the rest scores zero."""
        some = np.flatnonzero(scores)
        self.weights = dict(zip((vocabulary[i] for i in some), scores[some].tolist()))
        s, p = scores[some], background[some]
        rate = float(p[s > 0].sum())
        gain = float((s * p)[s > 0].sum())
        self.penalty = max(0.02, drift * gain / max(1e-9, 1 - rate))
        self.lam = self._root(np.r_[s, 0.0] - self.penalty, np.r_[p, max(0.0, 1 - p.sum())])
        self.k = 1.0
        self.knots = (np.array([0.0]), np.array([0.0]))

    @staticmethod
    def _root(s: np.ndarray, p: np.ndarray) -> float:
        """lambda > 0 with sum p exp(lambda s) = 1."""
        if not (s > 0).any():
            return 1.0
        f = lambda x: float((p * np.exp(np.minimum(700.0, x * s))).sum()) - 1
        low, high = 1e-9, 1.0
        while f(high) < 0 and high < 64:
            high *= 2
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if f(mid) < 0 else (low, mid)
        return max(high, 1e-6)

    def found(self, tokens: list[str]) -> list[tuple[int, int, float]]:
        """The maximal segments of a text."""
        values = np.fromiter(map(self.weights.get, tokens, repeat(0.0)), np.float64, len(tokens)) - self.penalty
        return segments(values)

    def passages(self, tokens: list[str]) -> tuple[list[tuple[int, int, float]], float]:
        """Segments of a text, those significant by themselves, and the evidence of its best ones together."""
        got = self.found(tokens)
        if not got:
            return [], NOTHING
        chance = math.log(self.k * max(2, len(tokens)))
        normal = [self.lam * x[2] - chance for x in got]
        return [x for x, n in zip(got, normal) if n >= -math.log(E_VALUE)], max(NOTHING, sum_evidence(normal))


_COUNTS = [f"{kind}_{label}_{f}" for kind in ("tokens", "texts") for label in (0, 1) for f in range(FOLDS)]


def _counted(texts: DataFrame) -> DataFrame:
    """(word, tokens_label_fold.., texts_label_fold..): how often, and in how many texts, in parts of UNIT."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, some = ([Counter() for _ in range(2 * FOLDS)] for _ in range(2))
        for b in batches:
            for label, part, unit, text in zip(*(b.column(c).to_pylist() for c in ("label", "fold", "unit", "text"))):
                at = label * FOLDS + part
                for w, n in Counter(words(text)).items():
                    tokens[at][w] += n * unit
                    some[at][w] += unit
        every = list(set().union(*tokens))
        columns = [pa.array([c[w] for w in every], pa.int64()) for c in tokens + some]
        yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *columns], names=["word", *_COUNTS])

    rows = texts.mapInArrow(tidy(count), "word string, " + ", ".join(f"{n} long" for n in _COUNTS))
    return rows.groupBy("word").agg(*(F.sum(n).alias(n) for n in _COUNTS))


def train(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, sample: int = SAMPLE_PER_LABEL) -> Model:
    """Learn from the bounded sample of labelled rows; token counts are summed in Spark. A text's near copies of
    its label share the counts of one text and a fold, else a copied text's words would pass for evidence."""
    work = Workspace(docs.sparkSession, "toxicity")
    chosen = bounded_labels(docs, labels, "toxic", modulus, held, sample)
    texts = id_text(docs).join(F.broadcast(chosen), "doc_id").select("label", "weight", "text")  # chosen: the sample's ids

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [sketch(words(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("weight"), pa.array(got, pa.int64()), b.column("text")], names=["label", "weight", "sketch", "text"])

    texts = work.table(texts.mapInArrow(tidy(sketched), "label int, weight double, sketch long, text string"), "sketched")
    copies = texts.groupBy("label", "sketch").agg(F.floor(F.lit(UNIT) / F.count("*")).alias("unit"))  # a row per sampled text at most
    texts = texts.join(F.broadcast(copies), ["label", "sketch"]).withColumn("fold", F.pmod("sketch", F.lit(FOLDS)).cast("int"))
    texts = work.table(texts.select("label", "weight", "fold", "unit", "text"), "sample")
    sums = work.table(_counted(texts), "counts")
    shape = (2, 2, FOLDS)  # tokens and texts, clean and toxic, folds
    totals = np.array([x or 0 for x in sums.agg(*(F.sum(n) for n in _COUNTS)).first()], float).reshape(shape)[0] / UNIT
    seen = sum((F.col(n) for n in _COUNTS[len(_COUNTS) // 2 :]), F.lit(0))
    rows = sums.where(seen >= MIN_TEXTS * (UNIT - SAMPLE_PER_LABEL)).orderBy("word").toArrow()  # words of the bounded sample
    vocabulary = rows["word"].to_pylist()
    counts = np.stack([rows[n].to_numpy() for n in _COUNTS], 1).reshape(-1, *shape) / UNIT

    def model(left_out: int | None) -> Model:
        kept = [f for f in range(FOLDS) if f != left_out]
        c, n = counts[..., kept].sum(3), totals[:, kept].sum(1)
        return Model(vocabulary, log_odds(c[:, 0], c[:, 1], n), np.maximum(0.5, c[:, 0, 0]) / max(1.0, n[0]))

    out, parts = model(None), [model(f) for f in range(FOLDS)]
    if not totals.sum(1).all():
        return out

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, top = [], []
            for part, text in zip(b.column("fold").to_pylist(), b.column("text").to_pylist()):
                tokens = words(text)
                n.append(float(max(2, len(tokens))))
                top.append(parts[part].lam * max((x[2] for x in parts[part].found(tokens)), default=0.0))
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.float64()), pa.array(top, pa.float64()), b.column("weight")], names=["n", "top", "weight"])

    clean = texts.where("label = 0").mapInArrow(tidy(best), "n double, top double, weight double").toArrow()  # bounded, too
    clean = clean.sort_by([(c, "ascending") for c in ("top", "n", "weight")])
    k = fit_k(*(clean[c].to_numpy() for c in ("n", "top", "weight")))
    for m in (out, *parts):
        m.k = k

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [parts[f].passages(words(t))[1] for f, t in zip(b.column("fold").to_pylist(), b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.float64()), b.column("label"), b.column("weight")], names=["raw", "label", "weight"])

    scored = texts.mapInArrow(tidy(evidence), "raw double, label int, weight double").toArrow()  # bounded by the sample
    raw, label, weight = (scored.sort_by([(c, "ascending") for c in ("raw", "label", "weight")])[c].to_numpy() for c in ("raw", "label", "weight"))
    out.knots = calibration.isotonic(raw, label.astype(float), bins=64, weights=weight)
    return out


def scan(
    docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, threshold: float = 0.3, sample: int = SAMPLE_PER_LABEL
) -> DataFrame:
    """(doc_id, held_out, score, predicted, passages) per row of docs; passages are the significant
    segments as (first word, last word, score).

    Labels are learned only from rows whose crc32(doc_id) mod modulus is not held. Null, empty and
    wordless texts have no evidence and get the score of that; without labels of both kinds all
    scores are 0. Texts of any length are scanned whole, in one pass. Equal texts have equal scores; of segments
    that tie, the shorter is taken. Repeated rows get a row each; of repeated labels the larger counts; a null id
    counts as held out; an empty table gives no rows; other columns are ignored.
    """
    model = train(docs, labels, modulus, held, sample)
    return apply(id_text(docs), model).select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), modulus) == held, F.lit(True)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "passages",
    )


def apply(texts: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, passages) for (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            for part in slices(batch):
                raw, spans = [], []
                for text in part.column("text").to_pylist():
                    sure, one = model.passages(words(text))
                    raw.append(one)
                    spans.append([dict(zip(("first", "last", "score"), x)) for x in sure])
                score = calibration.apply(*model.knots, np.array(raw))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(score, pa.float64()), pa.array(spans, kind)], names=["doc_id", "score", "passages"]
                )

    return texts.mapInArrow(tidy(run), "doc_id long, score double, passages array<struct<first: int, last: int, score: double>>")
