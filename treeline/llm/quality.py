"""Quality scores: random Fourier features of document statistics, ridge, isotonic calibration.

Each document becomes a vector of statistics of its whole text. Random Fourier features approximate a
Gaussian kernel over the standardised statistics; normal equations Z'Z and Z'y are summed per partition
and added up; ridge weights follow from one small solve; isotonic calibration turns raw scores into
probabilities. The statistics are computed once per text and written; training and scoring read them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm import calibration
from treeline.llm.common import Workspace, bounded_labels, fold, id_text, slices

#: Training documents per label value at most: the smallest by hash of the id.
SAMPLE_PER_LABEL = 40_000
FEATURES = 512
RIDGE = 1e-2
#: Kernel width in standardised units per statistic.
WIDTH = 4.0
SEED = 17

STATS = (
    "log_chars log_words mean_word sd_word upper digit space punct letter nonascii distinct_word top_word "
    "distinct_line blank_line mean_line bigram_distinct symbol exclaim max_run vowel short_word long_word "
    "title_word lone_punct sentence entropy"
).split()

_WORD = re.compile(r"\S+")
_RUN = re.compile(r"(.)\1{3,}", re.S)


def statistics(text: str) -> list[float]:
    """The statistics of a whole text; all 0 for an empty one."""
    n = len(text)
    words = text.split()
    if not words:
        return [float(np.log1p(n))] + [0.0] * (len(STATS) - 1)
    m = len(words)
    raw = np.frombuffer(text.encode("utf-32-le"), "<u4")
    lengths = np.fromiter(map(len, words), np.float64, m)
    ascii_ = np.bincount(np.minimum(raw, 128), minlength=129) / n
    upper = ascii_[65:91].sum()
    lower = ascii_[97:123].sum()
    digit = ascii_[48:58].sum()
    punct = ascii_[33:48].sum() + ascii_[58:65].sum() + ascii_[91:97].sum() + ascii_[123:127].sum()
    symbol = ascii_[[35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 94, 95, 124, 126]].sum()
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    freq = np.fromiter(counts.values(), np.float64, len(counts)) / m
    lines = text.split("\n")
    filled = [x for x in lines if x.strip()]
    pairs = len(set(zip(words, words[1:])))
    return [
        float(np.log1p(n)),
        float(np.log1p(m)),
        float(lengths.mean()),
        float(lengths.std()),
        float(upper),
        float(digit),
        float(ascii_[32] + ascii_[9:14].sum()),
        float(punct),
        float(upper + lower),
        float(ascii_[128]),
        len(counts) / m,
        float(freq.max()),
        len(set(filled)) / max(1, len(filled)),
        1 - len(filled) / len(lines),
        float(np.log1p(m / max(1, len(filled)))),
        pairs / max(1, m - 1),
        float(symbol),
        float(ascii_[33]),
        float(sum(len(x.group()) for x in _RUN.finditer(text)) / n),
        float(ascii_[[97, 101, 105, 111, 117, 65, 69, 73, 79, 85]].sum()),
        float((lengths <= 2).mean()),
        float((lengths >= 12).mean()),
        sum(map(str.istitle, words)) / m,
        sum(1 for w in words if not w[0].isalnum() and len(w) <= 2) / m,
        float(ascii_[[46, 33, 63]].sum() * n / m),
        float(-(freq * np.log(freq)).sum() / max(1.0, np.log(m))) if m > 1 else 0.0,
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats array<double>) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=4 << 20):
                got = [statistics(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(got, pa.list_(pa.float64()))], names=["doc_id", "stats"]
                )

    return id_text(docs).mapInArrow(run, "doc_id long, stats array<double>")


class Model:
    """Standardisation, random projection, ridge weights and calibration knots."""

    def __init__(self, mean, scale, weights, knots, seed=SEED, features=FEATURES):
        self.mean, self.scale, self.weights, self.knots = mean, scale, weights, knots
        r = np.random.default_rng(seed)
        self.w = r.normal(0, 1 / WIDTH, (len(mean), features))
        self.b = r.uniform(0, 2 * np.pi, features)

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        z = np.cos(x @ self.w + self.b) * np.sqrt(2 / len(self.b))
        return np.hstack([z, x / 8, np.ones((len(x), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return calibration.apply(*self.knots, self.raw(stats))


def _summed(rows: DataFrame, f, size: int) -> np.ndarray:
    """Sum over partitions of f(stats, labels, weights, halves), a vector of a fixed size; added up in the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                stats = np.array(b.column("stats").flatten()).reshape(b.num_rows, -1)
                total += f(stats, np.array(b.column("label"), float), np.array(b.column("weight"), float), np.array(b.column("half")))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["v"])

    return sum((np.array(r["v"]) for r in rows.mapInArrow(run, "v array<double>").collect()), np.zeros(size))


def train(stats: DataFrame, labelled: DataFrame, work: Workspace) -> Model:
    """Fit on stats (doc_id, stats) of the bounded sample labelled (doc_id, label, weight); all sums are weighted,
    so the mix of labels is that of all rows. The calibration takes each half's scores from a fit of the
    other half, so it sees how the model does on rows it has not learned from."""
    rows = stats.join(F.broadcast(labelled), "doc_id").select("stats", "label", "weight", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)).cast("int").alias("half"))
    rows = work.table(rows, "sample")  # so that the passes below read the sample, not all statistics
    k = len(STATS)
    s = _summed(rows, lambda x, y, w, half: np.concatenate([w @ x, w @ (x * x), [w.sum()]]), 2 * k + 1)
    n = max(1.0, s[-1])
    mean = s[:k] / n
    scale = np.sqrt(np.maximum(s[k : 2 * k] / n - mean**2, 0)) + 1e-6
    size = FEATURES + k + 1
    model = Model(mean, scale, np.zeros(size), (np.array([0.0]), np.array([0.0])))
    upper = np.triu_indices(size)

    def normal(x: np.ndarray, y: np.ndarray, w: np.ndarray, half: np.ndarray) -> np.ndarray:
        z = model.features(x)
        out = []
        for h in (0, 1):
            zh, wh = z[half == h], w[half == h]
            zw = zh.T * wh
            out += [(zw @ zh)[upper], zw @ y[half == h], [wh.sum()]]
        return np.concatenate(out)

    parts = _summed(rows, normal, 2 * (len(upper[0]) + size + 1)).reshape(2, -1)

    def solve(a: np.ndarray) -> np.ndarray:
        gram, n = np.zeros((size, size)), max(1.0, a[-1])
        gram[upper] = a[: len(upper[0])]
        gram = gram + np.triu(gram, 1).T
        return np.linalg.solve(gram / n + RIDGE / 100 * np.eye(size), a[len(upper[0]) : -1] / n)

    model.weights = solve(parts.sum(0))
    other = np.stack([solve(parts[1]), solve(parts[0])], 1)  # the weights a half is scored by
    scored = rows.mapInArrow(_scorer(model, other), "raw double, label int, weight double").toPandas()  # bounded by the sample
    scored = scored.sort_values(["raw", "label", "weight"])
    model.knots = calibration.isotonic(scored["raw"].to_numpy(), scored["label"].to_numpy(float), weights=scored["weight"].to_numpy())
    return model


def _scorer(model: Model, weights: np.ndarray):
    """(raw, label, weight) of (stats, label, weight, half), by the half's column of weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                stats = np.array(b.column("stats").flatten()).reshape(b.num_rows, -1)
                raw = (model.features(stats) @ weights)[np.arange(b.num_rows), np.array(b.column("half"))]
                yield pa.RecordBatch.from_arrays([pa.array(raw), b.column("label"), b.column("weight")], names=["raw", "label", "weight"])

    return run


def score(
    docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, threshold: float = 0.3, sample: int = SAMPLE_PER_LABEL
) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of docs.

    Labels are learned only from rows whose crc32(doc_id) mod modulus is not held. Null and empty texts
    have the statistics of an empty text and are scored like any other; without any label all scores
    are 0. Statistics are of whole texts, however long; equal texts have equal scores. Repeated rows get a row
    each; of repeated labels the larger counts; a null id counts as held out; an empty table gives no rows;
    other columns are ignored.
    """
    work = Workspace(docs.sparkSession, "quality")
    stats = work.table(with_statistics(docs), "stats")
    model = train(stats, bounded_labels(docs, labels, "quality", modulus, held, sample), work)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.array(b.column("stats").flatten()).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(x))], names=["doc_id", "score"])

    out = stats.mapInArrow(run, "doc_id long, score double")
    return out.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), modulus) == held, F.lit(True)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
