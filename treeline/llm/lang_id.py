"""Language identification by rank-order profiles.

Each language's profile lists its most frequent letter n-grams (1 to 3 letters, words padded with a
blank). A document's own most frequent n-grams are compared with every profile by the out-of-place
distance: the sum of rank differences, where an n-gram that a profile lacks counts as the maximum.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import fold, slices

MAX_N = 3
PROFILE = 300
#: Training documents per language at most: the smallest by hash of the id.
SAMPLE_PER_LANG = 2000
CACHE_WORDS = 300_000

#: Runs of letters, as Unicode has them.
_LETTERS = re.compile(r"[^\W\d_]+")


def _grams(word: str) -> np.ndarray:
    """Codes of a padded word's n-grams, 21 bits a character; n differs by magnitude."""
    c = np.array([32, *map(ord, word), 32], np.int64)
    parts = [c[1:-1], (c[:-1] << 21) | c[1:], (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]]
    return np.concatenate(parts[:MAX_N])


class _GramCache(dict):
    def __missing__(self, word: str) -> np.ndarray:
        if len(self) >= CACHE_WORDS:
            self.clear()
        got = _grams(word)
        if len(word) <= 64:
            self[word] = got
        return got


def counts(text: str, cache: _GramCache) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram codes of a whole text, ascending, and how often each occurs."""
    words = Counter(_LETTERS.findall(text.lower()))
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    arrays = [cache[w] for w in words]
    codes = np.concatenate(arrays)
    times = np.repeat(np.fromiter(words.values(), np.int64, len(words)), [len(a) for a in arrays])
    order = np.argsort(codes, kind="stable")
    codes, times = codes[order], times[order]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    return codes[first], np.add.reduceat(times, first)


def top(codes: np.ndarray, times: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent codes, most frequent first; ties go to the smaller code."""
    if len(codes) > size:
        floor = np.partition(times, len(times) - size)[len(times) - size]
        keep = times >= floor
        codes, times = codes[keep], times[keep]
    return codes[np.lexsort((codes, -times))[:size]]


def train(docs: DataFrame, modulus: int = 3, held: int = 1, sample: int = SAMPLE_PER_LANG) -> dict[str, np.ndarray]:
    """Profiles by language, from a bounded sample of rows whose crc32(doc_id) mod modulus is not held."""
    from pyspark.sql import Window

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), modulus) != held))
    # Rows far from the smallest hashes go before the window, so no language's rows meet in one task.
    places = 1 << 40
    counts_ = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    if not counts_:
        return {}
    shares = [F.lit(x) for k, n in counts_.items() for x in (k, int(places * min(1.0, (2 * sample + 200) / n)))]
    rows = rows.withColumn("place", F.pmod(F.xxhash64("doc_id"), F.lit(places))).where(F.col("place") <= F.element_at(F.create_map(*shares), F.col("lang")))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id"))
    chosen = rows.withColumn("nth", nth).where(F.col("nth") <= sample).select("doc_id", "lang").distinct()
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].alias("lang"), docs["text"].alias("text"))
    texts = texts.where(F.col("text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, sums = _GramCache(), {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                codes, times = counts(text, cache)
                sums.setdefault(lang, Counter()).update(dict(zip(codes.tolist(), times.tolist())))
        for lang, c in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(c)), pa.array(list(c), pa.int64()), pa.array(list(c.values()), pa.int64())],
                names=["lang", "gram", "many"],
            )

    sampled = texts.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").repartition(8)  # chosen: sample rows a language at most
    grams = sampled.mapInArrow(run, "lang string, gram long, many long").groupBy("lang", "gram").agg(F.sum("many").alias("many"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("many"), "gram"))
    kept = grams.withColumn("nth", nth).where(F.col("nth") <= PROFILE).select("lang", "gram", "nth").collect()
    profiles: dict[str, list] = {}
    for r in sorted(kept, key=lambda r: (r["lang"], r["nth"])):
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return {k: np.array(v, np.int64) for k, v in profiles.items()}


class Model:
    """Rank of every profile n-gram in every language, ready for look-up."""

    def __init__(self, profiles: dict[str, np.ndarray]):
        self.langs = sorted(profiles)
        self.codes = np.unique(np.concatenate([profiles[k] for k in self.langs] or [np.empty(0, np.int64)]))
        self.ranks = np.full((len(self.langs), len(self.codes) + 1), -1, np.int64)
        for i, k in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.codes, profiles[k])] = np.arange(len(profiles[k]))

    def predict(self, text: str | None, cache: _GramCache) -> tuple[str, float]:
        """Language and score: 1 - (nearest distance / mean distance of the others), 0 to 1."""
        if not text or not self.langs:
            return "und", 0.0
        own = top(*counts(text, cache))
        if not len(own):
            return "und", 0.0
        at = np.searchsorted(self.codes, own)
        at[(at < len(self.codes)) & (self.codes[np.minimum(at, len(self.codes) - 1)] != own)] = len(self.codes)
        ranks = self.ranks[:, at]
        places = np.where(ranks < 0, PROFILE, np.abs(ranks - np.arange(len(own))))
        total = places.sum(1)
        best = int(np.argmin(total))
        if len(total) == 1:
            return self.langs[0], float(1 - total[0] / (PROFILE * len(own)))
        other = np.delete(total, best).mean()
        return self.langs[best], float(min(1.0, max(0.0, 1 - total[best] / other))) if other else 0.0


def identify(docs: DataFrame, modulus: int = 3, held: int = 1, sample: int = SAMPLE_PER_LANG) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row of docs.

    Text that is null, empty or without a letter gives `und` and score 0, as does a table with no
    language to learn. Texts of any length are taken whole. Ties between languages go to the alphabetically first; ties between n-grams to the
    smaller code. Repeated rows give a row each and count each in training; a null id counts as held out; an empty
    table gives no rows; other columns are ignored. Profiles, one per distinct language, are held by every task.
    """
    model = Model(train(docs, modulus, held, sample))
    kept = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    kept = kept.select("doc_id", F.coalesce(fold(F.col("doc_id"), modulus) == held, F.lit(True)).alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _GramCache()
        for batch in batches:
            for part in slices(batch, limit=4 << 20):
                got = [model.predict(t, cache) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    return kept.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
