"""Benchmark decontamination by spaced-seed hashing; DataFrame operations only.

A seed is a fixed mask over consecutive words: the words under the mask are hashed, those between are
ignored, so a substituted word does not stop a hit. Every position of every document gets a hash per
mask; they are joined with the hashes of the benchmark items. Each hit lines a whole item up with the
document around it. The overlap counts if enough of the item's words agree in their places, or if a passage
does: the best stretch where an agreeing word counts 1 and any other -4 is long enough. So an item copied in
part, or with words put in or left out between long pieces, is found as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import id_text

#: Word offsets under each mask. With a fifth of the words of an item substituted anywhere, the first four hit
#: every item of 7 to 9 and of 11 to 15 words, 98 in 100 of 10 words, and nearly all longer ones.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 3, 4, 6), (0, 1, 2, 5, 6), (0, 1, 2, 3, 5))
#: Masks for items of 5 and 6 words, whose every single substitution they get around.
SHORT_MASKS = ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4))
SHORT_WORDS = 6
#: Words of a passage in agreement (less 4 for each that differs within it) from which it counts.
PASSAGE = 13
SIMILARITY = 0.8
#: Seeds of the benchmark up to which they are broadcast (about 40 bytes each); beyond, a shuffle join.
BROADCAST_SEEDS = 1_000_000


def words(text: Column) -> Column:
    """Hashes of a text's words: runs of letters and digits, in lower case."""
    found = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.transform(found, lambda w: F.xxhash64(w))


def _seeds(rows: DataFrame, keep: list[str], array: str, at: str, masks: dict[int, tuple[int, ...]]) -> DataFrame:
    """A row per position and mask: keep, the position and the hash."""
    spread = rows.select(*keep, F.explode(F.sequence(F.lit(0), F.greatest(F.size(array) - 4, F.lit(0)))).alias(at))
    seed = [F.xxhash64(F.lit(k), *(F.get(array, F.col(at) + o) for o in mask)) for k, mask in masks.items()]
    return spread.select(*keep, at, F.explode(F.array(*seed)).alias("seed"))


def items(benchmark: DataFrame) -> DataFrame:
    """(item_id, own, n_words) of every item with five words at least."""
    rows = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), F.lower(F.coalesce(benchmark["text"], F.lit(""))).alias("text"))
    found = F.filter(F.split("text", r"[^\p{L}\p{N}]+"), lambda w: w != "")
    rows = rows.where(F.col("item_id").isNotNull()).select("item_id", F.transform(found, lambda w: F.xxhash64(w)).alias("own"))
    return rows.select("item_id", "own", F.size("own").alias("n_words")).where("n_words >= 5").distinct()


def overlaps(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """(doc_id, item_id, n_words, n_matched, similarity, passage) of every item found in a document.

    An item is found where, laid over a document's words from some position, at least the given share of its
    words agree place by place, or a passage of it scores PASSAGE; n_matched and passage are the best of such
    places. Null, empty and wordless texts match nothing, nor do items of fewer than five words; equal items are
    found each; rows with one id count as one document and a null id is left out; texts of any length are
    taken whole; an empty table gives no rows; other columns are ignored.
    """
    bench = items(benchmark)
    general, short = dict(enumerate(MASKS)), dict(enumerate(SHORT_MASKS, len(MASKS)))
    keys = _seeds(bench, ["item_id", "own"], "own", "j", general)
    few = bench.where(F.col("n_words") <= SHORT_WORDS)
    masks = general
    if not few.isEmpty():
        keys, masks = keys.unionByName(_seeds(few, ["item_id", "own"], "own", "j", short)), general | short
    keys = keys.drop("own").distinct()
    small = keys.limit(broadcast_seeds + 1).count() <= broadcast_seeds
    hashed = id_text(docs).where("doc_id is not null").select("doc_id", words(F.col("text")).alias("words"))
    if small:
        hits = _seeds(hashed, ["doc_id", "words"], "words", "i", masks).join(F.broadcast(keys), "seed")
        # A hit that continues one word to the left under the same mask says nothing new, but finding
        # out costs as much as the check itself; equal lines fall together in the aggregate below.
        lined = hits.select("doc_id", "item_id", (F.col("i") - F.col("j")).alias("line"), "words").join(F.broadcast(bench), "item_id")
    else:
        hits = _seeds(hashed, ["doc_id", "words"], "words", "i", masks).drop("words").join(keys, "seed")
        lines = hits.select("doc_id", "item_id", (F.col("i") - F.col("j")).alias("line")).distinct()
        lined = lines.join(hashed, "doc_id").join(bench, "item_id")

    def word(state: Column, t: Column) -> Column:
        same = F.get("words", F.col("line") + t) == F.get("own", t)
        now = F.greatest(state["now"] + F.when(same, 1).otherwise(-4), F.lit(0))
        return F.struct((state["n"] + F.when(same, 1).otherwise(0)).alias("n"), now.alias("now"), F.greatest(state["best"], now).alias("best"))

    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("now"), F.lit(0).alias("best"))
    agree = F.aggregate(F.sequence(F.lit(0), F.col("n_words") - 1), none, word)
    found = lined.select("doc_id", "item_id", "n_words", agree.alias("agree"))
    found = found.select("doc_id", "item_id", "n_words", F.col("agree.n").alias("n_matched"), F.col("agree.best").alias("passage"))
    found = found.where((F.col("n_matched") >= F.lit(similarity) * F.col("n_words")) | (F.col("passage") >= PASSAGE))
    best = found.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("n_words", "n_matched", "passage")))
    return best.select("doc_id", "item_id", "n_words", "n_matched", F.round(F.col("n_matched") / F.col("n_words"), 4).alias("similarity"), "passage")


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs without the documents in which a benchmark item is found; all columns stay. Rows without an
    id can't be matched and stay."""
    bad = overlaps(docs, benchmark, similarity).select(F.col("doc_id").alias("__contaminated")).distinct()
    return docs.join(bad, docs["doc_id"].cast("long") == bad["__contaminated"], "left_anti")


def oracle(similarity: float = SIMILARITY) -> str:
    """The same in DuckDB SQL, without masks: every line on which an item and a document share words."""
    return f"""
    WITH d AS (SELECT doc_id, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i
               FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents)),
    i AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM benchmark),
    b AS (SELECT item_id, len(w) AS n, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS j FROM i WHERE len(w) >= 5),
    l AS (SELECT doc_id, item_id, i - j AS line, max(n) AS n, count(*) AS m, list_sort(list(j)) AS js FROM d JOIN b USING (w)
          GROUP BY doc_id, item_id, line HAVING count(*) >= least({similarity} * max(n), {PASSAGE})),
    x AS (SELECT doc_id, item_id, line, n, m, js, unnest(range(1, len(js) + 1)) AS x FROM l),
    f AS (SELECT doc_id, item_id, line, max(n) AS n, max(m) AS m, max(p) AS p
          FROM (SELECT x.doc_id, x.item_id, x.line, x.n, x.m,
                       list_max(list_transform(range(x, len(js) + 1), lambda y: 5 * (y - x + 1) - 4 * (js[y] - js[x] + 1))) AS p FROM x)
          GROUP BY doc_id, item_id, line)
    SELECT doc_id, item_id, CAST(max(n) AS INTEGER) AS n_words, CAST(max(m) AS INTEGER) AS n_matched,
           round(max(m) / CAST(max(n) AS DOUBLE), 4) AS similarity, CAST(max(p) AS INTEGER) AS passage
    FROM f WHERE m >= {similarity} * n OR p >= {PASSAGE} GROUP BY doc_id, item_id
    """
