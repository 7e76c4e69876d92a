"""Retrieval: exact BM25, cosine top-k, reciprocal-rank fusion, diversification, evidence.

Rows are nodes: any number of key columns, given by name. Questions are rows too, so a whole set of
questions is one plan; the postings meet only the terms that some question asks for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from treeline.functions import text as T
from treeline.functions import vectors as V
from treeline.session import settled

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
RRF_K = 60
#: Distinct question terms up to which they are broadcast.
BROADCAST_TERMS = 500_000
#: Query vectors of a block (a few kilobytes each at most).
BROADCAST_QUERIES = 10_000
#: Scores, of nodes by questions, that a task has in memory at once.
BLOCK_SCORES = 250_000
#: Scores are ranked by nine decimals; what is this much worse than the k-th may still round to it.
ROUNDING = 2e-9


def postings(nodes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, term, tf, size): a row per node and term over all indexed columns; size is the node's length."""
    words = F.concat(*[T.tokens(c) for c in columns])
    rows = nodes.select(*keys, words.alias("words"))
    rows = rows.select(*keys, F.size("words").alias("size"), F.explode("words").alias("term"))
    return rows.groupBy(*keys, "term").agg(F.count("*").alias("tf"), F.first("size").alias("size"))


def corpus_stats(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """(n_nodes, avg_size): one row; empty nodes count."""
    words = F.concat(*[T.tokens(c) for c in columns])
    return nodes.agg(F.count("*").alias("n_nodes"), F.avg(F.size(words)).alias("avg_size"))


def question_terms(questions: DataFrame, key: str, column: str) -> DataFrame:
    """(key, term) of every question."""
    return questions.select(key, F.explode(T.query_terms(column)).alias("term"))


def bm25(nodes: DataFrame, keys: list[str], columns: list[str], questions: DataFrame, qkey: str, qcolumn: str) -> DataFrame:
    """(qkey, keys, score) of every node that holds a term of the question; the lower, the better.

    Terms are found before postings are counted: a node's words are cut to those asked for, so the
    shuffle carries matches, not the corpus's postings.
    """
    asked = question_terms(questions, qkey, qcolumn)
    few = asked.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    small = F.broadcast if few else (lambda x: x)
    terms = asked.select("term").distinct()
    words = F.concat(*[T.tokens(c) for c in columns])
    rows = nodes.select(*keys, words.alias("words"))
    rows = rows.select(*keys, F.size("words").alias("size"), F.explode("words").alias("term"))
    # A node's terms meet in its own task: what is shuffled is a row per node and asked term.
    found = rows.join(small(terms), "term").groupBy(*keys, "term").agg(F.count("*").alias("tf"), F.first("size").alias("size"))
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    stats = corpus_stats(nodes, columns)
    idf = F.log((F.col("n_nodes") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = df.join(F.broadcast(stats)).select("term", "avg_size", F.when(idf > 0, idf).otherwise(F.lit(LEAST_IDF)).alias("idf"))
    share = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("avg_size")))
    # Common terms meet every node, so questions and weights, a row per asked term, go to the matches.
    wanted = small(asked.join(small(weights), "term"))
    scored = found.join(wanted, "term").select(qkey, *keys, (F.col("idf") * share).alias("part"))
    return scored.groupBy(qkey, *keys).agg((-F.sum("part")).alias("score"))


def top(rows: DataFrame, by: list[Column], k: int, per: list[str] | None = None, rank: str = "rank") -> DataFrame:
    """The first k rows by an order, per group if given, with their rank from 1."""
    if not per:
        order = Window.orderBy(*by)
        return rows.orderBy(*by).limit(k).withColumn(rank, F.row_number().over(order).cast("int"))
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*per).orderBy(*by)).cast("int")).where(F.col(rank) <= k)


def search(nodes: DataFrame, keys: list[str], columns: list[str], questions: DataFrame, qkey: str, qcolumn: str, k: int = 50) -> DataFrame:
    """BM25 top k per question, ties to smaller keys."""
    asked = question_terms(questions, qkey, qcolumn).distinct().limit(BROADCAST_TERMS + 1)
    table = asked.toArrow()
    if 0 < table.num_rows <= BROADCAST_TERMS:
        scored = bm25_best(nodes, keys, columns, table, asked.schema[qkey].dataType, k)
    else:
        scored = bm25(nodes, keys, columns, questions, qkey, qcolumn)
    return top(scored.withColumn("score", F.round("score", 9)), [F.col("score"), *map(F.col, keys)], k, [qkey])


def bm25_best(nodes: DataFrame, keys: list[str], columns: list[str], asked, kind: DataType, k: int) -> DataFrame:
    """(qkey, keys, score) as bm25 gives them, at least the first k of every question. asked: an Arrow table (qkey of
    that kind, term), not empty.

    Scores of all nodes for all questions are many times the texts, so they never leave their task. Nodes are cut to counts
    of asked terms once and kept in order of their keys; each task then scores them in blocks and hands on its best.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    qkey = asked.column_names[0]
    coded = lambda c: asked.column(c).combine_chunks().dictionary_encode(null_encoding="encode")
    who, term = coded(qkey), coded("term")
    ids, vocabulary, size, n_asked = who.dictionary, term.dictionary, len(term.dictionary), len(who.dictionary)
    by_term = np.argsort(np.asarray(term.indices), kind="stable")
    askers = np.asarray(who.indices)[by_term].astype(np.int64)
    first = np.searchsorted(np.asarray(term.indices)[by_term], np.arange(size + 1))

    def lengths(lists) -> np.ndarray:
        return pc.list_value_length(lists).to_numpy(zero_copy_only=False)

    def counted(batches):
        for b in batches:
            many, words = lengths(b.column("words")), b.column("words").flatten()
            node = np.repeat(np.arange(b.num_rows), many)
            at = pc.fill_null(pc.index_in(words, value_set=vocabulary.cast(words.type)), -1).to_numpy(zero_copy_only=False)
            pairs, tf = np.unique(node[at >= 0] * size + at[at >= 0], return_counts=True)
            ends = pa.array(np.searchsorted(pairs, np.arange(b.num_rows + 1) * size), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (pairs % size, tf)]
            yield pa.RecordBatch.from_arrays([*b.select(keys).columns, pa.array(many, pa.int32()), *lists], [*keys, "size", "terms", "tfs"])

    def merged(b):
        """(keys, sizes, node, term, tf) of rows in order of keys, those of one key being one node."""
        new = b.column("nth").to_numpy() == 1
        node = np.repeat(np.cumsum(new) - 1, lengths(b.column("terms")))
        at, tf = (b.column(c).flatten().to_numpy() for c in ("terms", "tfs"))
        if not new.all():
            pairs, place = np.unique(node * size + at, return_inverse=True)
            node, at, tf = pairs // size, pairs % size, np.bincount(place, tf, len(pairs))
        heads = b.filter(pa.array(new))
        return heads.select(keys), heads.column("size").to_numpy(), node, at, tf

    def whole(batches):
        """Batches that end where a node does."""
        held = None
        for b in batches:
            b = b if held is None else pa.concat_batches([held, b])
            last = int(np.flatnonzero(b.column("nth").to_numpy() == 1)[-1]) if b.num_rows else 0
            held = b.slice(last)
            if last:
                yield b.slice(0, last)
        if held is not None and held.num_rows:
            yield held

    def frequencies(batches):
        df, n, words = np.zeros(size, np.int64), 0, 0
        for b in whole(batches):
            df += np.bincount(merged(b)[3], minlength=size)
            n, words = n + b.num_rows, words + int(b.column("size").to_numpy().sum(dtype=np.int64))
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, [-1, -2]), pa.int32()), pa.array(np.append(df[seen], [n, words]), pa.int64())], ["at", "n"])

    words = nodes.select(*keys, F.concat(*[T.tokens(c) for c in columns]).alias("words"))
    kinds = ", ".join(f"`{c}` {nodes.schema[c].dataType.simpleString()}" for c in keys)
    rows = words.mapInArrow(counted, f"{kinds}, size int, terms array<int>, tfs array<int>").repartition(*keys).sortWithinPartitions(*keys, "size")
    rows = settled(rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("size"))))
    found = dict(rows.mapInArrow(frequencies, "at int, n long").groupBy("at").agg(F.sum("n")).collect())
    n, total = found.pop(-1, 0), found.pop(-2, 0)
    df = np.zeros(size)
    df[list(found)] = list(found.values())
    average = total / n if total else 1.0
    idf = np.log((n - df + 0.5) / (df + 0.5))
    idf = np.where(idf > 0, idf, LEAST_IDF)

    def cut(q, s, at, bound):
        """The first k of every question, with what may round to the k-th; of equals k by order of keys."""
        order = np.lexsort((at, -s, q))
        q, s, at = q[order], s[order], at[order]
        here = np.arange(len(q))
        begin = np.searchsorted(q, np.arange(n_asked))
        full = np.searchsorted(q, np.arange(n_asked), "right") - begin >= k
        bound[full] = np.maximum(bound[full], s[begin[full] + k - 1])
        run = np.ones(len(q), bool)
        run[1:] = (q[1:] != q[:-1]) | (s[1:] != s[:-1])
        keep = (s >= bound[q] - ROUNDING) & (here - np.maximum.accumulate(np.where(run, here, 0)) < k)
        return q[keep], s[keep], at[keep]

    def best(batches):
        bound = np.zeros(n_asked)
        q, s, at = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        seen, kept, arrived = 0, None, np.zeros(0, np.int64)
        for b in whole(batches):
            heads, sizes, node, terms, tf = merged(b)
            part = idf[terms] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[node] / average)))
            step = max(1, BLOCK_SCORES // n_asked)
            for low in range(0, heads.num_rows, step):
                high = min(low + step, heads.num_rows)
                i, j = np.searchsorted(node, [low, high])
                many = first[terms[i:j] + 1] - first[terms[i:j]]
                pick = np.repeat(first[terms[i:j]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                scores = np.bincount(np.repeat(node[i:j] - low, many) * n_asked + askers[pick], np.repeat(part[i:j], many), (high - low) * n_asked)
                scores = scores.reshape(high - low, n_asked)
                if high - low >= k:
                    bound = np.maximum(bound, np.partition(scores, high - low - k, axis=0)[high - low - k])
                x, y = np.nonzero((scores > 0) & (scores >= bound - ROUNDING))
                q, s, at = cut(np.append(q, y), np.append(s, scores[x, y]), np.append(at, x + low + seen), bound)
            kept = pa.Table.from_batches([heads]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([heads])])
            arrived = np.append(arrived, np.arange(seen, seen + heads.num_rows))
            seen += heads.num_rows
            used = np.isin(arrived, at)
            kept, arrived = kept.filter(pa.array(used)).combine_chunks(), arrived[used]
        if len(q):
            rows = kept.take(pa.array(np.searchsorted(arrived, at)))
            out = pa.Table.from_arrays([ids.take(pa.array(q)), *rows.columns, pa.array(-s)], [qkey, *keys, "score"])
            yield from out.combine_chunks().to_batches()

    return rows.mapInArrow(best, f"`{qkey}` {kind.simpleString()}, {kinds}, score double")


def vector_search(vectors: DataFrame, keys: list[str], column: str, query: list[float], k: int = 50) -> DataFrame:
    """Cosine top k. No rows for a query of length 0; vectors of another dimension are left out."""
    size = sum(x * x for x in query) ** 0.5
    rows = vectors.where(F.size(column) == len(query))
    if not query or size == 0:
        return rows.where("false").select(*keys, F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    q = V.literal([x / size for x in query])
    n = V.norm(F.col(column))
    score = F.round(V.dot(F.col(column), q) / F.when(n == 0, F.lit(1.0)).otherwise(n), 9)
    return top(rows.select(*keys, score.alias("score")), [F.desc("score"), *map(F.col, keys)], k)


def vector_search_all(vectors: DataFrame, keys: list[str], column: str, queries: DataFrame, qkey: str, qcolumn: str, k: int = 50) -> DataFrame:
    """Cosine top k of every query vector: a stated set of queries, in blocks that are broadcast, against all rows.
    Queries of length 0 give no rows; vectors of another dimension than the query's are left out."""
    asked = queries.select(qkey, F.col(qcolumn).cast("array<double>").alias("__q")).where("__q is not null")
    asked = asked.withColumn("__qn", V.norm(F.col("__q"))).where("__qn > 0")
    blocks = max(1, -(-asked.count() // BROADCAST_QUERIES))
    rows = vectors.select(*keys, F.col(column).cast("array<double>").alias("__v")).withColumn("__n", V.norm(F.col("__v")))
    score = F.round(V.dot(F.col("__v"), F.col("__q")) / F.col("__qn") / F.when(F.col("__n") == 0, F.lit(1.0)).otherwise(F.col("__n")), 9)
    out = None
    for i in range(blocks):
        block = asked.where(F.pmod(F.xxhash64(qkey), F.lit(blocks)) == i) if blocks > 1 else asked
        met = rows.join(F.broadcast(block), F.size("__v") == F.size("__q")).select(qkey, *keys, score.alias("score"))
        best = top(met, [F.desc("score"), *map(F.col, keys)], k, [qkey])
        out = best if out is None else out.unionByName(best)
    return out


def rrf(lists: list[DataFrame], keys: list[str], k: int = RRF_K, by: list[str] | None = None) -> DataFrame:
    """Fuse ranked lists (keys, rank, score): (keys, rrf, match_sources, score, position), per question if by names
    its key.

    A key twice in one list counts at both places. score is the one of the first list that has the key; order
    is by rrf, then first list and rank.
    """
    by = by or []
    parts = [x.select(*by, *keys, F.lit(i).alias("list"), "rank", "score") for i, x in enumerate(lists)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    fused = rows.groupBy(*by, *keys).agg(
        F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("rrf"),
        F.array_sort(F.collect_set("list")).alias("match_sources"),
        F.min(F.struct("list", "rank", "score")).alias("first"),
    )
    fused = fused.select(*by, *keys, F.round("rrf", 6).alias("rrf"), "match_sources", F.col("first.score").alias("score"), F.col("first.list").alias("list"), F.col("first.rank").alias("list_rank"))
    order = Window.partitionBy(*by).orderBy(F.desc("rrf"), "list", "list_rank")  # a pool of candidates
    return fused.withColumn("position", F.row_number().over(order).cast("int")).drop("list", "list_rank")


def rerank(candidates: DataFrame, question: str | Column, document: Column, scorer: Callable, order: str = "position", top_k: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Order a pool of candidates, one per question if by names its key, by an injected relevance score:
    scorer(question, document column) -> column, null for no answer. Candidates without an answer keep their places
    behind the others."""
    rows = candidates.withColumn("rerank", scorer(question, F.substring(document, 1, 2000)))
    window = Window.partitionBy(*(by or [])).orderBy(F.desc_nulls_last("rerank"), order)
    rows = rows.withColumn(order, F.row_number().over(window).cast("int"))
    return rows.where(F.col(order) <= top_k) if top_k else rows


def overlap_scorer(question: str | Column, document: Column) -> Column:
    """A deterministic stand-in for a reranking service: share of the question's words found."""
    return F.round(T.word_overlap(F.lit(question), document), 6)


def hybrid(lexical: DataFrame, vector: DataFrame | None, keys: list[str], mode: str = "auto", by: list[str] | None = None) -> tuple[DataFrame, str]:
    """Candidates in order, and how they were found. Without vectors, or a vector result, BM25 alone answers."""
    plain = lambda x: x.select(*(by or []), *keys, F.lit(None).cast("double").alias("rrf"), F.array().cast("array<int>").alias("match_sources"), "score", F.col("rank").alias("position"))
    if mode == "bm25" or vector is None:
        return plain(lexical), "bm25"
    if mode == "vector":
        return (plain(lexical), "bm25") if vector.isEmpty() else (plain(vector), "vector")
    return rrf([lexical, vector], keys, by=by), "hybrid"


def diversify(ranked: DataFrame, per_doc: int, doc: str = "doc_id", order: str = "position", by: list[str] | None = None) -> DataFrame:
    """At most per_doc rows of a document (0: no limit), the best first."""
    if per_doc <= 0:
        return ranked
    nth = F.row_number().over(Window.partitionBy(*(by or []), doc).orderBy(order))
    return ranked.withColumn("__nth", nth).where(F.col("__nth") <= per_doc).drop("__nth")


def evidence(ranked: DataFrame, text: str, node_cap: int = 8000, total_cap: int = 60000, order: str = "position", by: list[str] | None = None) -> DataFrame:
    """Rows whose capped texts fit a total budget in order; the first always stays. Adds block and used."""
    block = F.substring(F.coalesce(F.col(text), F.lit("")), 1, node_cap)
    running = Window.partitionBy(*(by or [])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = ranked.withColumn("block", block).where("block <> ''")
    rows = rows.withColumn("used", F.sum(F.length("block")).over(running)).withColumn("__nth", F.count("*").over(running))
    return rows.where((F.col("used") <= total_cap) | (F.col("__nth") == 1)).drop("__nth")


def evidence_text(rows: DataFrame, by: list[str], header: Column, order: str = "position") -> DataFrame:
    """The blocks of a group joined in order under their headers."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.concat(header, F.lit("\n"), F.col("block")).alias("t"))))
    return rows.groupBy(*by).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n").alias("evidence"))


def doc_scores(rows: DataFrame, doc: str = "doc_id", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """Sum of a document's scores over the square root of one more than their number."""
    return rows.groupBy(*(by or []), doc).agg(F.round(F.sum(score) / F.sqrt(F.count("*") + 1), 9).alias("doc_score"), F.count("*").alias("n_chunks"))
