"""Every registered query: an operator over a stand-in input, and the same in DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.functions import answers
from treeline.functions import text as T
from treeline.operators import evaluate, index, navigate, pages, search, toc, tree
from treeline.plans import build, seam, standins as S
from treeline.session import settled
from treeline.sources import readers
from treeline.streaming import refresh


@dataclass
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


ALL: dict[str, Query] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A stand-in as a DataFrame."""
    names = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def duck(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def query(name: str, inputs: dict[str, str] | str, sql: str | None):
    """Register f(*inputs) under a name. The SQL sees the inputs as CTEs of their names, in order."""
    inputs = {"t": inputs} if isinstance(inputs, str) else inputs

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*[table(spark, sf_dir, s) if re.fullmatch(r"\w+", s) else view(spark, sf_dir, s) for s in inputs.values()])

        ctes = ", ".join(f"{k} AS ({duck('SELECT * FROM {' + s + '}' if re.fullmatch(r'[a-z]+', s) else s)})" for k, s in inputs.items())
        run.__doc__, run.__name__ = f.__doc__, name
        rest = (sql or "").strip()
        recursive = "RECURSIVE " if rest.startswith("WITH RECURSIVE ") else ""
        rest = ", " + rest[5 + len(recursive) :] if rest.startswith("WITH ") else " " + rest
        full = None if sql is None else f"WITH {recursive}{ctes}{rest}"
        ALL[name] = Query(run, full)
        return f

    return register


# --- retrieval ---------------------------------------------------------------------------------------------------

TOKENS_SQL = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"


def _bm25_sql(questions: str) -> str:
    """CTEs down to s(id, doc_id, score)."""
    return f"""
    n AS (SELECT doc_id, {TOKENS_SQL.format('text')} AS w FROM documents),
    q AS ({questions}),
    a AS (SELECT DISTINCT id, unnest(list_filter({TOKENS_SQL.format('question')}, lambda x: length(x) >= 2)) AS term FROM q),
    p AS (SELECT doc_id, len(w) AS size, unnest(w) AS term FROM n),
    f AS (SELECT doc_id, term, count(*) AS tf, min(size) AS size FROM p GROUP BY ALL),
    c AS (SELECT count(*) AS nn, avg(len(w)) AS avgdl FROM n),
    i AS (SELECT term, ln((nn - count(*) + 0.5e0) / (count(*) + 0.5e0)) AS idf FROM f, c GROUP BY term, nn),
    s AS (SELECT id, doc_id, round(-sum((CASE WHEN idf > 0 THEN idf ELSE 1e-6 END) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * size / avgdl))), 9) AS score
          FROM a JOIN f USING (term) JOIN i USING (term), c GROUP BY id, doc_id)"""


@query("bm25_topk", {"nodes": "documents", "questions": S.QUESTIONS}, f"WITH {_bm25_sql('SELECT * FROM questions')} SELECT * FROM (SELECT id, doc_id, score, CAST(row_number() OVER (PARTITION BY id ORDER BY score, doc_id) AS INT) AS rank FROM s) WHERE rank <= 10")
def _(nodes, questions):
    """BM25 top 10 per benchmark question."""
    return search.search(nodes.select("doc_id", "text"), ["doc_id"], ["text"], questions, "id", "question", 10).select("id", "doc_id", "score", "rank")


@query("bm25_corpus_stats", {"t": "documents"}, f"SELECT count(*) AS n_nodes, round(avg(len({TOKENS_SQL.format('text')})), 9) AS avg_size FROM t")
def _(t):
    return search.corpus_stats(t, ["text"]).select("n_nodes", F.round("avg_size", 9).alias("avg_size"))


@query("postings_df", {"t": "documents"}, f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS_SQL.format('text')}) AS term FROM t) GROUP BY ALL) GROUP BY term")
def _(t):
    return search.postings(t, ["doc_id"], ["text"]).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def _query_vector(embeddings: DataFrame) -> list[float]:
    return [float(x) for x in embeddings.where("vec_id = 0").first()["embedding"]]


COSINE_SQL = "SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 9) AS score FROM embeddings"


@query("cosine_topk", {"e": "embeddings"}, f"SELECT vec_id, score, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INT) AS rank FROM ({COSINE_SQL}) ORDER BY rank LIMIT 10")
def _(e):
    """Cosine top 10 of one vector (a stated query against all)."""
    return search.vector_search(e, ["vec_id"], "embedding", _query_vector(e), 10)


RRF_SQL = f"""WITH {_bm25_sql('SELECT item_id AS id, text AS question FROM benchmark')},
    x AS (SELECT id, doc_id AS k, score, row_number() OVER (PARTITION BY id ORDER BY score, doc_id) AS rank, 0 AS l FROM s QUALIFY rank <= 50),
    v AS (SELECT a.vec_id AS id, b.vec_id AS k, round(list_cosine_similarity(CAST(b.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])), 9) AS score FROM embeddings a JOIN q ON q.id = a.vec_id, embeddings b),
    y AS (SELECT id, k, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, k) AS rank, 1 AS l FROM v QUALIFY rank <= 50),
    z AS (SELECT id, k AS doc_id, round(sum(1e0 / (60 + rank)), 6) AS rrf, min_by(score, l * 1000 + rank) AS score, min(l * 1000 + rank) AS o, list_sort(list(DISTINCT l)) AS m FROM (SELECT * FROM x UNION ALL SELECT * FROM y) GROUP BY id, k),
    r AS (SELECT id, doc_id, rrf, m, score, CAST(row_number() OVER (PARTITION BY id ORDER BY rrf DESC, o) AS INT) AS position FROM z)"""


def _two_lists(docs, e, questions) -> tuple[DataFrame, DataFrame]:
    """Both rankings of every question; the vector of the question's number stands in for its own."""
    lexical = search.search(docs.select("doc_id", "text"), ["doc_id"], ["text"], questions, "id", "question", 50)
    own = e.join(questions.select("id"), F.col("vec_id") == F.col("id")).select("id", "embedding")
    near = search.vector_search_all(e.withColumnRenamed("vec_id", "doc_id"), ["doc_id"], "embedding", own, "id", "embedding", 50)
    return lexical, near


@query("rrf_fuse", {"d": "documents", "e": "embeddings", "q": S.QUESTIONS}, None)
def _(d, e, q):
    out = search.rrf(list(_two_lists(d, e, q)), ["doc_id"], by=["id"])
    return out.select("id", "doc_id", "rrf", F.array_join(F.col("match_sources").cast("array<string>"), ",").alias("sources"), "score", "position")


ALL["rrf_fuse"].sql = RRF_SQL + " SELECT id, doc_id, rrf, array_to_string(m, ',') AS sources, score, position FROM r"


@query("hybrid_max_per_doc", {"d": "documents", "e": "embeddings", "q": S.QUESTIONS}, None)
def _(d, e, q):
    """Hybrid candidates, two per source at most, the first eight of every question."""
    rows, _ = search.hybrid(*_two_lists(d, e, q), ["doc_id"], by=["id"])
    rows = rows.join(d.select("doc_id", "source"), "doc_id")
    rows = search.diversify(rows, 2, "source", by=["id"])
    return search.top(rows, [F.col("position")], 8, ["id"]).select("id", "doc_id", "source", "position")


ALL["hybrid_max_per_doc"].sql = RRF_SQL + """, g AS (SELECT r.id, r.doc_id, source, position, row_number() OVER (PARTITION BY r.id, source ORDER BY position) AS n FROM r JOIN documents d ON d.doc_id = r.doc_id)
    SELECT id, doc_id, source, position FROM g WHERE n <= 2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY position) <= 8"""


@query("evidence_budget", {"d": "documents", "asked": S.QUESTIONS}, f"""WITH {_bm25_sql('SELECT * FROM asked')},
    r AS (SELECT id, doc_id, row_number() OVER (PARTITION BY id ORDER BY score, doc_id) AS position FROM s QUALIFY position <= 8),
    b AS (SELECT r.id, r.doc_id, position, substring(text, 1, 2000) AS block FROM r JOIN documents d ON d.doc_id = r.doc_id),
    u AS (SELECT id, doc_id, CAST(position AS INT) AS position, length(block) AS n, sum(length(block)) OVER (PARTITION BY id ORDER BY position) AS used FROM b)
    SELECT id, doc_id, position, n, CAST(used AS BIGINT) AS used FROM u WHERE used <= 6000 OR position = 1""")
def _(d, q):
    ranked = search.search(d.select("doc_id", "text"), ["doc_id"], ["text"], q, "id", "question", 8).withColumnRenamed("rank", "position")
    rows = search.evidence(ranked.join(d.select("doc_id", "text"), "doc_id"), "text", 2000, 6000, by=["id"])
    return rows.select("id", "doc_id", "position", F.length("block").cast("long").alias("n"), "used")


@query("evidence_text", {"t": S.NODES}, "SELECT doc_id, md5(string_agg(concat('[', node_id, ']', chr(10), text), chr(10) || chr(10) ORDER BY node_seq)) AS digest FROM t WHERE text <> '' GROUP BY doc_id")
def _(t):
    rows = t.where("text <> ''").withColumn("block", F.col("text"))
    out = search.evidence_text(rows, ["doc_id"], F.format_string("[%s]", "node_id"), "node_seq")
    return out.select("doc_id", F.md5("evidence").alias("digest"))


@query("doc_score", {"d": "documents", "asked": S.QUESTIONS}, f"""WITH {_bm25_sql('SELECT * FROM asked')}
    SELECT id, source AS doc_id, round(sum(score) / sqrt(count(*) + 1), 9) AS doc_score, count(*) AS n_chunks FROM s JOIN documents USING (doc_id) GROUP BY id, source""")
def _(d, q):
    scored = search.bm25(d.select("doc_id", "text"), ["doc_id"], ["text"], q, "id", "question").withColumn("score", F.round("score", 9))
    rows = scored.join(d.select("doc_id", "source"), "doc_id").select("id", F.col("source").alias("doc_id"), "score")
    return search.doc_scores(rows, by=["id"])


@query("rerank", {"d": "documents", "q": S.QUESTIONS}, None)
def _(d, q):
    """The first ten of every question by BM25, reordered by the stand-in scorer."""
    ranked = search.search(d.select("doc_id", "text"), ["doc_id"], ["text"], q, "id", "question", 10).withColumnRenamed("rank", "position")
    rows = ranked.join(d.select("doc_id", "text"), "doc_id").join(q, "id")
    return search.rerank(rows, F.col("question"), F.col("text"), search.overlap_scorer, by=["id"]).select("id", "doc_id", "rerank", "position")


STOP_SQL = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"
OVERLAP_SQL = "list_filter(list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+')), lambda x: NOT list_contains(" + STOP_SQL + ", x))"
ALL["rerank"].sql = f"""WITH {_bm25_sql('SELECT item_id AS id, text AS question FROM benchmark')},
    r AS (SELECT id, doc_id, row_number() OVER (PARTITION BY id ORDER BY score, doc_id) AS position FROM s QUALIFY position <= 10),
    o AS (SELECT r.id, r.doc_id, position, {OVERLAP_SQL.format('question')} AS qw, regexp_extract_all(lower(substring(text, 1, 2000)), '[a-z0-9]+') AS pw FROM r JOIN documents d ON d.doc_id = r.doc_id JOIN q ON q.id = r.id),
    v AS (SELECT id, doc_id, position, CASE WHEN len(qw) = 0 THEN 0e0 ELSE round(len(list_filter(qw, lambda x: list_contains(pw, x))) / CAST(len(qw) AS DOUBLE), 6) END AS rerank FROM o)
    SELECT id, doc_id, rerank, CAST(row_number() OVER (PARTITION BY id ORDER BY rerank DESC, position) AS INT) AS position FROM v"""


@query("word_overlap", {"q": S.QUESTIONS, "d": "documents"}, f"""SELECT q.id, d.doc_id, round(len(list_filter({OVERLAP_SQL.format('question')}, lambda x: list_contains(regexp_extract_all(lower(d.text), '[a-z0-9]+'), x))) / CAST(greatest(len({OVERLAP_SQL.format('question')}), 1) AS DOUBLE), 6) AS overlap FROM q JOIN d ON q.id = d.doc_id""")
def _(q, d):
    return q.join(d, F.col("id") == F.col("doc_id")).select("id", "doc_id", F.round(T.word_overlap("question", "text"), 6).alias("overlap"))


@query("overlap_stats", {"q": S.QUESTIONS, "d": "documents"}, f"""WITH o AS (SELECT round(len(list_filter({OVERLAP_SQL.format('question')}, lambda x: list_contains(regexp_extract_all(lower(d.text), '[a-z0-9]+'), x))) / CAST(greatest(len({OVERLAP_SQL.format('question')}), 1) AS DOUBLE), 6) AS v FROM q JOIN d ON q.id = d.doc_id)
    SELECT min(v) AS least, round(avg(v), 6) AS mean, max(v) AS most FROM o""")
def _(q, d):
    v = F.round(T.word_overlap("question", "text"), 6).alias("v")
    return q.join(d, F.col("id") == F.col("doc_id")).select(v).agg(F.min("v").alias("least"), F.round(F.avg("v"), 6).alias("mean"), F.max("v").alias("most"))


# --- evaluation --------------------------------------------------------------------------------------------------


def _gold(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """Questions with the documents that hold them verbatim, found by a seed of their first three words."""
    seed = lambda w, i: F.xxhash64(*[F.get(w, i + o) for o in range(3)])
    words = docs.select(F.col("doc_id").alias("node"), F.col("text").alias("body"), F.split("text", r"\s+").alias("w"))
    # Positions are generated rather than transformed, so each text is split once.
    at = words.select("node", "body", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - 3, F.lit(0)))).alias("i"))
    keys = at.select("node", "body", seed("w", F.col("i")).alias("h"))
    b = bench.select(F.col("item_id").alias("id"), F.col("text").alias("question"), seed(F.split("text", r"\s+"), F.lit(0)).alias("h"))
    rows = keys.join(F.broadcast(b), "h").where(F.contains(F.col("body"), F.col("question"))).select("id", "question", "node").distinct()
    one = F.struct(F.col("node").cast("string").alias("doc_id"), F.lit(None).cast("string").alias("node_id"))
    return rows.groupBy("id", "question").agg(F.array_sort(F.collect_list(one)).alias("relevant")).cache()


@query("mrr_recall", {"d": "documents", "b": "benchmark"}, f"""WITH {_bm25_sql('SELECT item_id AS id, text AS question FROM b')},
    g AS ({duck(S.GOLD)}),
    r AS (SELECT id, doc_id, row_number() OVER (PARTITION BY id ORDER BY score, doc_id) AS rank FROM s QUALIFY rank <= 50),
    m AS (SELECT g.id, r.rank FROM g LEFT JOIN r ON r.id = g.id AND r.doc_id = g.node),
    pq AS (SELECT id, coalesce(1e0 / min(rank), 0e0) AS rr, avg(CASE WHEN rank <= 1 THEN 1e0 ELSE 0e0 END) AS r1, avg(CASE WHEN rank <= 5 THEN 1e0 ELSE 0e0 END) AS r5,
          avg(CASE WHEN rank <= 10 THEN 1e0 ELSE 0e0 END) AS r10, avg(CASE WHEN rank <= 20 THEN 1e0 ELSE 0e0 END) AS r20 FROM m GROUP BY id)
    SELECT count(*) AS n, round(avg(rr), 6) AS mrr, round(avg(r1), 6) AS r1, round(avg(r5), 6) AS r5, round(avg(r10), 6) AS r10, round(avg(r20), 6) AS r20 FROM pq""")
def _(d, b):
    """BM25 quality over benchmark items that some document holds verbatim; items without gold drop out."""
    questions = _gold(d, b)
    nodes = d.select(F.col("doc_id").alias("k"), F.col("doc_id").cast("string").alias("doc_id"), F.lit("").alias("node_id"), "text")
    ranking = search.search(nodes, ["k"], ["text"], questions.select("id", "question"), "id", "question", 50)
    ranking = ranking.select("id", "rank", F.col("k").cast("string").alias("doc_id"), F.lit("").alias("node_id"))
    gold, _ = evaluate.resolve_gold(questions, nodes)
    per = evaluate.per_question(evaluate.doc_ranks(ranking, gold))
    means = [F.round(F.avg(c), 6).alias(n) for c, n in (("rr", "mrr"), ("r1", "r1"), ("r5", "r5"), ("r10", "r10"), ("r20", "r20"))]
    return per.agg(F.count("*").alias("n"), *means)


@query("recall_by_tag", {"d": "documents", "b": "benchmark"}, f"""WITH {_bm25_sql('SELECT item_id AS id, text AS question FROM b')},
    g AS ({duck(S.GOLD)}),
    r AS (SELECT id, doc_id, row_number() OVER (PARTITION BY id ORDER BY score, doc_id) AS rank FROM s QUALIFY rank <= 50),
    pq AS (SELECT g.id, coalesce(1e0 / min(rank), 0e0) AS rr, avg(CASE WHEN rank <= 5 THEN 1e0 ELSE 0e0 END) AS r5 FROM g LEFT JOIN r ON r.id = g.id AND r.doc_id = g.node GROUP BY g.id),
    t AS (SELECT DISTINCT g.id, lang AS tag FROM g JOIN documents d ON d.doc_id = g.node)
    SELECT tag, count(*) AS n, round(avg(rr), 6) AS mrr, round(avg(r5), 6) AS r5 FROM pq JOIN t USING (id) GROUP BY tag""")
def _(d, b):
    questions = _gold(d, b)
    tags = questions.select("id", F.explode("relevant.doc_id").alias("k")).join(d.select(F.col("doc_id").cast("string").alias("k"), "lang"), "k").groupBy("id").agg(F.collect_set("lang").alias("tags"))
    ranking = search.search(d.select("doc_id", "text"), ["doc_id"], ["text"], questions.select("id", "question"), "id", "question", 50)
    ranking = ranking.select("id", "rank", F.col("doc_id").cast("string").alias("doc_id"), F.lit("").alias("node_id"))
    gold = questions.select("id", F.explode("relevant").alias("r")).select("id", "r.doc_id", "r.node_id")
    per = evaluate.by_tag(evaluate.per_question(evaluate.doc_ranks(ranking, gold)), tags)
    return per.groupBy("tag").agg(F.count("*").alias("n"), F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("r5"), 6).alias("r5"))


@query("draw_question_nodes", {"t": S.NODES}, None)
def _(t):
    """Sampling operator: 30 nodes, at least one of every document (hash order has no SQL counterpart)."""
    return evaluate.draw_nodes(t).select("doc_id", "node_id", F.length("text").alias("text_len"))


# --- look-ups and windows ----------------------------------------------------------------------------------------


@query("list_documents_full", {"t": S.DOCS}, "SELECT doc_id, doc_name, doc_type, CASE WHEN doc_type = 'pdf' THEN size END AS page_count, CASE WHEN doc_type <> 'pdf' THEN size END AS line_count, doc_description FROM t")
def _(t):
    return navigate.list_documents(t)


@query("list_documents_brief", {"t": S.DOCS}, "SELECT doc_id, doc_name, doc_type, CASE WHEN doc_type = 'pdf' THEN size END AS page_count, CASE WHEN doc_type <> 'pdf' THEN size END AS line_count FROM t")
def _(t):
    return navigate.list_documents(t, "brief")


@query("get_document", {"t": S.DOCS}, "SELECT doc_id, doc_name, doc_type, size, 'completed' AS status FROM t WHERE doc_id = 'src3'")
def _(t):
    return navigate.get_document(t, "src3").select("doc_id", "doc_name", "doc_type", "size", "status")


@query("get_document_missing", {"t": S.DOCS}, "SELECT CAST(NULL AS STRING) AS doc_id, 'Document nowhere not found' AS error")
def _(t):
    return navigate.get_document(t, "nowhere").select("doc_id", "error")


@query("get_node", {"t": S.NODES}, "SELECT doc_id, node_id, title FROM t WHERE doc_id = 'src3' AND node_id = (SELECT min(node_id) FROM t WHERE doc_id = 'src3')")
def _(t):
    first = t.where("doc_id = 'src3'").agg(F.min("node_id")).first()[0]
    return navigate.get_node(t, "src3", first).select("doc_id", "node_id", "title")


@query("resolve_node_id", {"t": S.NODES, "r": "SELECT source AS doc_id, CASE doc_id % 4 WHEN 0 THEN CAST(doc_id AS STRING) WHEN 1 THEN concat(' ''', CAST(doc_id AS STRING), ''' ') WHEN 2 THEN lpad(CAST(doc_id AS STRING), 6, '0') ELSE 'nope' END AS asked FROM {documents}".replace("''''", "''''")}, "SELECT DISTINCT r.doc_id, r.asked, t.node_id FROM r LEFT JOIN t ON t.doc_id = r.doc_id AND t.node_id = lpad(trim(replace(trim(asked), chr(39), '')), 6, '0') AND asked <> 'nope'")
def _(t, r):
    return navigate.resolve_node_ids(r, t)


@query("suggest_node_ids", {"t": S.NODES}, "SELECT node_id, abs(CAST(node_id AS BIGINT) - 120) AS distance FROM t WHERE doc_id = 'src3' ORDER BY distance, node_id LIMIT 5")
def _(t):
    return navigate.suggest_node_ids(t, "src3", "120")


@query("suggest_first_ids", {"t": S.NODES}, "SELECT node_id FROM t WHERE doc_id = 'src3' ORDER BY node_seq LIMIT 5")
def _(t):
    return navigate.suggest_node_ids(t, "src3", "abc").select("node_id")


@query("content_window", {"t": S.NODES}, """WITH c AS (SELECT node_id, coalesce(nullif(text, ''), nullif(summary, ''), '') AS c, CASE WHEN text <> '' THEN 'text' WHEN coalesce(summary, '') <> '' THEN 'summary' ELSE 'none' END AS source FROM t),
    o AS (SELECT *, length(c) AS total_chars, least(100, length(c)) AS o FROM c)
    SELECT node_id, source, total_chars, o AS "offset", substring(c, CAST(o + 1 AS INT), 300) AS content, length(substring(c, CAST(o + 1 AS INT), 300)) AS returned_chars, o + length(substring(c, CAST(o + 1 AS INT), 300)) < total_chars AS has_more FROM o""")
def _(t):
    return navigate.content_window(t, 100, 300).select("node_id", "source", "total_chars", "offset", "content", "returned_chars", "has_more")


@query("node_length_filter", {"t": S.NODES}, "SELECT doc_id, node_id FROM t WHERE length(text) BETWEEN 800 AND 8000")
def _(t):
    return navigate.node_lengths(t, 800, 8000).select("doc_id", "node_id")


@query("doc_type_and_size", {"t": S.TOC}, "SELECT doc_id, CASE WHEN count(physical_index) > 0 THEN CASE WHEN max_by(CASE WHEN page % 2 = 0 THEN 'md' ELSE 'pdf' END, CASE WHEN page % 2 = 0 OR physical_index IS NOT NULL THEN -seq END) = 'md' THEN 'md' ELSE 'pdf' END ELSE CASE WHEN count(CASE WHEN page % 2 = 0 THEN 1 END) > 0 THEN 'md' ELSE 'pdf' END END AS doc_type FROM t GROUP BY doc_id")
def _(t):
    rows = t.select("doc_id", F.col("seq").alias("node_seq"), F.when(F.col("page") % 2 == 0, F.col("page")).alias("line_num"), F.col("physical_index").alias("start_index"), F.col("physical_index").alias("end_index"))
    return navigate.doc_type_and_size(rows).select("doc_id", "doc_type")


@query("metadata_search", {"t": S.DOCS}, "SELECT doc_id, size FROM t WHERE doc_type = 'pdf' AND size > 5000")
def _(t):
    return navigate.metadata_search(t, "doc_type = 'pdf' AND size > 5000", "treeline_documents").select("doc_id", "size")


@query("description_search", {"t": S.DOCS}, "SELECT doc_id, CASE WHEN doc_description = 'about de' THEN 1e0 ELSE 0e0 END AS score FROM t WHERE doc_description LIKE '%about de%' ORDER BY doc_id LIMIT 5")
def _(t):
    return navigate.description_search(t.withColumn("doc_description", F.substring("doc_description", 7, 5)), "which is de").select("doc_id", "score")


@query("tree_search", {"t": S.NODES}, f"WITH v AS (SELECT doc_id, node_seq, {OVERLAP_SQL.format(chr(39) + 'the fr of en' + chr(39))} AS qw, regexp_extract_all(lower(substring(concat_ws(' ', title, breadcrumb, summary), 1, 2000)), '[a-z0-9]+') AS pw FROM t) SELECT doc_id, node_seq, round(len(list_filter(qw, lambda x: list_contains(pw, x))) / CAST(len(qw) AS DOUBLE) + CASE WHEN doc_id = 'src1' THEN 0.5e0 ELSE 0e0 END, 6) AS score FROM v ORDER BY score DESC, doc_id, node_seq LIMIT 5")
def _(t):
    return navigate.tree_search(t, "the fr of en", preference=F.when(F.col("doc_id") == "src1", 0.5).otherwise(0.0)).select("doc_id", "node_seq", "score")


@query("store_stats", {"d": S.DOCS, "t": S.NODES, "e": "embeddings"}, "SELECT (SELECT count(*) FROM d) AS documents, (SELECT count(*) FROM t) AS nodes, (SELECT count(*) FROM e) AS embeddings, true AS has_embeddings, false AS is_empty")
def _(d, t, e):
    return navigate.store_stats(d, t, e)


@query("history_compaction", {"t": S.ITEMS}, """WITH n AS (SELECT o.*, c.name AS tool, row_number() OVER (PARTITION BY o.conv_id, (o.type = 'function_call_output' AND c.name = 'get_document_structure') ORDER BY o.seq DESC) AS k
    FROM t o LEFT JOIN (SELECT conv_id, call_id, name FROM t WHERE type = 'function_call') c ON c.conv_id = o.conv_id AND c.call_id = o.call_id),
    p AS (SELECT *, concat('[elided earlier get_document_structure output (', length(output), ' chars); re-call the tool if you need the tree again]') AS note FROM n)
    SELECT conv_id, seq, CASE WHEN type = 'function_call_output' AND tool = 'get_document_structure' AND k > 1 AND length(note) < length(output) THEN note ELSE output END AS output FROM p""")
def _(t):
    return navigate.elide_stale_outputs(t).select("conv_id", "seq", "output")


@query("last_tool_output", {"t": S.ITEMS}, "SELECT o.conv_id, c.name, max(o.seq) AS seq, max_by(o.output, o.seq) AS output FROM t o JOIN t c ON c.conv_id = o.conv_id AND c.call_id = o.call_id AND c.type = 'function_call' WHERE o.type = 'function_call_output' GROUP BY o.conv_id, c.name")
def _(t):
    calls = t.where("type = 'function_call'").select("conv_id", "call_id", "name")
    return refresh.last_outputs(t.where("type = 'function_call_output'").drop("name").join(calls, ["conv_id", "call_id"]))


# --- incremental index -------------------------------------------------------------------------------------------

DIFF_SQL = """SELECT coalesce(n.path, b.path) AS path, coalesce(n.doc_id, b.doc_id) AS doc_id, CASE WHEN n.path IS NULL THEN 'remove' WHEN b.mtime = n.mtime AND b.size = n.size THEN 'skip'
    WHEN NOT n.ok THEN CASE WHEN b.path IS NULL THEN 'reject' ELSE 'keep' END WHEN b.path IS NULL THEN 'add' ELSE 'update' END AS action FROM b FULL OUTER JOIN n ON b.path = n.path"""


@query("manifest_diff", {"b": S.BEFORE, "n": S.NOW}, DIFF_SQL)
def _(b, n):
    return index.manifest_diff(b, n)


@query("build_summary", {"b": S.BEFORE, "n": S.NOW}, f"SELECT count(*) FILTER (action = 'add') AS added, count(*) FILTER (action = 'update') AS updated, count(*) FILTER (action IN ('skip', 'keep', 'reject')) AS skipped, count(*) FILTER (action = 'remove') AS removed FROM ({DIFF_SQL})")
def _(b, n):
    return index.summary(index.manifest_diff(b, n))


@query("missing_embeddings", {"d": "documents", "e": "embeddings"}, "SELECT doc_id FROM d WHERE doc_id NOT IN (SELECT vec_id FROM e)")
def _(d, e):
    return index.missing_embeddings(d.select("doc_id"), e.select(F.col("vec_id").alias("doc_id")), ["doc_id"])


@query("upsert_rows", {"d": "documents", "p": "pages"}, "SELECT doc_id, n_chars FROM d WHERE doc_id NOT IN (SELECT page_id FROM p) UNION ALL SELECT page_id, length(html) FROM p")
def _(d, p):
    return index.upsert(d.select("doc_id", "n_chars"), p.select(F.col("page_id").alias("doc_id"), F.length("html").cast("long").alias("n_chars")), ["doc_id"])


@query("rows_for_ranked_keys", {"d": "documents", "e": "embeddings"}, f"SELECT r.rank, d.doc_id, d.source FROM (SELECT vec_id, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INT) AS rank FROM ({COSINE_SQL}) ORDER BY rank LIMIT 20) r JOIN d ON d.doc_id = r.vec_id")
def _(d, e):
    ranked = search.vector_search(e.withColumnRenamed("vec_id", "doc_id"), ["doc_id"], "embedding", _query_vector(e), 20)
    return index.rows_for_keys(d, ranked, ["doc_id"]).select("rank", "doc_id", "source")


# --- trees -------------------------------------------------------------------------------------------------------

PARENT_SQL = """p AS (SELECT c.doc_id, c.seq, c.level, c.title, c.text, max(a.seq) AS parent_seq FROM t c LEFT JOIN t a ON a.doc_id = c.doc_id AND a.seq < c.seq AND a.level < c.level
      AND a.level = 1 GROUP BY ALL)"""
NEAREST_SQL = """p AS (SELECT c.doc_id, c.seq, c.level, c.title, c.text, CASE WHEN c.level = 1 THEN NULL ELSE greatest(max(c1), CASE WHEN c.level = 3 THEN max(c2) END) END AS parent_seq FROM
      (SELECT *, max(CASE WHEN level = 1 THEN seq END) OVER w AS c1, max(CASE WHEN level = 2 THEN seq END) OVER w AS c2 FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) c GROUP BY c.doc_id, c.seq, c.level, c.title, c.text)"""
TREE_SQL = f"""{NEAREST_SQL}, g AS (SELECT a.doc_id, a.seq, a.title, a.text, a.parent_seq, b.parent_seq AS grand, b.title AS ptitle, c.title AS gtitle FROM p a LEFT JOIN p b ON b.doc_id = a.doc_id AND b.seq = a.parent_seq LEFT JOIN p c ON c.doc_id = b.doc_id AND c.seq = b.parent_seq),
    n AS (SELECT *, CAST(CASE WHEN parent_seq IS NULL THEN 0 WHEN grand IS NULL THEN 1 ELSE 2 END AS INT) AS depth, concat_ws(' > ', gtitle, ptitle) AS breadcrumb FROM g),
    k AS (SELECT doc_id, up, count(*) AS kids FROM (SELECT doc_id, parent_seq AS up FROM n WHERE parent_seq IS NOT NULL UNION ALL SELECT doc_id, grand FROM n WHERE grand IS NOT NULL) GROUP BY ALL),
    z AS (SELECT n.*, CAST(coalesce(kids, 0) AS INT) AS num_descendants FROM n LEFT JOIN k ON k.doc_id = n.doc_id AND k.up = n.seq)"""


@query("parents_from_levels", {"t": S.LEVELS}, f"WITH {NEAREST_SQL} SELECT doc_id, seq, parent_seq FROM p")
def _(t):
    return tree.parents_from_levels(t).select("doc_id", "seq", "parent_seq")


def _tree(t: DataFrame) -> DataFrame:
    return tree.subtree_ends(tree.numbered(tree.depths(tree.parents_from_levels(t), 4)))


@query("tree_flat", {"t": S.LEVELS}, f"WITH {TREE_SQL} SELECT doc_id, seq AS node_seq, lpad(CAST(seq AS STRING), 4, '0') AS node_id, depth, breadcrumb, num_descendants, CAST(seq + num_descendants + 1 AS INT) AS subtree_end FROM z")
def _(t):
    """Pre-order numbers, padded ids, depth, breadcrumb and subtree interval of every node."""
    return _tree(t).select("doc_id", "node_seq", "node_id", "depth", T.breadcrumb("ancestor_titles").alias("breadcrumb"), "num_descendants", "subtree_end")


@query("tree_leaves", {"t": S.LEVELS}, f"WITH {TREE_SQL} SELECT doc_id, count(*) AS leaves FROM z WHERE num_descendants = 0 GROUP BY doc_id")
def _(t):
    return tree.leaves(_tree(t)).groupBy("doc_id").agg(F.count("*").alias("leaves"))


@query("subtree", {"t": S.LEVELS}, f"WITH {TREE_SQL}, r AS (SELECT seq AS a, seq + num_descendants AS b FROM z WHERE doc_id = 0 AND seq = 0) SELECT seq AS node_seq, depth AS rel_depth, title FROM z, r WHERE doc_id = 0 AND seq BETWEEN a AND b")
def _(t):
    return tree.subtree(_tree(t), 0, "0000").select("node_seq", "rel_depth", "title")


@query("depth_prune", {"t": S.LEVELS}, f"WITH {TREE_SQL} SELECT seq AS node_seq, title, num_descendants > 0 AS has_children, CASE WHEN num_descendants > 0 THEN num_descendants END AS num_descendants FROM z WHERE doc_id = 1 AND depth < 1")
def _(t):
    rows = _tree(t).withColumn("summary", F.lit(""))
    return tree.pruned(tree.subtree(rows, 1), 1).select("node_seq", "title", "has_children", "num_descendants")


@query("structure_view", {"t": S.LEVELS}, f"WITH {TREE_SQL} SELECT seq AS node_seq, title FROM z WHERE doc_id = 1 AND depth < (SELECT CASE WHEN count(*) > 500 THEN 1 WHEN count(*) > 200 THEN 2 WHEN count(*) > 80 THEN 3 ELSE 64 END FROM z WHERE doc_id = 1)")
def _(t):
    """The navigation view with its default depth and budget."""
    rows, _ = tree.document_structure(_tree(t).withColumn("summary", F.lit("")), 1, budget=10**9)
    return rows.select("node_seq", "title")


@query("structure_budget", {"t": S.LEVELS}, None)
def _(t):
    """The navigation view cut to a budget (tests compare the rung that fits with a loop)."""
    rows, _ = tree.document_structure(_tree(t).withColumn("summary", F.col("text")), 1, budget=4000)
    return rows.select("node_seq", "title", "summary", "has_children", "num_descendants")


@query("subtree_tokens", {"t": S.LEVELS}, f"WITH {TREE_SQL}, x AS (SELECT doc_id, seq, text FROM z UNION ALL SELECT doc_id, parent_seq, text FROM z WHERE parent_seq IS NOT NULL UNION ALL SELECT doc_id, grand, text FROM z WHERE grand IS NOT NULL) SELECT doc_id, seq AS node_seq, CAST(floor((sum(length(text)) + count(*) - 1 + 3) / 4) AS BIGINT) AS subtree_tokens FROM x GROUP BY doc_id, seq")
def _(t):
    return tree.section_tokens(_tree(t)).select("doc_id", "node_seq", "subtree_tokens")


@query("tree_thinning", {"t": S.LEVELS}, f"""WITH {TREE_SQL}, x AS (SELECT doc_id, seq, text FROM z UNION ALL SELECT doc_id, parent_seq, text FROM z WHERE parent_seq IS NOT NULL UNION ALL SELECT doc_id, grand, text FROM z WHERE grand IS NOT NULL),
    s AS (SELECT doc_id, seq, floor((sum(length(text)) + count(*) + 2) / 4) AS tokens FROM x GROUP BY ALL),
    i AS (SELECT z.doc_id, z.seq, z.text, CASE WHEN g.tokens < 10 THEN z.grand WHEN p.tokens < 10 THEN z.parent_seq ELSE z.seq END AS up FROM z LEFT JOIN s p ON p.doc_id = z.doc_id AND p.seq = z.parent_seq LEFT JOIN s g ON g.doc_id = z.doc_id AND g.seq = z.grand)
    SELECT doc_id, up AS node_seq, md5(string_agg(text, chr(10) || chr(10) ORDER BY seq)) AS digest FROM i GROUP BY doc_id, up""")
def _(t):
    return tree.thinned(tree.section_tokens(_tree(t)), 10).select("doc_id", "node_seq", F.md5("text").alias("digest"))


@query("nest_flatten", {"t": S.LEVELS}, f"WITH {TREE_SQL} SELECT CAST(doc_id AS STRING) AS doc_id, seq AS node_seq, CAST(parent_seq AS INT) AS parent_seq, depth, title, breadcrumb, text FROM z")
def _(t):
    """Rows to nested JSON and back."""
    raw = tree.nest(_tree(t).withColumn("doc_id", F.col("doc_id").cast("string")), ("title", "node_id", "text")).withColumnRenamed("tree", "raw")
    return tree.flatten(raw).select("doc_id", "node_seq", "parent_seq", "depth", "title", "breadcrumb", "text")


@query("node_mapping", {"t": S.LEVELS}, "SELECT doc_id, count(*) AS n, min(title) AS first_title FROM t GROUP BY doc_id")
def _(t):
    m = tree.node_mapping(_tree(t))
    return m.select("doc_id", F.size("mapping").cast("long").alias("n"), F.array_min(F.map_values("mapping")).alias("first_title"))


@query("html_headings", {"t": "SELECT page_id AS doc_id, html FROM {pages}"}, "SELECT doc_id, CAST(1 AS INT) AS level, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) AS title FROM t WHERE regexp_matches(html, '(?is)<h1[^>]*>.*?</h1>')")
def _(t):
    return tree.html_headings(t).select("doc_id", "level", "title")


MARKDOWN = "SELECT doc_id, concat('intro', chr(10), '# ', source, chr(10), substring(text, 1, 200), chr(10), '```', chr(10), '# not a header', chr(10), '```', chr(10), '### ', lang, chr(10), substring(text, 201)) AS text FROM {documents}"


@query("markdown_sections", {"t": MARKDOWN}, """WITH l AS (SELECT doc_id, generate_subscripts(s, 1) AS line_num, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM t)),
    f AS (SELECT *, sum(CASE WHEN starts_with(trim(line), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_num) AS k FROM l),
    h AS (SELECT doc_id, line_num, length(regexp_extract(line, '^(#{1,6})', 1)) AS level, trim(regexp_extract(trim(line), '^#{1,6}\\s+(.+)$', 1)) AS title FROM f WHERE k % 2 = 0 AND NOT starts_with(trim(line), '```') AND regexp_matches(trim(line), '^#{1,6}\\s+.+$') AND starts_with(line, '#')),
    s AS (SELECT l.doc_id, max(h.line_num) AS hl, l.line_num, l.line FROM l JOIN h ON h.doc_id = l.doc_id AND h.line_num <= l.line_num GROUP BY l.doc_id, l.line_num, l.line),
    x AS (SELECT doc_id, hl, regexp_replace(string_agg(line, chr(10) ORDER BY line_num), '^[ \\n\\t\\r]+|[ \\n\\t\\r]+$', '', 'g') AS text FROM s GROUP BY doc_id, hl)
    SELECT h.doc_id, CAST(h.line_num AS INT) AS line_num, CAST(h.level AS INT) AS level, h.title, md5(x.text) AS digest FROM h JOIN x ON x.doc_id = h.doc_id AND x.hl = h.line_num""")
def _(t):
    out = tree.markdown_sections(tree.markdown_lines(t))
    return out.select("doc_id", F.col("line_num").cast("int").alias("line_num"), "level", "title", F.md5("text").alias("digest"))


@query("span_assignment", {"t": S.TOC}, """WITH f AS (SELECT * FROM t WHERE physical_index IS NOT NULL), w AS (SELECT doc_id, seq, physical_index, lead(physical_index) OVER o AS n, lead(appear_start) OVER o AS a, lead(1) OVER o AS more FROM f WINDOW o AS (PARTITION BY doc_id ORDER BY seq))
    SELECT doc_id, seq, physical_index AS start_index, CAST(greatest(CASE WHEN more IS NULL THEN 60 ELSE n - CASE WHEN a = 'yes' THEN 1 ELSE 0 END END, physical_index) AS INT) AS end_index FROM w""")
def _(t):
    rows = toc.without_index(t)
    ends = rows.select("doc_id").distinct().withColumn("end", F.lit(60))
    return tree.assign_spans(rows, ends).select("doc_id", "seq", "start_index", "end_index")


@query("preface", {"t": S.TOC}, "WITH f AS (SELECT doc_id, min_by(physical_index, seq) AS p FROM t WHERE physical_index IS NOT NULL GROUP BY doc_id) SELECT doc_id, CAST(seq AS INT) AS seq, title, physical_index FROM t WHERE physical_index IS NOT NULL UNION ALL SELECT doc_id, -1, 'Preface', 1 FROM f WHERE p > 1")
def _(t):
    return tree.with_preface(toc.without_index(t)).select("doc_id", "seq", "title", "physical_index")


@query("span_texts", {"p": S.PAGES}, "WITH n AS (SELECT doc_id, CAST(page_no AS INT) AS seq, page_no AS a, page_no + 1 AS b FROM p WHERE page_no % 2 = 1) SELECT n.doc_id, n.seq, md5(string_agg(concat('<physical_index_', page_no, '>', chr(10), page_text, chr(10), '<physical_index_', page_no, '>', chr(10), chr(10)), '' ORDER BY page_no)) AS digest FROM n JOIN p ON p.doc_id = n.doc_id AND page_no BETWEEN a AND b GROUP BY ALL")
def _(p):
    nodes = p.where("page_no % 2 = 1").select("doc_id", F.col("page_no").alias("seq"), F.col("page_no").alias("start_index"), (F.col("page_no") + 1).alias("end_index"))
    return tree.span_texts(nodes, p, labelled=True).select("doc_id", "seq", F.md5("text").alias("digest"))


@query("span_tokens", {"p": S.PAGES}, "WITH n AS (SELECT doc_id, page_no AS a, count(*) OVER (PARTITION BY doc_id) AS b FROM p) SELECT n.doc_id, n.a AS start_index, CAST(sum(n_tokens) AS BIGINT) AS span_tokens FROM n JOIN p ON p.doc_id = n.doc_id AND page_no BETWEEN a AND b GROUP BY n.doc_id, n.a")
def _(p):
    from pyspark.sql import Window

    nodes = p.select("doc_id", F.col("page_no").alias("start_index"), F.count("*").over(Window.partitionBy("doc_id")).cast("int").alias("end_index"))
    return tree.span_tokens(nodes, p).select("doc_id", "start_index", "span_tokens")


@query("large_nodes", {"p": S.PAGES}, "SELECT doc_id, CAST(count(*) AS INT) AS end_index, CAST(sum(n_tokens) AS BIGINT) AS span_tokens FROM p GROUP BY doc_id HAVING count(*) - 1 > 5 AND sum(n_tokens) >= 300")
def _(p):
    nodes = p.groupBy("doc_id").agg(F.count("*").cast("int").alias("end_index")).withColumn("start_index", F.lit(1))
    return tree.large_nodes(nodes, p, 5, 300).select("doc_id", "end_index", "span_tokens")


CODES = "SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INT) AS seq, CASE WHEN l_linenumber = 1 THEN '1' WHEN l_linenumber % 3 = 0 THEN concat('1.2.', CAST(l_linenumber AS STRING)) WHEN l_linenumber % 2 = 0 THEN concat('1.', CAST(l_linenumber AS STRING)) ELSE concat(CAST(l_linenumber AS STRING), '.1') END AS structure, min(l_returnflag) AS title, CAST(1 AS INT) AS start_index, CAST(2 AS INT) AS end_index FROM {lineitem} GROUP BY l_orderkey, l_linenumber"


@query("codes_to_tree", {"t": CODES}, None)
def _(t):
    """Dotted codes to trees, gaps filled (a fold; tests compare it with a loop)."""
    return tree.codes_to_tree(t)


@query("section_prefix_parent", {"t": CODES}, "SELECT c.doc_id, c.seq, max_by(p.seq, length(p.structure) * 1000 + p.seq) AS parent_seq FROM t c JOIN t p ON p.doc_id = c.doc_id AND p.seq < c.seq AND starts_with(c.structure, p.structure || '.') GROUP BY c.doc_id, c.seq")
def _(t):
    """The latest earlier item with the nearest existing prefix."""
    ups = t.select("doc_id", "seq", F.posexplode(T.code_prefixes("structure")).alias("up", "structure"))
    hits = ups.join(t.select("doc_id", "structure", F.col("seq").alias("p")), ["doc_id", "structure"]).where("p < seq")
    best = F.max(F.struct((-F.col("up")).alias("near"), "p"))["p"]
    return hits.groupBy("doc_id", "seq").agg(best.alias("parent_seq"))


# --- tables of contents ------------------------------------------------------------------------------------------


@query("asof_neighbours", {"t": S.TOC}, "SELECT doc_id, seq, coalesce(last(physical_index ORDER BY seq IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS x FROM t".replace("last(physical_index ORDER BY seq IGNORE NULLS)", "last_value(physical_index IGNORE NULLS)"))
def _(t):
    return toc.filled_neighbours(t).select("doc_id", "seq", F.col("prev_index").alias("x"))


@query("feasible_items", {"t": S.TOC}, """WITH w AS (SELECT *, coalesce(last_value(physical_index IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS p,
    coalesce(first_value(physical_index IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 2147483647) AS n FROM t) SELECT doc_id, seq FROM w WHERE physical_index IS NULL AND 20 >= p AND 10 <= n""")
def _(t):
    return toc.feasible(t, 10, 20).select("doc_id", "seq")


@query("neighbours_of_correct", {"t": S.TOC}, """WITH w AS (SELECT *, coalesce(last_value(CASE WHEN appear_start = 'yes' THEN physical_index END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev_index,
    coalesce(first_value(CASE WHEN appear_start = 'yes' THEN physical_index END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 60) AS next_index FROM t) SELECT doc_id, seq, prev_index, next_index FROM w WHERE appear_start = 'no'""")
def _(t):
    rows = toc.filled_neighbours(t, 0, 60, F.col("appear_start") == "yes")
    return rows.where("appear_start = 'no'").select("doc_id", "seq", "prev_index", "next_index")


@query("candidate_pages", {"t": S.TOC, "p": S.PAGES}, """WITH w AS (SELECT *, coalesce(last_value(physical_index IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS a,
    coalesce(first_value(physical_index IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 2147483647) AS b FROM t) SELECT w.doc_id, w.seq, p.page_no FROM w JOIN p ON p.doc_id = w.doc_id AND p.page_no BETWEEN a AND b WHERE w.physical_index IS NULL""")
def _(t, p):
    rows = toc.filled_neighbours(t).where("physical_index is null").select("doc_id", "seq", "prev_index", "next_index")
    return toc.candidate_pages(rows, p).select("doc_id", "seq", "page_no")


@query("page_offset_mode", {"t": S.TOC}, "WITH c AS (SELECT doc_id, physical_index - page AS o, count(*) AS n, min(seq) AS f FROM t WHERE physical_index IS NOT NULL GROUP BY ALL) SELECT doc_id, CAST(max_by(o, n * 1000 - f) AS INT) AS page_offset FROM c GROUP BY doc_id")
def _(t):
    return toc.page_offset(t)


@query("add_page_offset", {"t": S.TOC}, "WITH c AS (SELECT doc_id, physical_index - page AS o, count(*) AS n, min(seq) AS f FROM t WHERE physical_index IS NOT NULL GROUP BY ALL), x AS (SELECT doc_id, max_by(o, n * 1000 - f) AS o FROM c GROUP BY doc_id) SELECT t.doc_id, seq, CAST(page + o AS INT) AS physical_index FROM t LEFT JOIN x ON x.doc_id = t.doc_id")
def _(t):
    return toc.add_offset(t, toc.page_offset(t)).select("doc_id", "seq", "physical_index")


@query("guess_page_offset", {"t": S.TOC}, "SELECT doc_id, CAST(CASE WHEN 22 - min_by(page, seq) >= 0 THEN 22 - min_by(page, seq) END AS INT) AS page_offset FROM t GROUP BY doc_id")
def _(t):
    return toc.guessed_offset(t, t.select("doc_id").distinct().withColumn("last_toc_page", F.lit(20)))


@query("matching_pairs", {"t": S.TOC}, "SELECT a.doc_id, a.seq, b.seq AS found_seq, a.page, b.physical_index FROM t a JOIN t b ON b.doc_id = a.doc_id AND b.title = a.title WHERE b.physical_index >= 5")
def _(t):
    return toc.matching_pairs(t, t, 5).select("doc_id", "seq", "found_seq", "page", "physical_index")


@query("truncate_indices", {"t": S.TOC}, "SELECT doc_id, seq, CASE WHEN physical_index <= 30 THEN physical_index END AS physical_index FROM t")
def _(t):
    return toc.truncate_indices(t, t.select("doc_id").distinct().withColumn("n_pages", F.lit(30))).select("doc_id", "seq", "physical_index")


@query("dedupe_keep_last", {"t": S.TOC}, "SELECT doc_id, max(seq) AS seq, lower(trim(title)) AS title FROM t GROUP BY doc_id, lower(trim(title))")
def _(t):
    rows = t.withColumn("structure", F.lit(None).cast("string"))
    return toc.keep_last(rows).select("doc_id", "seq", F.lower(F.trim("title")).alias("title"))


@query("merge_keep_first", {"t": S.TOC}, """WITH a AS (SELECT * FROM t WHERE seq <= 2), b AS (SELECT * FROM t WHERE seq > 2), n AS (SELECT doc_id, title, min(seq) AS seq FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.doc_id = b.doc_id AND a.title = b.title) GROUP BY doc_id, title),
    m AS (SELECT doc_id, title, 0 AS k, seq FROM a UNION ALL SELECT doc_id, title, 1, seq FROM n) SELECT doc_id, title, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k, seq) - 1 AS INT) AS seq FROM m""")
def _(t):
    rows = t.select("doc_id", "seq", F.lit(None).cast("string").alias("structure"), "title", F.lit(None).cast("int").alias("physical_index"), F.lit(None).cast("int").alias("page"))
    return toc.merge(rows.where("seq <= 2"), rows.where("seq > 2")).select("doc_id", "title", "seq")


@query("collapse_continuations", {"t": S.TOC}, None)
def _(t):
    """A fold over each document (tests compare it with a loop)."""
    return toc.collapse(t).select("doc_id", "seq", "title", "physical_index")


@query("midpoint_sample", {"t": S.TOC}, "WITH n AS (SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS nth, count(*) OVER (PARTITION BY doc_id) AS total FROM t), p AS (SELECT DISTINCT doc_id, least(total - 1, CAST(floor(i * (total / 3e0) + (total / 3e0) / 2) AS BIGINT)) AS nth FROM n, range(3) r(i)) SELECT n.doc_id, n.seq FROM n JOIN p ON p.doc_id = n.doc_id AND p.nth = n.nth")
def _(t):
    return toc.midpoint_sample(t, 3).select("doc_id", "seq")


@query("even_sample", {"t": S.TOC}, "WITH n AS (SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS nth, count(*) OVER (PARTITION BY doc_id) AS total FROM t), p AS (SELECT DISTINCT doc_id, CASE WHEN total <= 4 THEN i ELSE CAST(floor(i * total / 4e0) AS BIGINT) END AS nth FROM n, range(4) r(i) WHERE i < total) SELECT n.doc_id, n.seq FROM n JOIN p ON p.doc_id = n.doc_id AND p.nth = n.nth")
def _(t):
    return toc.even_sample(t, 4).select("doc_id", "seq")


@query("offset_score", {"p": S.PAGES}, None)
def _(p):
    items = p.select("doc_id", F.col("page_no").alias("seq"), F.substring("page_text", 1, 30).alias("title"), (F.col("page_no") - 1).alias("page"))
    return toc.offset_score(items, p, 1)


ALL["offset_score"].sql = f"""WITH p AS ({duck(S.PAGES)}), i AS (SELECT doc_id, page_no AS seq, regexp_replace(lower(substring(page_text, 1, 30)), '[^a-z0-9]+', '', 'g') AS t, page_no - 1 AS page FROM p WHERE page_no > 1),
    n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS nth, count(*) OVER (PARTITION BY doc_id) AS total FROM i),
    k AS (SELECT DISTINCT doc_id, CASE WHEN total <= 10 THEN i ELSE CAST(floor(i * total / 10e0) AS BIGINT) END AS nth FROM n, range(10) r(i) WHERE i < total),
    v AS (SELECT n.doc_id, n.t, regexp_replace(lower(substring(p.page_text, 1, 1500)), '[^a-z0-9]+', '', 'g') AS b FROM n JOIN k ON k.doc_id = n.doc_id AND k.nth = n.nth JOIN p ON p.doc_id = n.doc_id AND p.page_no = n.page + 1),
    x AS (SELECT doc_id, CASE WHEN t = '' OR b = '' OR instr(b, t) = 0 THEN NULL WHEN instr(b, t) - 1 <= 160 THEN 'yes' ELSE 'no' END AS verdict FROM v)
    SELECT doc_id, CASE WHEN count(verdict) > 0 THEN round(count(*) FILTER (verdict = 'yes') / CAST(count(verdict) AS DOUBLE), 6) ELSE 0e0 END AS score, count(verdict) AS scored FROM x GROUP BY doc_id"""


@query("verify_accuracy", {"p": S.PAGES}, None)
def _(p):
    items = p.select("doc_id", F.col("page_no").alias("seq"), F.substring("page_text", 1, 20).alias("title"), F.col("page_no").alias("physical_index"))
    return toc.verify(items, p)[0]


ALL["verify_accuracy"].sql = f"""WITH p AS ({duck(S.PAGES)}), v AS (SELECT doc_id, regexp_replace(lower(substring(page_text, 1, 20)), '[^a-z0-9]+', '', 'g') AS t, regexp_replace(lower(substring(page_text, 1, 1500)), '[^a-z0-9]+', '', 'g') AS b FROM p)
    SELECT doc_id, round(avg(CASE WHEN t <> '' AND instr(b, t) > 0 AND instr(b, t) - 1 <= 160 THEN 1e0 ELSE 0e0 END), 6) AS accuracy, count(*) AS checked FROM v GROUP BY doc_id"""


@query("toc_page_runs", {"p": S.PAGES}, """WITH f AS (SELECT doc_id, page_no, length(page_text) % 3 <> 0 AS toc FROM p), b AS (SELECT *, min(CASE WHEN toc THEN page_no END) OVER (PARTITION BY doc_id) AS first FROM f),
    g AS (SELECT *, max(CASE WHEN toc THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY page_no) AS broken FROM b WHERE page_no >= first AND first <= 20) SELECT doc_id, page_no FROM g WHERE broken = 0""")
def _(p):
    return toc.toc_pages(p, F.length("page_text") % 3 != 0)


@query("fill_back", {"t": S.TOC}, "WITH b AS (SELECT doc_id, title, max_by(physical_index, seq) AS p FROM t WHERE physical_index IS NOT NULL GROUP BY doc_id, title) SELECT t.doc_id, t.seq, coalesce(t.physical_index, b.p) AS physical_index FROM t LEFT JOIN b ON b.doc_id = t.doc_id AND b.title = t.title")
def _(t):
    rows = t.withColumn("structure", F.lit(None).cast("string"))
    return toc.fill(rows.where("physical_index is not null"), rows).select("doc_id", "seq", "physical_index")


CONTENTS = """SELECT conv_id AS doc_id, concat('Contents', chr(10), '1 Overview ..... ', CAST(count(*) AS STRING), chr(10), 'Preface vii', chr(10), '1.1 V ariables : 1 2', chr(10), 'Exercises 33', chr(10), 'Appendix A Tables 90References 95', chr(10), '2 Data 1', CAST(max(turn) AS STRING)) AS text FROM {conversations} GROUP BY conv_id"""


@query("parse_toc", {"t": CONTENTS}, """WITH n AS (SELECT conv_id AS doc_id, count(*) AS n, max(turn) AS m FROM conversations GROUP BY conv_id)
    SELECT doc_id, 0 AS seq, '1' AS structure, 'Overview' AS title, CAST(n AS INT) AS page FROM n UNION ALL SELECT doc_id, 1, '0.1', 'Preface', NULL FROM n UNION ALL SELECT doc_id, 2, '1.1', 'Variables', 12 FROM n
    UNION ALL SELECT doc_id, 3, '1.exercises', 'Exercises', 33 FROM n UNION ALL SELECT doc_id, 4, 'A', 'Appendix A Tables', 90 FROM n UNION ALL SELECT doc_id, 5, 'references', 'References', 95 FROM n UNION ALL SELECT doc_id, 6, '2', 'Data', CAST('1' || CAST(m AS STRING) AS INT) FROM n""")
def _(t):
    return toc.parse(t)


# --- sequence folds ----------------------------------------------------------------------------------------------


@query("page_groups", {"p": S.PAGES}, None)
def _(p):
    """Groups of pages with one page of overlap (a fold; tests compare it with a loop)."""
    return pages.page_groups(p, 500, 1)


@query("greedy_groups", {"p": S.PAGES}, """WITH RECURSIVE n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) - 1 AS i, n_tokens AS k, sum(n_tokens) OVER (PARTITION BY doc_id) AS total FROM p),
    f AS (SELECT doc_id, i, k AS held, CAST(0 AS BIGINT) AS g, total FROM n WHERE i = 0 UNION ALL SELECT n.doc_id, n.i, CASE WHEN f.total > 500 AND f.held + n.k > 500 THEN n.k ELSE f.held + n.k END, CASE WHEN f.total > 500 AND f.held + n.k > 500 THEN f.g + 1 ELSE f.g END, f.total FROM f JOIN n ON n.doc_id = f.doc_id AND n.i = f.i + 1)
    SELECT doc_id, CAST(g AS INT) AS "group", CAST(min(i) AS INT) AS first, CAST(max(i) AS INT) AS last FROM f GROUP BY doc_id, g""")
def _(p):
    return pages.greedy_groups(p, "page_no", "n_tokens", 500)


@query("fixed_chunks", {"t": S.TOC}, "SELECT doc_id, seq, CAST(floor((row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1) / 3) AS INT) AS chunk FROM t")
def _(t):
    return pages.fixed_chunks(t, 3).select("doc_id", "seq", "chunk")


@query("split_texts", {"d": "documents"}, "SELECT doc_id, md5(text) AS digest FROM d")
def _(d):
    """Texts split for a budget and joined again."""
    parts = pages.split_texts(d.select("doc_id", "text"), 600)
    return parts.groupBy("doc_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "")).alias("digest"))


@query("text_pages", {"d": "documents"}, "SELECT doc_id, count(*) AS n_pages, CAST(sum(length(t)) AS BIGINT) AS chars FROM (SELECT doc_id, substring(text, CAST(i * 3000 + 1 AS INT), 3000) AS t FROM (SELECT doc_id, text, unnest(range(CAST(greatest(ceil(length(text) / 3000.0), 1) AS BIGINT))) AS i FROM d)) GROUP BY doc_id")
def _(d):
    rows = readers.text_pages(d.select("doc_id", "text"))
    return readers.number_of_pages(rows).join(rows.groupBy("doc_id").agg(F.sum(F.length("page_text")).alias("chars")), "doc_id")


# --- scalar functions --------------------------------------------------------------------------------------------

LINES = "SELECT doc_id, source, lang, text FROM {documents}"


@query("scalar_text", {"t": LINES}, """SELECT doc_id, CAST(floor((length(text) + 3) / 4) AS BIGINT) AS tokens, CASE WHEN length(text) <= 50 THEN text ELSE concat(rtrim(substring(text, 1, 50)), '...') END AS cut,
    regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS title_key, length(text) - length(replace(text, chr(10), '')) + 1 AS lines, CASE WHEN length(text) > 500 THEN 1 WHEN length(text) > 200 THEN 2 WHEN length(text) > 80 THEN 3 END AS auto_depth,
    lpad(CAST(doc_id AS STRING), CAST(greatest(4, length(CAST(doc_id AS STRING))) AS INT), '0') AS node_id, concat_ws(' > ', source, lang) AS crumb FROM t""")
def _(t):
    return t.select(
        "doc_id", T.estimated_tokens("text").alias("tokens"), T.truncated("text", 50).alias("cut"), T.title_key("text").alias("title_key"), T.line_count("text").alias("lines"),
        T.auto_depth(F.length("text")).alias("auto_depth"), T.node_id("doc_id").alias("node_id"), T.breadcrumb(F.array("source", F.lit(""), "lang")).alias("crumb"),
    )


@query("match_query", {"q": S.QUESTIONS}, """WITH a AS (SELECT id, regexp_extract_all(lower(question), '[\\p{L}\\p{N}_]+') AS w FROM q), u AS (SELECT id, w[i] AS x, i FROM a, range(1, 200) r(i) WHERE i <= len(w) AND length(w[i]) >= 2),
    d AS (SELECT id, x, min(i) AS i FROM u GROUP BY id, x), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS n FROM d)
    SELECT q.id, string_agg('"' || x || '"', ' OR ' ORDER BY k.i) FILTER (n <= 64) AS match FROM q LEFT JOIN k ON k.id = q.id GROUP BY q.id""")
def _(q):
    return q.select("id", T.match_query("question").alias("match"))


@query("scalar_codes", {"t": CODES}, "SELECT doc_id, seq, CASE WHEN contains(structure, '.') THEN regexp_replace(structure, '\\.[^.]+$', '') END AS parent, CASE WHEN contains(structure, '.') THEN string_split(structure, '.')[1] END AS top FROM t")
def _(t):
    ups = T.code_prefixes("structure")
    top = F.when(F.col("structure").contains("."), F.element_at(ups, -1))
    return t.select("doc_id", "seq", T.parent_code("structure").alias("parent"), top.alias("top"))


@query("scalar_tags", {"t": S.TOC}, "SELECT doc_id, seq, physical_index AS tagged, physical_index AS plain, least(physical_index, page) AS low, greatest(physical_index, page) AS high FROM t WHERE physical_index IS NOT NULL")
def _(t):
    rows = t.where("physical_index is not null")
    both = F.format_string("<physical_index_%d> text <physical_index_%d>", "physical_index", "page")
    low, high = T.tag_range(both)
    return rows.select("doc_id", "seq", T.physical_index(F.format_string("<physical_index_%d>", "physical_index")).alias("tagged"), T.physical_index(F.col("physical_index").cast("string")).alias("plain"), low.alias("low"), high.alias("high"))


@query("title_at_start", {"p": S.PAGES}, "WITH v AS (SELECT doc_id, page_no, regexp_replace(lower(substring(page_text, 200, 30)), '[^a-z0-9]+', '', 'g') AS t, regexp_replace(lower(substring(page_text, 1, 1500)), '[^a-z0-9]+', '', 'g') AS b FROM p) SELECT doc_id, page_no, CASE WHEN t = '' OR b = '' OR instr(b, t) = 0 THEN NULL WHEN instr(b, t) - 1 <= 160 THEN 'yes' ELSE 'no' END AS verdict FROM v")
def _(p):
    return p.select("doc_id", "page_no", T.title_at_start(F.substring("page_text", 200, 30), "page_text").alias("verdict"))


@query("provider_routing", {"t": "SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN '' WHEN 1 THEN 'ollama/x' WHEN 2 THEN 'vllm/x' WHEN 3 THEN 'openai/x' WHEN 4 THEN 'some/x' ELSE 'gpt' END AS model FROM {part}"}, "SELECT p_partkey, CASE WHEN model IN ('', 'gpt', 'openai/x') THEN 'openai' WHEN model = 'ollama/x' THEN 'ollama' WHEN model = 'vllm/x' THEN 'vllm' ELSE 'litellm' END AS provider FROM t")
def _(t):
    return t.select("p_partkey", T.provider("model").alias("provider"))


@query("embed_text", {"t": S.NODES}, "SELECT node_id, md5(concat_ws(chr(10), nullif(trim(title), ''), nullif(trim(breadcrumb), ''), nullif(trim(summary), ''), nullif(trim(substring(text, 1, 100)), ''))) AS digest FROM t")
def _(t):
    return t.select("node_id", F.md5(T.embed_text("title", "breadcrumb", "summary", "text", 100)).alias("digest"))


@query("continued_titles", {"t": "SELECT p_partkey, concat(p_name, CASE p_size % 4 WHEN 0 THEN ' (Continued)' WHEN 1 THEN ' - Part 2' WHEN 2 THEN ' (cont) (cont)' ELSE '' END) AS title, p_name FROM {part}"}, "SELECT p_partkey, p_name AS title, lower(p_name) AS match FROM t")
def _(t):
    return t.select("p_partkey", T.without_continuation("title").alias("title"), T.matching_title("title").alias("match"))


@query("extract_json", {"t": "SELECT o_orderkey, concat('<think>x [1]</think> sure: ```json ', chr(10), chr(123), '\"k\": ', CAST(o_orderkey AS STRING), ', \"v\": None,', chr(125), chr(10), '``` bye') AS answer FROM {orders}"}, "SELECT o_orderkey, CAST(o_orderkey AS STRING) AS k FROM t")
def _(t):
    return t.select("o_orderkey", F.get_json_object(answers.extract_json("answer"), "$.k").alias("k"))


# --- journeys and extensions -------------------------------------------------------------------------------------


@query("markdown_trees", {"t": MARKDOWN}, None)
def _(t):
    """Markdown to flat trees, thin sections merged, with stand-in summaries."""
    out = build.markdown_trees(t, thin_tokens=10, with_summaries=True)
    return out.select("doc_id", "node_seq", "node_id", "depth", "title", F.length("summary").alias("summary_chars"))


def books(customers: DataFrame) -> DataFrame:
    """Ten books, by the nation's key modulo 10: a cover, a page of contents, a page per customer. Five customers are a chapter; every tenth
    stands in the contents with the page after its own."""
    from pyspark.sql import Window

    book = F.pmod("c_nationkey", F.lit(10))
    k = F.row_number().over(Window.partitionBy(book).orderBy("c_custkey")) - 1
    rows = customers.select(book.alias("doc_id"), k.alias("k"), "c_name", "c_mktsegment")
    chapter, part = (F.floor(F.col("k") / 5) + 1).cast("string"), F.col("k") % 5
    code = F.when(part == 0, chapter).otherwise(F.concat_ws(".", chapter, part.cast("string")))
    rows = rows.withColumn("line", F.concat(code, F.lit(" "), "c_name", F.lit(" ........ "), (F.col("k") + 1 + (F.col("k") % 10 == 9).cast("int")).cast("string")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"])
    contents = rows.groupBy("doc_id").agg(F.concat(F.lit("Contents\n"), F.array_join(lines, "\n")).alias("page_text"))
    body = rows.select("doc_id", (F.col("k") + 3).cast("int").alias("page_no"), F.concat("c_name", F.lit("\nof the segment "), "c_mktsegment").alias("page_text"))
    cover = contents.select("doc_id", F.lit(1).alias("page_no"), F.lit("A book about its customers").alias("page_text"))
    return cover.unionByName(contents.select("doc_id", F.lit(2).alias("page_no"), "page_text")).unionByName(body)


@query("page_trees", {"c": "customer"}, """WITH k AS (SELECT c_nationkey % 10 AS doc_id, c_name AS title, row_number() OVER (PARTITION BY c_nationkey % 10 ORDER BY c_custkey) - 1 AS k FROM c)
    SELECT doc_id, title, CAST(k + 3 AS INT) AS start_index, CAST(k + 3 AS INT) AS end_index, CASE WHEN k % 5 = 0 THEN 0 ELSE 1 END AS depth FROM k
    UNION ALL SELECT DISTINCT doc_id, 'Preface', 1, 2, 0 FROM k""")
def _(c):
    """Books in pages to section trees: contents found, parsed, aligned, verified, repaired."""
    return build.page_trees(settled(books(c))).select("doc_id", "title", "start_index", "end_index", "depth")


@query("answer_evidence", {"d": "documents", "asked": S.QUESTIONS}, f"""WITH {_bm25_sql('SELECT * FROM asked')},
    r AS (SELECT id, s.doc_id, source, text, CAST(row_number() OVER (PARTITION BY id ORDER BY score, source, s.doc_id) AS INT) AS position FROM s JOIN documents d ON d.doc_id = s.doc_id QUALIFY position <= 50),
    o AS (SELECT *, row_number() OVER (PARTITION BY id, source ORDER BY position) AS n FROM r QUALIFY n <= 1),
    k AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY id ORDER BY position) <= 8),
    u AS (SELECT id, doc_id, source, position, sum(length(substring(text, 1, 8000))) OVER (PARTITION BY id ORDER BY position) AS used, row_number() OVER (PARTITION BY id ORDER BY position) AS nth FROM k WHERE text <> '')
    SELECT id, doc_id, source, position, CAST(used AS BIGINT) AS used FROM u WHERE used <= 20000 OR nth = 1""")
def _(d, q):
    """The whole fast path for every question."""
    rows, _ = build.evidence_for(d.select("source", "doc_id", "text"), ["source", "doc_id"], ["text"], q, per_doc=1, total_cap=20_000)
    return rows.select("id", "doc_id", "source", "position", "used")


@query("summary_seam", {"t": S.NODES}, "SELECT node_id, CASE WHEN floor((length(text) + 3) / 4) < 200 THEN text ELSE substring(text, 1, 1500) END AS summary FROM t")
def _(t):
    return seam.summaries(t.withColumn("is_leaf", F.lit(True))).select("node_id", "summary")


@query("event_windows", {"e": "events"}, "SELECT time_bucket(INTERVAL '10 minutes', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM e GROUP BY ALL")
def _(e):
    """Extension: tumbling windows."""
    return refresh.event_counts(e)


@query("event_sessions", {"e": "events"}, """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def _(e):
    """Extension: session windows."""
    return refresh.sessions(e)
