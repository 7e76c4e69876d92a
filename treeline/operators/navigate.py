"""Keyed look-ups and windows over documents and nodes: what an agent's tools ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def list_documents(documents: DataFrame, mode: str = "full") -> DataFrame:
    """Documents by id; 'brief' leaves the description out. Pages for PDFs, lines for the rest."""
    pages = F.when(F.col("doc_type") == "pdf", F.col("size"))
    lines = F.when(F.col("doc_type") != "pdf", F.col("size"))
    columns = ["doc_id", "doc_name", "doc_type", pages.alias("page_count"), lines.alias("line_count")]
    return documents.select(*columns, *(["doc_description"] if mode == "full" else [])).orderBy("doc_id")


def get_document(documents: DataFrame, doc_id) -> DataFrame:
    """The document with status 'completed'; a row with an error if there is none."""
    hit = documents.where(F.col("doc_id") == F.lit(doc_id)).withColumn("status", F.lit("completed")).withColumn("error", F.lit(None).cast("string"))
    one = documents.sparkSession.range(1).select(F.lit(doc_id).alias("__asked"))
    out = one.join(hit, F.col("__asked") == F.col("doc_id"), "left").drop("__asked")
    return out.withColumn("error", F.when(F.col("status").isNull(), F.format_string("Document %s not found", F.lit(str(doc_id)))))


def get_node(nodes: DataFrame, doc_id, node_id: str) -> DataFrame:
    return nodes.where((F.col("doc_id") == F.lit(doc_id)) & (F.col("node_id") == node_id)).orderBy("node_seq").limit(1)


def resolve_node_ids(requests: DataFrame, nodes: DataFrame, request: str = "asked") -> DataFrame:
    """(doc_id, asked, node_id): tolerant look-up of ids per request (doc_id, asked). White space and one pair
    of quotes go; an exact id wins; digits are padded to the widths that exist, the shortest first."""
    t = F.regexp_replace(F.trim(F.col(request).cast("string")), r"""^(?:'(.*)'|"(.*)")$""", "$1$2")
    asked = requests.select("doc_id", request, F.trim(t).alias("__t")).distinct()
    ids = nodes.where("node_id is not null").select("doc_id", "node_id").distinct()
    widths = ids.select("doc_id", F.length("node_id").alias("__w")).distinct()
    exact = asked.select("doc_id", request, F.lit(0).alias("__w"), F.col("__t").alias("node_id"))
    digits = asked.where(F.col("__t").rlike("^[0-9]+$")).join(widths, "doc_id").where(F.length("__t") <= F.col("__w"))
    padded = digits.select("doc_id", request, "__w", F.lpad("__t", F.col("__w"), F.lit("0")).alias("node_id"))
    found = exact.unionByName(padded).join(ids, ["doc_id", "node_id"])
    best = found.groupBy("doc_id", request).agg(F.min(F.struct("__w", "node_id"))["node_id"].alias("node_id"))
    return requests.select("doc_id", request).distinct().join(best, ["doc_id", request], "left")


def suggest_node_ids(nodes: DataFrame, doc_id, target: str, limit: int = 5) -> DataFrame:
    """Ids near a number, nearest first, ties to the smaller id; the first ids in order for anything else."""
    own = nodes.where((F.col("doc_id") == F.lit(doc_id)) & F.col("node_id").isNotNull())
    if str(target).strip().isdigit():
        own = own.where(F.col("node_id").rlike("^[0-9]+$"))
        return own.select("node_id", F.abs(F.col("node_id").cast("long") - int(target)).alias("distance")).orderBy("distance", "node_id").limit(limit)
    return own.orderBy("node_seq").select("node_id", F.lit(None).cast("long").alias("distance")).limit(limit)


def content() -> tuple[Column, Column]:
    """(content, source) of a node: its text, else its summary, else nothing."""
    body, summary = F.nullif(F.col("text"), F.lit("")), F.nullif(F.col("summary"), F.lit(""))
    source = F.when(body.isNotNull(), "text").when(summary.isNotNull(), "summary").otherwise("none")
    return F.coalesce(body, summary, F.lit("")), source


def content_window(nodes: DataFrame, offset: int = 0, length: int = 8000, hard_cap: int = 32000) -> DataFrame:
    """A window of every node's content. The offset is kept within the content; a length of 0 or less means all,
    within the hard cap."""
    value, source = content()
    rows = nodes.withColumn("__content", value).withColumn("source", source).withColumn("total_chars", F.length("__content").cast("long"))
    begin = F.least(F.greatest(F.lit(offset), F.lit(0)), F.col("total_chars"))
    wanted = F.col("total_chars") if length <= 0 else F.lit(length)
    window = F.least(wanted, F.lit(hard_cap)).cast("int")
    rows = rows.withColumn("offset", begin.cast("long"))
    rows = rows.withColumn("content", F.substring(F.col("__content"), (F.col("offset") + 1).cast("int"), window))
    rows = rows.withColumn("returned_chars", F.length("content").cast("long"))
    return rows.withColumn("has_more", F.col("offset") + F.col("returned_chars") < F.col("total_chars")).drop("__content")


def doc_type_and_size(nodes: DataFrame) -> DataFrame:
    """(doc_id, doc_type, size): the type of the first node that carries a position, else pdf; the largest
    line or page, 0 without any."""
    kind = F.when(F.col("line_num").isNotNull(), "md").when(F.col("start_index").isNotNull() | F.col("end_index").isNotNull(), "pdf")
    rows = nodes.withColumn("__kind", kind)
    first = F.min(F.when(F.col("__kind").isNotNull(), F.struct("node_seq", "__kind")))["__kind"]
    sizes = rows.groupBy("doc_id").agg(F.coalesce(first, F.lit("pdf")).alias("doc_type"), F.coalesce(F.max("line_num"), F.lit(0)).alias("__l"), F.coalesce(F.max("end_index"), F.lit(0)).alias("__p"))
    return sizes.select("doc_id", "doc_type", F.when(F.col("doc_type") == "md", F.col("__l")).otherwise(F.col("__p")).alias("size"))


def metadata_search(documents: DataFrame, condition: str, view: str = "documents") -> DataFrame:
    """Documents that meet an SQL condition over their metadata."""
    documents.createOrReplaceTempView(view)
    return documents.sparkSession.sql(f"SELECT * FROM {view} WHERE {condition} ORDER BY doc_id")


def description_search(documents: DataFrame, question: str, chooser=None, k: int = 5) -> DataFrame:
    """Documents whose description speaks to a question; chooser(question, description) -> score column."""
    from treeline.operators.search import overlap_scorer

    score = (chooser or overlap_scorer)(question, F.coalesce(F.col("doc_description"), F.lit("")))
    return documents.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "doc_id").limit(k)


def tree_search(nodes: DataFrame, question: str, chooser=None, preference: Column | None = None, k: int = 5) -> DataFrame:
    """Nodes chosen from titles and summaries alone, with an expert's preference added to the score."""
    from treeline.operators.search import overlap_scorer

    shown = F.concat_ws(" ", "title", "breadcrumb", "summary")
    score = (chooser or overlap_scorer)(question, shown)
    rows = nodes.withColumn("score", F.round(score + (preference if preference is not None else F.lit(0.0)), 6))
    return rows.where("score > 0").orderBy(F.desc("score"), "doc_id", "node_seq").limit(k)


def node_lengths(nodes: DataFrame, least: int, most: int) -> DataFrame:
    """Nodes with an id and a text of a length in range."""
    return nodes.where(F.col("node_id").isNotNull() & F.length("text").between(least, most) & (F.col("text") != ""))


def store_stats(documents: DataFrame, nodes: DataFrame, embeddings: DataFrame) -> DataFrame:
    """One row of counts; has_embeddings and is_empty follow."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    rows = one(documents, "documents").join(F.broadcast(one(nodes, "nodes"))).join(F.broadcast(one(embeddings, "embeddings")))
    return rows.withColumn("has_embeddings", F.col("embeddings") > 0).withColumn("is_empty", F.col("documents") == 0)


def elide_stale_outputs(items: DataFrame, target: str = "get_document_structure") -> DataFrame:
    """Of a tool's outputs in a conversation only the last stays; earlier ones become a note where that is shorter.
    items: conv_id, seq, type, call_id, name, output."""
    calls = items.where("type = 'function_call' and call_id is not null and name is not null")
    last_name = F.max(F.struct("seq", "name"))["name"]
    names = calls.groupBy("conv_id", "call_id").agg(last_name.alias("__tool"))
    rows = items.join(names, ["conv_id", "call_id"], "left")
    hit = (F.col("type") == "function_call_output") & (F.col("__tool") == target)
    nth = F.row_number().over(Window.partitionBy("conv_id", hit).orderBy(F.desc("seq")))
    size = F.length("output")
    note = F.format_string(f"[elided earlier {target} output (%d chars); re-call the tool if you need the tree again]", size)
    old = hit & (nth > 1) & (F.length(note) < size)
    return rows.select("conv_id", "seq", "type", "call_id", "name", F.when(old, note).otherwise(F.col("output")).alias("output"), F.coalesce(old, F.lit(False)).alias("elided"))


