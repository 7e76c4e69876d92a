"""Section trees as flat rows: doc_id, node_seq (pre-order from 0), parent_seq, depth, and what a node carries.

Subtrees are intervals of node_seq, so they need no recursion: a node's subtree ends before the next node that
is not deeper.
"""

from __future__ import annotations

import itertools
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.functions import text as T

LEVELS = 6


def _order():
    return Window.partitionBy("doc_id").orderBy("seq")


def _before():
    return _order().rowsBetween(Window.unboundedPreceding, -1)


def markdown_lines(files: DataFrame) -> DataFrame:
    """(doc_id, line_num, line) of whole texts (doc_id, text)."""
    return files.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("at", "line")).select("doc_id", (F.col("at") + 1).alias("line_num"), "line")


def in_fence(lines: DataFrame, order: str = "line_num") -> DataFrame:
    """lines with in_fence: between code fences, or a fence itself."""
    fence = F.trim("line").startswith("```").cast("int")
    w = Window.partitionBy("doc_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("__fence", fence).withColumn("in_fence", (F.sum("__fence").over(w) % 2 == 1) | (F.col("__fence") == 1)).drop("__fence")


def markdown_headers(lines: DataFrame) -> DataFrame:
    """(doc_id, seq, level, title, line_num) of headers outside fences; an indented header has no level and goes."""
    stripped = F.trim("line")
    rows = in_fence(lines).where(~F.col("in_fence")).withColumn("title", F.regexp_extract(stripped, r"^#{1,6}\s+(.+)$", 1))
    rows = rows.withColumn("level", F.length(F.regexp_extract("line", "^(#{1,6})", 1))).where("title <> '' and level > 0")
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_num")) - 1
    return rows.select("doc_id", nth.alias("seq"), "level", F.trim("title").alias("title"), "line_num")


def markdown_sections(lines: DataFrame) -> DataFrame:
    """Headers with the text from their line up to the next header's, trimmed. Sections are numbered by a running count
    over the lines, so lines and headers never join on ranges."""
    heads = markdown_headers(lines)
    rows = lines.join(heads, ["doc_id", "line_num"], "left")
    w = Window.partitionBy("doc_id").orderBy("line_num").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("section", F.last("seq", True).over(w)).where("section is not null")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_num", "line"))), lambda x: x["line"]), "\n")
    texts = rows.groupBy("doc_id", F.col("section").alias("seq")).agg(F.btrim(body, F.lit(" \n\t\r")).alias("text"))
    return heads.join(texts, ["doc_id", "seq"])


def html_headings(pages: DataFrame) -> DataFrame:
    """(doc_id, seq, level, title) of h1 to h6 in raw pages (doc_id, html)."""
    found = F.regexp_extract_all("html", F.lit(r"(?is)<(h[1-6])[^>]*>(.*?)</h[1-6]>"), F.lit(0))
    rows = pages.select("doc_id", F.posexplode(found).alias("seq", "tag"))
    title = F.trim(F.regexp_replace(F.regexp_replace("tag", "<[^>]*>", ""), r"\s+", " "))
    return rows.select("doc_id", "seq", F.regexp_extract("tag", "(?i)^<h([1-6])", 1).cast("int").alias("level"), title.alias("title"))


def parents_from_levels(rows: DataFrame, levels: int = LEVELS) -> DataFrame:
    """rows (doc_id, seq, level) with parent_seq: the nearest earlier row of a smaller level. One window
    column per level instead of a stack."""
    above = [F.max(F.when(F.col("level") == n, F.col("seq"))).over(_before()) for n in range(1, levels)]
    rows = rows.select("*", *[a.alias(f"__l{n}") for n, a in enumerate(above, 1)])
    nearest = F.lit(None).cast("int")
    for n in range(1, levels):
        nearest = F.when(F.col("level") > n, F.greatest(nearest, F.col(f"__l{n}"))).otherwise(nearest)
    return rows.withColumn("parent_seq", nearest).drop(*[f"__l{n}" for n in range(1, levels)])


def depths(rows: DataFrame, most: int = 64) -> DataFrame:
    """rows (doc_id, seq, parent_seq) with depth, path (ancestor seqs and itself) and titles (ancestors' titles).
    Parents are doubled up in rounds, so rounds follow the logarithm of the depth."""
    base = rows.select("doc_id", "seq", F.col("parent_seq").alias("up"), F.array("seq").alias("path"), F.array(F.coalesce("title", F.lit(""))).alias("names"))
    reach = 1
    while reach < most:
        over = base.select("doc_id", F.col("seq").alias("up"), F.col("up").alias("up2"), F.col("path").alias("path2"), F.col("names").alias("names2"))
        base = base.join(over, ["doc_id", "up"], "left").select(
            "doc_id", "seq", F.col("up2").alias("up"), F.concat(F.coalesce("path2", F.array().cast("array<int>")), "path").alias("path"), F.concat(F.coalesce("names2", F.array().cast("array<string>")), "names").alias("names")
        )
        reach *= 2
        if reach >= 8 and base.where("up is not null").isEmpty():
            break
    out = rows.join(base.select("doc_id", "seq", "path", "names"), ["doc_id", "seq"])
    titles = F.slice("names", F.lit(1), F.size("names") - 1)
    return out.select("*", (F.size("path") - 1).alias("depth"), titles.alias("ancestor_titles")).drop("names")


def numbered(rows: DataFrame) -> DataFrame:
    """Pre-order numbers from 0 and padded ids, from ordered paths."""
    seq = (F.row_number().over(Window.partitionBy("doc_id").orderBy("path")) - 1).cast("int")
    return rows.withColumn("node_seq", seq).withColumn("node_id", T.node_id("node_seq"))


def subtree_ends(nodes: DataFrame) -> DataFrame:
    """nodes (doc_id, seq, node_seq, path) with subtree_end (exclusive), num_descendants and is_leaf: every node counts for
    all on its path, linear in nodes times depth."""
    counts = nodes.select("doc_id", F.explode("path").alias("seq")).groupBy("doc_id", "seq").agg(F.count("*").alias("__size"))
    rows = nodes.join(counts, ["doc_id", "seq"])
    return rows.withColumn("subtree_end", (F.col("node_seq") + F.col("__size")).cast("int")).withColumn("num_descendants", (F.col("__size") - 1).cast("int")).withColumn("is_leaf", F.col("__size") == 1).drop("__size")


def leaves(nodes: DataFrame) -> DataFrame:
    return nodes.where("is_leaf")


def node_mapping(nodes: DataFrame) -> DataFrame:
    """(doc_id, mapping): node_id to title per document."""
    return nodes.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("node_id", "title")))).alias("mapping"))


def subtree(nodes: DataFrame, doc_id, from_node_id: str | int | None = None) -> DataFrame:
    """A document's nodes, or those under one node; None, '', 0 and '0' mean all. Adds rel_depth."""
    own = nodes.where(F.col("doc_id") == F.lit(doc_id))
    if from_node_id in (None, "", 0, "0"):
        return own.withColumn("rel_depth", F.col("depth"))
    root = own.where(F.col("node_id") == str(from_node_id)).select("doc_id", F.col("node_seq").alias("__a"), F.col("subtree_end").alias("__b"), F.col("depth").alias("__d"))
    rows = own.join(F.broadcast(root), "doc_id").where("node_seq >= __a and node_seq < __b")
    return rows.withColumn("rel_depth", F.col("depth") - F.col("__d")).drop("__a", "__b", "__d")


def pruned(view: DataFrame, max_depth: int | None, summary_chars: int = 160) -> DataFrame:
    """The upper max_depth levels; nodes cut off say how much is below them. Summaries are cut, or left out for 0."""
    rows = view if max_depth is None else view.where(F.col("rel_depth") < max_depth)
    cut = F.lit(False) if max_depth is None else (F.col("rel_depth") + 1 >= max_depth) & ~F.col("is_leaf")
    summary = T.truncated("summary", summary_chars)
    return rows.withColumn("has_children", cut).withColumn("num_descendants", F.when(cut, F.col("num_descendants"))).withColumn("summary", F.when(F.coalesce(summary, F.lit("")) != "", summary))


def fit_to_budget(view: DataFrame, budget: int, requested: int | None, summary_chars: int = 160) -> dict:
    """Which rung of the ladder fits: (max_depth, summary_chars, top_n). Every rung's size is summed in one pass.

    Rungs: the requested depth, 3, 2, 1, then no summaries, then half the top nodes again and again. A node's size
    is the length of its JSON object and a separator; brackets of its list of children count too.
    """
    node = lambda c: F.length(F.to_json(F.struct(*c))) + 2
    base = [F.col("title"), F.col("node_id")]
    fold = lambda d, s: (
        F.sum(F.when(F.lit(d is None) | (F.col("rel_depth") < (d or 0)), node([*base, T.truncated("summary", s).alias("summary")]) + F.lit(12)))
    )
    depths_ = list(dict.fromkeys([requested, 3, 2, 1]))
    rungs = [(d, summary_chars) for d in depths_] + ([(1, 0)] if summary_chars > 0 else [])
    sizes = view.agg(*[fold(d, s).alias(f"r{i}") for i, (d, s) in enumerate(rungs)]).first()
    for i, (d, s) in enumerate(rungs):
        if (sizes[i] or 0) <= budget or budget <= 0:
            return {"max_depth": d, "summary_chars": s, "top_n": None}
    tops = view.where("rel_depth = 0").select("node_seq", node(base).alias("size"))
    rows = tops.select(F.row_number().over(Window.orderBy("node_seq")).alias("n"), F.sum("size").over(Window.orderBy("node_seq")).alias("total"))
    n = max(1, tops.count())
    while n > 1:
        n //= 2
        if rows.where(F.col("n") == n).first()["total"] <= budget:
            break
    return {"max_depth": 1, "summary_chars": 0, "top_n": n}


def document_structure(nodes: DataFrame, doc_id, max_depth: int | None = None, from_node_id=None, budget: int = 120_000, summary_chars: int = 160) -> tuple[DataFrame, dict]:
    """The navigation view of a document and what was shown of it."""
    view = subtree(nodes, doc_id, from_node_id).cache()
    total = view.count()
    asked = max(1, int(max_depth)) if max_depth is not None else (1 if total > 500 else 2 if total > 200 else 3 if total > 80 else None)
    fit = fit_to_budget(view, budget, asked, summary_chars)
    shown = pruned(view, fit["max_depth"], fit["summary_chars"])
    if fit["top_n"]:
        shown = shown.where("rel_depth = 0").orderBy("node_seq").limit(fit["top_n"])
    return shown.orderBy("node_seq"), fit | {"total_nodes_in_scope": total, "scope": "full" if from_node_id in (None, "", 0, "0") else f"subtree({from_node_id})"}


def section_tokens(nodes: DataFrame) -> DataFrame:
    """nodes with subtree_tokens: tokens of their text and their descendants' texts, each descendant's on lines of its
    own. From paths: every node adds to all its ancestors."""
    size = F.length(F.coalesce("text", F.lit("")))
    parts = nodes.select("doc_id", F.explode("path").alias("seq"), size.alias("chars"))
    total = parts.groupBy("doc_id", "seq").agg((F.sum("chars") + F.count("*") - 1).alias("__chars"))
    return nodes.join(total, ["doc_id", "seq"]).withColumn("subtree_tokens", F.floor((F.col("__chars") + 3) / 4).cast("long")).drop("__chars")


def thinned(nodes: DataFrame, least: int) -> DataFrame:
    """Nodes of fewer subtree tokens than `least` absorb their descendants' texts; those go. nodes: path, text,
    subtree_tokens. Holds as a parent's subtree is never smaller than a child's."""
    small = nodes.where(F.col("subtree_tokens") < least).select("doc_id", F.col("seq").alias("up"))
    above = nodes.select("doc_id", "seq", F.explode("path").alias("up"))
    hits = above.join(small, ["doc_id", "up"]).groupBy("doc_id", "seq").agg(F.min("up").alias("into"))
    rows = nodes.join(hits, ["doc_id", "seq"], "left").withColumn("into", F.coalesce("into", "seq"))
    text = F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), lambda t: F.trim(t) != ""), "\n\n")
    merged = rows.groupBy("doc_id", F.col("into").alias("seq")).agg(text.alias("__text"))
    return nodes.join(merged, ["doc_id", "seq"]).withColumn("text", F.col("__text")).drop("__text")


CODE_TREE = "node_seq int, parent_seq int, depth int, structure string, title string, start_index int, end_index int, synthesized boolean"


def codes_to_tree(items: DataFrame) -> DataFrame:
    """Tree rows (doc_id and CODE_TREE) from dotted codes: items doc_id, seq, structure, title, start_index, end_index.

    A parent is the latest earlier item with the nearest existing prefix of the code; without any, the item is a
    root. Gaps below an existing ancestor are filled with 'Section <code>' rows that span their children. What exists
    depends on what was filled before, so it is a fold over each document's items. Documents stream through the
    workers in sorted runs, as a call per document costs more than most documents' folds.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    fields = ("doc_id", "seq", "structure", "title", "start_index", "end_index")
    kinds = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    schema = pa.schema([("doc_id", to_arrow_type(items.schema["doc_id"].dataType)), *[(n, kinds[k]) for n, k in (f.split() for f in CODE_TREE.split(", "))]])
    batch_rows = 10_000

    def fold(doc, found) -> list[tuple]:
        codes, titles, starts, ends, ups, made, below = [], [], [], [], [], [], []
        latest: dict[str, int] = {}

        def add(code, title, start, end, up, filled) -> int:
            at = len(codes)
            for column, value in zip((codes, titles, starts, ends, ups, made, below), (code, title, start, end, up, filled, None)):
                column.append(value)
            if up is not None:
                if below[up] is None:
                    below[up] = []
                below[up].append(at)
            if code is not None:
                latest[code] = at
            return at

        for _, _, code, title, start, end in found:
            up, gaps, head = None, [], code or ""
            while "." in head:
                head = head[: head.rindex(".")]
                if head in latest:
                    up = latest[head]
                    break
                gaps.append(head)
            if up is not None:
                for p in reversed(gaps):
                    up = add(p, f"Section {p}", start, end, up, True)
            add(code, title, start, end, up, False)
        for i in reversed(range(len(codes))):  # children come after their parents
            if made[i]:
                for column, pick in ((starts, min), (ends, max)):
                    known = [column[c] for c in below[i] if column[c] is not None]
                    column[i] = pick(known) if known else column[i]
        out, stack, number = [], [(i, 0) for i in reversed(range(len(codes))) if ups[i] is None], {}
        while stack:
            i, depth = stack.pop()
            number[i] = len(out)
            out.append((doc, number[i], number.get(ups[i]), depth, codes[i], titles[i], starts[i], ends[i], made[i]))
            if below[i]:
                stack += [(c, depth + 1) for c in reversed(below[i])]
        return out

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches):
        rows = (r for b in batches for r in zip(*[b.column(f).to_pylist() for f in fields]))
        out: list[tuple] = []
        for doc, found in itertools.groupby(rows, key=lambda r: r[0]):
            out += fold(doc, found)
            if len(out) >= batch_rows:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    pages = [F.col(c).cast("int").alias(c) for c in ("start_index", "end_index")]
    rows = items.select("doc_id", "seq", "structure", "title", *pages).repartition("doc_id").sortWithinPartitions("doc_id", F.asc_nulls_last("seq"))
    kind = items.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, {CODE_TREE}")


def assign_spans(items: DataFrame, ends: DataFrame) -> DataFrame:
    """start_index and end_index from physical_index: up to the next item's page, less one if that item starts its
    page; the last up to the document's end. items: doc_id, seq, physical_index, appear_start; ends: doc_id, end."""
    following = F.lead("physical_index").over(_order()) - F.when(F.lead("appear_start").over(_order()) == "yes", 1).otherwise(0)
    rows = items.withColumn("__last", F.lead(F.lit(1)).over(_order()).isNull()).withColumn("__next", following)
    rows = rows.join(ends, "doc_id", "left")
    end = F.when(F.col("__last"), F.col("end")).otherwise(F.col("__next"))
    rows = rows.withColumn("start_index", F.col("physical_index"))
    return rows.withColumn("end_index", F.greatest(end, F.col("physical_index")).cast("int")).drop("__last", "__next", "end")


def with_preface(items: DataFrame) -> DataFrame:
    """A Preface item before documents whose first item starts after page 1."""
    first = items.groupBy("doc_id").agg(F.min(F.struct("seq", "physical_index"))["physical_index"].alias("__p"))
    add = first.where("__p > 1").select("doc_id", F.lit(-1).alias("seq"), F.lit("0").alias("structure"), F.lit("Preface").alias("title"), F.lit(1).alias("physical_index"))
    return items.unionByName(add, allowMissingColumns=True)


def span_texts(nodes: DataFrame, pages: DataFrame, labelled: bool = False) -> DataFrame:
    """nodes with the text of pages start_index to end_index, in order; labelled wraps every page in its tag. Spans are
    spelled out page by page, so it is an equality join."""
    span = nodes.where("start_index is not null and end_index >= start_index").select("doc_id", "seq", F.explode(F.sequence("start_index", "end_index")).alias("page_no"))
    tag = F.format_string("<physical_index_%d>\n", F.col("page_no"))
    text = F.concat(tag, "page_text", F.lit("\n"), tag, F.lit("\n")) if labelled else F.col("page_text")
    parts = span.join(pages, ["doc_id", "page_no"]).select("doc_id", "seq", F.struct("page_no", text.alias("t")).alias("x"))
    joined = parts.groupBy("doc_id", "seq").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "").alias("text"))
    return nodes.drop("text").join(joined, ["doc_id", "seq"], "left")


def span_tokens(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """Tokens of the pages each node spans, from running sums at its two ends: no range join."""
    w = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, 0)
    sums = pages.select("doc_id", "page_no", F.sum("n_tokens").over(w).alias("__sum"))
    at = lambda c, name: sums.select("doc_id", F.col("page_no").alias(c), F.col("__sum").alias(name))
    rows = nodes.withColumn("__before", F.col("start_index") - 1).join(at("__before", "__a"), ["doc_id", "__before"], "left").join(at("end_index", "__b"), ["doc_id", "end_index"], "left")
    return rows.withColumn("span_tokens", F.coalesce(F.col("__b"), F.lit(0)) - F.coalesce(F.col("__a"), F.lit(0))).drop("__a", "__b", "__before")


def large_nodes(nodes: DataFrame, pages: DataFrame, max_pages: int = 10, max_tokens: int = 20_000) -> DataFrame:
    """Nodes to be split further: over max_pages pages and max_tokens tokens or more."""
    rows = span_tokens(nodes, pages)
    return rows.where((F.col("end_index") - F.col("start_index") > max_pages) & (F.col("span_tokens") >= max_tokens))


def expand_large(nodes: DataFrame, pages: DataFrame, split, rounds: int = 8, **limits) -> DataFrame:
    """Split large nodes until none is left: split(large nodes, pages) -> child rows with doc_id, parent_seq, title,
    start_index, end_index. A split node ends where its first child begins."""
    done = nodes.withColumn("generation", F.lit(0))
    for turn in range(1, rounds + 1):
        big = large_nodes(done.where(F.col("generation") == turn - 1), pages, **limits).drop("span_tokens")
        kids = split(big, pages)
        if kids.isEmpty():
            break
        # New nodes are numbered after the others of their document.
        top = done.groupBy("doc_id").agg(F.max("seq").alias("__top"))
        nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("parent_seq", "start_index"))
        kids = kids.join(top, "doc_id").withColumn("seq", (F.col("__top") + nth).cast("int")).drop("__top").withColumn("generation", F.lit(turn))
        first = kids.groupBy("doc_id", F.col("parent_seq").alias("seq")).agg(F.min("start_index").alias("__first"))
        done = done.join(first, ["doc_id", "seq"], "left").withColumn("end_index", F.coalesce("__first", "end_index")).drop("__first")
        done = done.unionByName(kids, allowMissingColumns=True)
    return done


NESTED_FIELDS = ("title", "node_id", "start_index", "end_index", "line_num", "summary", "prefix_summary", "text")


def nest(nodes: DataFrame, fields: tuple[str, ...] = NESTED_FIELDS) -> DataFrame:
    """(doc_id, tree): each document's rows as nested JSON in pre-order; empty fields and lists of children are left
    out. One document per group: a tree is one value."""
    have = [f for f in fields if f in nodes.columns]

    def fold(frame):
        import pandas as pd

        roots, stack = [], []
        for r in frame.sort_values("node_seq").to_dict("records"):
            item = {k: (int(r[k]) if isinstance(r[k], float) else r[k]) for k in have if r[k] is not None and r[k] == r[k]}
            while len(stack) > r["depth"]:
                stack.pop()
            (stack[-1].setdefault("nodes", []) if stack else roots).append(item)
            stack.append(item)
        return pd.DataFrame({"doc_id": [frame["doc_id"].iloc[0]], "tree": [json.dumps(roots, ensure_ascii=False)]})

    return nodes.select("doc_id", "node_seq", "depth", *have).groupBy("doc_id").applyInPandas(fold, f"doc_id {nodes.schema['doc_id'].dataType.simpleString()}, tree string")


FLAT_SCHEMA = (
    "doc_id string, node_seq int, node_id string, parent_seq int, parent_id string, depth int, title string, breadcrumb string, summary string, "
    "prefix_summary string, start_index int, end_index int, line_num int, text string"
)


def flatten(trees: DataFrame) -> DataFrame:
    """Rows of FLAT_SCHEMA from tree documents (doc_id, raw JSON). Pre-order, one pass; what isn't a tree gives no rows."""

    def walk(raw):
        try:
            data = json.loads(raw)
        except (TypeError, ValueError):
            return
        roots = data.get("structure") if isinstance(data, dict) else data
        if not isinstance(roots, list):
            return
        count = 0
        stack = [(n, None, None, ()) for n in reversed(roots)]
        number = lambda v: v if isinstance(v, int) and not isinstance(v, bool) else None
        while stack:
            node, parent_seq, parent_id, titles = stack.pop()
            if not isinstance(node, dict):
                continue
            seq, count = count, count + 1
            title = node.get("title") or ""
            yield (
                seq, node.get("node_id"), parent_seq, parent_id, len(titles), title, " > ".join(t for t in titles if t), node.get("summary") or "",
                node.get("prefix_summary"), number(node.get("start_index")), number(node.get("end_index")), number(node.get("line_num")), node.get("text") or "",
            )
            stack += [(c, seq, node.get("node_id"), (*titles, title)) for c in reversed(node.get("nodes") or [])]

    def run(batches):
        import pandas as pd

        names = [f.split()[0] for f in FLAT_SCHEMA.split(", ")]
        for b in batches:
            rows = [(doc, *r) for doc, raw in zip(b["doc_id"], b["raw"]) for r in walk(raw)]
            yield pd.DataFrame(rows, columns=names).astype({n: "Int32" for n in ("node_seq", "parent_seq", "depth", "start_index", "end_index", "line_num")})

    return trees.select("doc_id", "raw").mapInPandas(run, FLAT_SCHEMA)


def without(nodes: DataFrame, *fields: str) -> DataFrame:
    """Rows without some fields: on flat rows no recursion is needed."""
    return nodes.drop(*fields)


def ordered(nodes: DataFrame, first: list[str]) -> DataFrame:
    """Columns in a given order, others after."""
    return nodes.select(*[c for c in first if c in nodes.columns], *[c for c in nodes.columns if c not in first])


def description_view(nodes: DataFrame, depth: int | None, summary_chars: int) -> DataFrame:
    """What a document's description is drafted from: titles, and summaries cut with '…'."""
    rows = nodes if depth is None else nodes.where(F.col("depth") < depth)
    s = F.coalesce("summary", F.lit(""))
    cut = F.when(F.length(s) > summary_chars, F.concat(F.rtrim(F.substring(s, 1, summary_chars)), F.lit("…"))).otherwise(s)
    return rows.select("doc_id", "node_seq", "depth", "title", (cut if summary_chars > 0 else F.lit("")).alias("summary"))


#: Ever smaller views, as (depth, summary characters).
DESCRIPTION_LADDER = ((None, 400), (None, 160), (3, 160), (2, 120), (2, 0), (1, 0))


def description_rung(nodes: DataFrame, budget_tokens: int) -> DataFrame:
    """(doc_id, rung): the first rung whose titles and summaries fit the budget, the last if none does."""
    def size(depth: int | None, chars: int) -> Column:
        s = F.least(F.length(F.coalesce("summary", F.lit(""))), F.lit(chars))
        inside = F.lit(True) if depth is None else F.col("depth") < depth
        return F.floor((F.sum(F.when(inside, F.length("title") + s + 8).otherwise(0)) + 3) / 4)

    sizes = nodes.groupBy("doc_id").agg(*[size(d, c).alias(f"r{i}") for i, (d, c) in enumerate(DESCRIPTION_LADDER)])
    rung = F.lit(len(DESCRIPTION_LADDER) - 1)
    for i in reversed(range(len(DESCRIPTION_LADDER) - 1)):
        rung = F.when(F.col(f"r{i}") <= budget_tokens, i).otherwise(rung)
    return sizes.select("doc_id", rung.alias("rung"))
