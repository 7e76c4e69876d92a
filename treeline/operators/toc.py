"""Tables of contents: parse, clean, align with pages, verify, repair. Items are rows (doc_id, seq, structure, title, page,
physical_index, ...); what loops do elsewhere are windows here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.functions import text as T

def _by():
    return Window.partitionBy("doc_id").orderBy("seq")


def _before():
    return _by().rowsBetween(Window.unboundedPreceding, -1)


def _after():
    """What follows a row, nearest last. Backwards, as frames that end at the last row cost the square of the rows."""
    return Window.partitionBy("doc_id").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)


FAR = 2**31 - 1


def parse(contents: DataFrame) -> DataFrame:
    """Items (doc_id, seq, structure, title, page) from contents text (doc_id, text), line by line."""
    lines = contents.select("doc_id", F.posexplode(F.split(T.toc_text("text"), r"\r\n|[\n\r\x0B\x0C\x85  ]")).alias("line_no", "raw"))
    lines = lines.withColumn("line", T.toc_line("raw")).where("line <> ''")
    lines = lines.where(~F.lower("line").startswith("contents") & ~F.col("line").rlike("(?i)^[ivxlcdm]+$"))
    part = lambda n: F.regexp_extract("line", "(?i)" + T.ENTRY, n)
    rows = lines.select("doc_id", "line_no", "line", part(1).alias("head"), T.toc_title(part(2)).alias("rest"), T.toc_page(part(3)).alias("page"))
    low = F.lower("head")
    number, front = F.col("head").rlike(r"^\d+(\.\d+)*$"), low.isin("preface", "mathematical notation")
    title = (
        F.when(number, F.coalesce(F.nullif(F.col("rest"), F.lit("")), F.col("head")))
        .when(low == "exercises", "Exercises")
        .when(low.isin("references", "index"), F.initcap("head"))
        .otherwise(T.toc_title(F.concat_ws(" ", "head", "rest")))
    )
    rows = rows.where("head <> ''").withColumn("title", title).where((F.col("title") != "") & ~F.lower("title").startswith("contents"))
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    chapter = F.last(F.when(number & ~F.col("head").contains("."), F.col("head")), True).over(w)
    nth_front = F.sum(F.when(front, 1).otherwise(0)).over(w)
    structure = (
        F.when(number, F.col("head"))
        .when(low.startswith("appendix"), F.element_at(F.split("head", r"\s+"), -1))
        .when(low == "exercises", F.concat(chapter, F.lit(".exercises")))
        .when(low.isin("references", "index"), low)
        .otherwise(F.concat(F.lit("0."), nth_front.cast("string")))
    )
    rows = rows.withColumn("structure", structure)
    seq = (F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")) - 1).cast("int")
    return rows.select("doc_id", seq.alias("seq"), "structure", "title", "page")


def parse_stats(contents: DataFrame, items: DataFrame, kept: DataFrame) -> DataFrame:
    """(doc_id, items, candidates, confidence): how much of what looks like an entry was parsed."""
    lines = contents.select("doc_id", F.explode(F.split(T.toc_text("text"), r"\r\n|[\n\r\x0B\x0C\x85  ]")).alias("raw"))
    line = T.toc_line("raw")
    looks = lines.where((line != "") & ~F.lower(line).startswith("contents") & ~line.rlike("(?i)^[ivxlcdm]+$") & line.rlike(r"(?i)(?:(?:\d\s*){1,5}|[ivxlcdm]+)$"))
    n = lambda df, c: df.groupBy("doc_id").agg(F.count("*").alias(c))
    rows = contents.select("doc_id").distinct().join(n(items, "parsed"), "doc_id", "left").join(n(kept, "items"), "doc_id", "left").join(n(looks, "candidates"), "doc_id", "left").na.fill(0)
    confidence = F.when(F.col("candidates") > 0, F.round(F.col("parsed") / F.col("candidates"), 3)).otherwise(F.lit(0.0))
    return rows.select("doc_id", "items", "candidates", confidence.alias("confidence"))


def accepted(stats: DataFrame, least_items: int = 8, least_confidence: float = 0.65) -> DataFrame:
    """Documents whose contents were parsed well enough to go on without a model."""
    return stats.where((F.col("items") >= least_items) & (F.col("confidence") >= least_confidence))


def keep_last(items: DataFrame) -> DataFrame:
    """Of items with one structure and title the last stays; items with neither all stay."""
    empty = (F.coalesce("structure", F.lit("")) == "") & (F.coalesce("title", F.lit("")) == "")
    key = [F.nullif(F.coalesce("structure", F.lit("")), F.lit("")), F.lower(F.trim("title")), F.when(empty, F.col("seq"))]
    nth = F.row_number().over(Window.partitionBy("doc_id", *key).orderBy(F.desc("seq")))
    return items.withColumn("__n", nth).where("__n = 1").drop("__n")


def merge(existing: DataFrame, new: DataFrame) -> DataFrame:
    """existing as it is, then new items not yet there by (structure, title, physical_index, page), first come."""
    key = ["structure", "title", "physical_index", "page"]
    rows = existing.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    same = Window.partitionBy("doc_id", *[F.coalesce(F.col(k).cast("string"), F.lit("None")) for k in key]).orderBy("__new", "seq")
    rows = rows.withColumn("__n", F.row_number().over(same)).where("__new = 0 or __n = 1")
    order = Window.partitionBy("doc_id").orderBy("__new", "seq")
    return rows.withColumn("seq", (F.row_number().over(order) - 1).cast("int")).drop("__n", "__new")


def collapse(items: DataFrame) -> DataFrame:
    """Drop echoes of a section across chunks: an item that shares its code or matching title with the last kept one, or
    with any kept one of its page. What is kept decides what follows, so it is a fold over each document."""
    rows = items.withColumn("title", T.without_continuation("title")).withColumn("__t", T.matching_title("title"))
    one = F.struct("seq", F.coalesce("structure", F.lit("")).alias("s"), F.col("__t").alias("t"), F.coalesce(F.col("physical_index").cast("string"), F.lit("")).alias("p"))
    kind = "array<struct<seq:int,s:string,t:string,p:string>>"

    def step(kept: Column, x: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        alike = lambda y: ((x["s"] != "") & (y["s"] == x["s"])) | ((x["t"] != "") & (y["t"] == x["t"]))
        echo = F.coalesce(alike(last), F.lit(False)) | ((x["p"] != "") & F.exists(kept, lambda y: alike(y) & (y["p"] == x["p"])))
        return F.when(echo, kept).otherwise(F.concat(kept, F.array(x)))

    kept = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).cast(kind).alias("all"))
    kept = kept.select("doc_id", F.explode(F.transform(F.aggregate("all", F.array().cast(kind), step), lambda x: x["seq"])).alias("seq"))
    return rows.drop("__t").join(kept, ["doc_id", "seq"])


def matching_pairs(items: DataFrame, found: DataFrame, start_page: int = 1) -> DataFrame:
    """(doc_id, seq, title, page, physical_index): contents items and found headings of one title, null titles too."""
    right = found.select(F.col("doc_id").alias("__d"), F.col("title").alias("__t"), "physical_index", F.col("seq").alias("found_seq"))
    rows = items.drop("physical_index").join(right, (F.col("doc_id") == F.col("__d")) & F.col("title").eqNullSafe(F.col("__t")))
    return rows.where(F.col("physical_index") >= start_page).select("doc_id", "seq", "found_seq", "title", "page", "physical_index")


def page_offset(pairs: DataFrame) -> DataFrame:
    """(doc_id, page_offset): the most frequent physical_index - page; of equals the one met first."""
    rows = pairs.where("page is not null and physical_index is not null").withColumn("page_offset", F.col("physical_index") - F.col("page"))
    counts = rows.groupBy("doc_id", "page_offset").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    return counts.groupBy("doc_id").agg(F.max(F.struct("n", (-F.col("first")).alias("f"), "page_offset"))["page_offset"].alias("page_offset"))


def add_offset(items: DataFrame, offsets: DataFrame) -> DataFrame:
    return items.drop("physical_index").join(offsets, "doc_id", "left").withColumn("physical_index", F.col("page") + F.col("page_offset")).drop("page_offset")


def guessed_offset(items: DataFrame, last_toc_page: DataFrame) -> DataFrame:
    """(doc_id, page_offset): the body starts two pages after the contents end; null where that is negative."""
    first = items.where(F.col("page").isNotNull() & ~F.coalesce(F.col("structure"), F.lit("")).startswith("0.")).groupBy("doc_id").agg(F.min(F.struct("seq", "page"))["page"].alias("p"))
    rows = last_toc_page.join(first, "doc_id", "left").withColumn("o", F.col("last_toc_page") + 2 - F.col("p"))
    return rows.select("doc_id", F.when(F.col("o") >= 0, F.col("o")).alias("page_offset"))


def filled_neighbours(items: DataFrame, before: int | Column = 1, after: int | Column = FAR, usable: Column | None = None) -> DataFrame:
    """items with prev_index and next_index: the nearest filled (and usable) physical_index on either side."""
    value = F.col("physical_index") if usable is None else F.when(usable, F.col("physical_index"))
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return items.withColumn("prev_index", F.coalesce(F.last(value, True).over(_before()), lit(before))).withColumn("next_index", F.coalesce(F.last(value, True).over(_after()), lit(after)))


def feasible(items: DataFrame, least: int | None, most: int | None) -> DataFrame:
    """Unfilled items that may start on pages least to most, judged by their filled neighbours."""
    rows = filled_neighbours(items).where("physical_index is null")
    if least is None or most is None:
        return rows
    return rows.where((F.lit(most) >= F.col("prev_index")) & (F.lit(least) <= F.col("next_index")))


def candidate_pages(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages prev_index to next_index of every row, by equality on page numbers."""
    last = pages.groupBy("doc_id").agg(F.max("page_no").alias("__last"), F.min("page_no").alias("__first"))
    span = rows.join(last, "doc_id").withColumn("__a", F.greatest("prev_index", "__first")).withColumn("__b", F.least("next_index", "__last")).where("__a <= __b")
    span = span.withColumn("page_no", F.explode(F.sequence(F.col("__a").cast("int"), F.col("__b").cast("int")))).drop("__a", "__b", "__first", "__last")
    return span.join(pages, ["doc_id", "page_no"])


def first_pages(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, seq, page_no): of every row the first page from prev_index to next_index with its title at the head, as
    T.title_at_start says.

    Rows and pages meet by equality alone, first on the longest beginning of a title whose length is a power of two,
    then on the whole title; the first page at or after prev_index is a running minimum. So work is linear in rows and in pages
    times places where a title may begin, however many rows search the same pages.
    """
    rows = rows.select("doc_id", "seq", "prev_index", "next_index", T.title_key("title").alias("__t")).where("__t <> ''")
    size = F.length("__t")
    seed = F.expr("cast(pow(2, length(bin(length(__t))) - 1) as int)")
    titles = rows.select("doc_id", "__t").distinct().withColumn("__k", seed)
    sizes = titles.groupBy("doc_id").agg(F.collect_set("__k").alias("__ks"))
    seeds = titles.groupBy("doc_id", "__k", F.expr("substring(__t, 1, __k)").alias("__seed")).agg(F.collect_set(size).alias("__sizes"))
    heads = pages.where("page_no is not null").select("doc_id", F.col("page_no").cast("long").alias("page_no"), T.page_key("page_text").alias("__p")).where("__p <> ''")

    def places(k: Column) -> Column:
        """Where a title of k letters or more may begin, with as much of the page as the longest of them takes."""
        last = F.least(F.lit(T.LATEST + 1), F.length("__p") - k + 1)
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.struct(k.alias("k"), F.substring(F.col("__p"), i, 2 * k - 1).alias("x")))

    fitting = F.filter("__ks", lambda k: k <= F.length("__p"))
    near = heads.join(sizes, "doc_id").select("doc_id", "page_no", F.explode(F.array_distinct(F.flatten(F.transform(fitting, places)))).alias("__at"))
    near = near.select("doc_id", "page_no", F.col("__at.k").alias("__k"), F.col("__at.x").alias("__x")).withColumn("__seed", F.expr("substring(__x, 1, __k)"))
    whole = F.transform(F.filter("__sizes", lambda n: n <= F.length("__x")), lambda n: F.substring(F.col("__x"), F.lit(1), n))
    found = near.join(seeds, ["doc_id", "__k", "__seed"]).select("doc_id", F.explode(whole).alias("__t"), F.col("page_no").alias("__from"), "page_no")
    searched = rows.select("doc_id", "__t", F.col("prev_index").cast("long").alias("__from"), "seq", "next_index")
    # Descending, a range up to the current row holds every page at or after it, its own included.
    onward = Window.partitionBy("doc_id", "__t").orderBy(F.desc("__from")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    met = searched.unionByName(found, allowMissingColumns=True).withColumn("page_no", F.min("page_no").over(onward))
    met = met.where("seq is not null and page_no <= coalesce(next_index, page_no)")
    return met.groupBy("doc_id", "seq").agg(F.min("page_no").cast(pages.schema["page_no"].dataType).alias("page_no"))


def without_index(items: DataFrame) -> DataFrame:
    return items.where("physical_index is not null")


def truncate_indices(items: DataFrame, page_counts: DataFrame, start_index: int = 1) -> DataFrame:
    """physical_index beyond the document's pages becomes null. page_counts: doc_id, n_pages."""
    rows = items.join(page_counts, "doc_id", "left")
    most = F.col("n_pages") + start_index - 1
    return rows.withColumn("physical_index", F.when(F.col("physical_index") <= most, F.col("physical_index"))).drop("n_pages")


def midpoint_sample(items: DataFrame, n: int) -> DataFrame:
    """n items spread over each document, one from the middle of each stretch."""
    total = items.groupBy("doc_id").agg(F.count("*").alias("total"))
    step = F.col("total") / F.lit(n)
    at = F.least(F.col("total") - 1, F.floor(F.col("i") * step + step / 2))
    picks = total.select("doc_id", "total", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).select("doc_id", at.cast("int").alias("nth")).distinct()
    rows = items.withColumn("nth", (F.row_number().over(_by()) - 1).cast("int"))
    return rows.join(picks, ["doc_id", "nth"]).drop("nth")


def even_sample(items: DataFrame, n: int = 10) -> DataFrame:
    """All items of short documents, else n of them at even distances from the first."""
    total = items.groupBy("doc_id").agg(F.count("*").alias("total"))
    i = F.explode(F.sequence(F.lit(0), F.least(F.col("total"), F.lit(n)).cast("int") - 1))
    picks = total.select("doc_id", "total", i.alias("i")).select("doc_id", F.when(F.col("total") <= n, F.col("i")).otherwise(F.floor(F.col("i") * F.col("total") / F.lit(n))).cast("int").alias("nth")).distinct()
    rows = items.withColumn("nth", (F.row_number().over(_by()) - 1).cast("int"))
    return rows.join(picks, ["doc_id", "nth"]).drop("nth")


def title_verdicts(items: DataFrame, pages: DataFrame, at: str = "physical_index") -> DataFrame:
    """items with verdict: does the title stand at the head of its page (yes, no), or nowhere near (null)?"""
    p = pages.select("doc_id", F.col("page_no").alias(at), "page_text")
    return items.join(p, ["doc_id", at], "left").withColumn("verdict", T.title_at_start("title", "page_text")).drop("page_text")


def offset_score(items: DataFrame, pages: DataFrame, offset: int, n: int = 10) -> DataFrame:
    """(doc_id, score, scored): share of sampled titles at the head of their page under an offset."""
    rows = even_sample(items.where("page > 0"), n).withColumn("physical_index", F.col("page") + offset)
    rows = title_verdicts(rows, pages).groupBy("doc_id").agg(F.count_if(F.col("verdict") == "yes").alias("yes"), F.count("verdict").alias("scored"))
    return rows.select("doc_id", F.when(F.col("scored") > 0, F.round(F.col("yes") / F.col("scored"), 6)).otherwise(F.lit(0.0)).alias("score"), "scored")


def verify(items: DataFrame, pages: DataFrame, sample: int | None = None, answers: Column | None = None, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """((doc_id, accuracy, checked), incorrect items). Documents whose last index is missing or in the first half score
    0 unseen. More than 200 items are checked by 40 of them unless told otherwise: by a sample, or every one."""
    last = items.groupBy("doc_id").agg(F.max(F.when(F.col("physical_index").isNotNull(), F.struct("seq", "physical_index")))["physical_index"].alias("last"), F.count("*").alias("n"))
    counts = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"))
    seen = last.join(counts, "doc_id", "left").withColumn("skip", F.col("last").isNull() | (F.col("last") < F.col("n_pages") / 2))
    rows = items.where("physical_index is not null").join(seen.where("not skip").select("doc_id", F.col("n").alias("__n")), "doc_id")
    if sample:
        rows = midpoint_sample(rows, sample)
    elif not every:
        rows = rows.where("__n <= 200").unionByName(midpoint_sample(rows.where("__n > 200"), 40))
    rows = title_verdicts(rows.drop("__n"), pages)
    if answers is not None:
        rows = rows.withColumn("verdict", answers)
    rows = rows.withColumn("ok", F.coalesce(F.col("verdict") == "yes", F.lit(False)))
    scored = rows.groupBy("doc_id").agg(F.round(F.avg(F.col("ok").cast("int")), 6).alias("accuracy"), F.count("*").alias("checked"))
    out = seen.join(scored, "doc_id", "left").select("doc_id", F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"), F.coalesce("checked", F.lit(0)).alias("checked"))
    return out, rows.where("not ok").drop("ok")


def repair(items: DataFrame, incorrect: DataFrame, pages: DataFrame, start_index: int = 1) -> DataFrame:
    """Give incorrect items the first page between their nearest correct neighbours that has their title at its
    head; without one they stay."""
    bad = incorrect.select("doc_id", "seq").distinct().withColumn("__bad", F.lit(True))
    rows = items.join(bad, ["doc_id", "seq"], "left")
    last = pages.groupBy("doc_id").agg(F.max("page_no").alias("__end"))
    rows = filled_neighbours(rows.join(last, "doc_id", "left"), start_index - 1, F.col("__end"), F.col("__bad").isNull())
    hit = first_pages(rows.where("__bad"), pages).withColumnRenamed("page_no", "__fixed")
    rows = rows.join(hit, ["doc_id", "seq"], "left").withColumn("physical_index", F.coalesce("__fixed", "physical_index"))
    return rows.drop("__bad", "__end", "__fixed", "prev_index", "next_index")


def fill(build: DataFrame, items: DataFrame) -> DataFrame:
    """Indices found for unfilled items, matched by structure and title; of several finds the last that says something."""
    key = ["doc_id", F.coalesce(F.col("structure").cast("string"), F.lit("None")).alias("__s"), F.coalesce(F.col("title"), F.lit("None")).alias("__t")]
    found = build.select(*key, "seq", "physical_index").groupBy("doc_id", "__s", "__t").agg(F.max(F.struct("seq", "physical_index"))["physical_index"].alias("__p"))
    rows = items.select("*", *key[1:]).join(found, ["doc_id", "__s", "__t"], "left")
    return rows.withColumn("physical_index", F.coalesce("physical_index", "__p")).drop("__s", "__t", "__p")


def toc_pages(pages: DataFrame, is_toc: Column, most: int = 20) -> DataFrame:
    """(doc_id, page_no) of the first run of contents pages. A run that has begun may go on past the limit."""
    w = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = pages.withColumn("__toc", is_toc).withColumn("__before", F.coalesce(F.sum(F.col("__toc").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    begun = F.min(F.when(F.col("__toc"), F.col("page_no"))).over(Window.partitionBy("doc_id"))
    rows = rows.withColumn("__first", begun).where((F.col("__first") <= most) & (F.col("page_no") >= F.col("__first")))
    broken = F.max((~F.col("__toc")).cast("int")).over(w)
    return rows.withColumn("__broken", broken).where("__broken = 0").select("doc_id", "page_no")


def looks_like_toc(text: Column | str) -> Column:
    """Most of a page's lines end in a page number after a leader or a blank; numbers of six digits or more need the leader."""
    lines = F.filter(F.split(T.col(text), "\n"), lambda x: F.trim(x) != "")
    hits = F.filter(lines, lambda x: x.rlike(r"(?:(?:\.{2,}|\s)\s*\d{1,5}|\.{2,}\s*\d{6,9})\s*$"))
    return (F.size(lines) >= 3) & (F.size(hits) * 2 >= F.size(lines))


def has_page_numbers(items: DataFrame) -> DataFrame:
    """(doc_id, given): does any item name a page?"""
    return items.groupBy("doc_id").agg((F.count("page") > 0).alias("given"))


def tail(items: DataFrame, n: int = 15) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("seq")))
    return items.withColumn("__n", nth).where(F.col("__n") <= n).drop("__n")
