"""Sequence folds: packing pages, lines and snippets into groups, and splitting texts. A group depends on all before it, so
each document's lengths are folded in order; texts are only put together once groups are known."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _starts(lengths: Column, limit: Column, overlap: int) -> Column:
    """Fold: where groups begin, as (first, at): a group that would overflow closes at `at`, and the next begins
    `overlap` earlier."""
    one = lambda first, at: F.struct(first.cast("int").alias("first"), at.cast("int").alias("at"))
    state = F.struct(F.array(one(F.lit(0), F.lit(0))).alias("starts"), F.lit(0).cast("long").alias("held"), F.lit(0).alias("i"))

    def step(s: Column, n: Column) -> Column:
        full = (s["i"] > F.element_at(s["starts"], -1)["first"]) & (s["held"] + n > limit)
        begin = F.greatest(s["i"] - overlap, F.lit(0))
        again = F.aggregate(F.slice(lengths, begin + 1, s["i"] - begin), F.lit(0).cast("long"), lambda a, x: a + x)
        return F.struct(
            F.when(full, F.concat(s["starts"], F.array(one(begin, s["i"])))).otherwise(s["starts"]).alias("starts"),
            (F.when(full, again).otherwise(s["held"]) + n).alias("held"),
            (s["i"] + 1).alias("i"),
        )

    return F.aggregate(lengths, state, step)["starts"]


def _grouped(rows: DataFrame, order: str, tokens: str, limit: Column, overlap: int) -> DataFrame:
    """(doc_id, group, first, last): positions from 0."""
    packed = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(tokens).cast("long").alias("n")))).alias("x"))
    packed = packed.withColumn("ns", F.transform("x", lambda x: x["n"])).withColumn("total", F.aggregate("ns", F.lit(0).cast("long"), lambda a, x: a + x))
    packed = packed.withColumn("limit", limit).withColumn("starts", F.when(F.col("total") <= F.col("limit"), F.array(F.struct(F.lit(0).alias("first"), F.lit(0).alias("at")))).otherwise(_starts(F.col("ns"), F.col("limit"), overlap)))
    end = lambda i: F.coalesce(F.get("starts", i + 1)["at"] - 1, F.size("ns") - 1)
    return packed.select("doc_id", F.posexplode(F.transform("starts", lambda s, i: F.struct(s["first"].alias("first"), end(i).alias("last")))).alias("group", "g")).select("doc_id", "group", F.col("g.first").alias("first"), F.col("g.last").alias("last"))


def page_groups(pages: DataFrame, max_tokens: int = 20_000, overlap: int = 1) -> DataFrame:
    """Groups of pages (doc_id, page_no, n_tokens) of about even size within max_tokens, overlapping by whole pages.
    A document that fits is one group."""
    most = F.lit(max_tokens)
    parts = F.ceil(F.col("total") / most)
    even = F.ceil((F.col("total") / parts + most) / 2)
    return _grouped(pages, "page_no", "n_tokens", F.when(F.col("total") <= most, most.cast("long")).otherwise(even.cast("long")), overlap)


def greedy_groups(rows: DataFrame, order: str, tokens: str, budget: int) -> DataFrame:
    """Groups of snippets within a budget, without overlap; one that is over it alone has a group of its own."""
    return _grouped(rows, order, tokens, F.lit(budget).cast("long"), 0)


def line_chunks(lines: DataFrame, budget: int = 6000) -> DataFrame:
    """Groups of lines (doc_id, line_no, line) whose joined text is within a budget of tokens (a quarter of its
    characters, rounded up). Each line counts with its line break, the group with one less."""
    rows = lines.where("line <> ''").withColumn("chars", F.length("line") + 1)
    return _grouped(rows, "line_no", "chars", F.lit(4 * budget + 1).cast("long"), 0)


def group_texts(groups: DataFrame, rows: DataFrame, order: str, text: str, separator: str = "") -> DataFrame:
    """groups with their texts, by equality on spelled-out positions."""
    at = groups.select("doc_id", "group", F.explode(F.sequence("first", "last")).alias("at"))
    nth = rows.withColumn("at", (F.row_number().over(Window.partitionBy("doc_id").orderBy(order)) - 1).cast("int")).select("doc_id", "at", F.col(text).alias("t"))
    joined = at.join(nth, ["doc_id", "at"]).groupBy("doc_id", "group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "t"))), lambda x: x["t"]), separator).alias("text"))
    return groups.join(joined, ["doc_id", "group"])


def fixed_chunks(rows: DataFrame, size: int, order: str = "seq") -> DataFrame:
    """rows with chunk: every `size` rows of a document share one."""
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(order)) - 1
    return rows.withColumn("chunk", F.floor(nth / size).cast("int"))


def split_points(text: str, budget: int | None) -> list[int]:
    """Where to cut a text so that parts fit a token budget: near even lengths, at a paragraph, line or sentence end in the
    back half of a part if there is one. Parts aim at 85 % of the budget."""
    total = (len(text) + 3) // 4
    if not text or not budget or budget <= 0 or total <= budget:
        return [0, len(text)]
    parts = max(2, -(-total // max(512, int(budget * 0.85))))
    size, cuts = max(1, len(text) // parts), [0]
    while cuts[-1] < len(text):
        begin = cuts[-1]
        end = min(len(text), begin + size)
        if end < len(text):
            found = ((text.rfind(s, begin + size // 2, end), s) for s in ("\n\n", "\n", ". "))
            end = next((i + len(s) for i, s in found if i > begin), end)
        cuts.append(end)
    return cuts


def split_texts(texts: DataFrame, budget: int) -> DataFrame:
    """(doc_id, part, text): texts (doc_id, text) in parts."""

    def run(frames):
        for f in frames:
            out = []
            for d, t in zip(f["doc_id"], f["text"].fillna("")):
                cuts = split_points(t, budget)
                out += [(d, i, t[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            yield pd.DataFrame(out, columns=["doc_id", "part", "text"])

    return texts.select("doc_id", "text").mapInPandas(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, part int, text string")
