"""The seam to language models: prompts in, answers out, by an injected function; and deterministic stand-ins.

A model is f(kind, prompts) -> answers over lists, called once per Arrow batch. `complete` puts any of them behind a
column; failures give an empty answer, as a service that is down would.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from treeline.functions import text as T
from treeline.operators import toc

Model = Callable[[str, list[str]], list[str]]


def complete(model: Model, kind: str, retries: int = 10, wait: float = 1.0) -> Callable[[Column], Column]:
    """A column function that asks a model."""

    @F.pandas_udf(StringType())
    def ask(prompts: pd.Series) -> pd.Series:
        for turn in range(max(1, retries)):
            try:
                return pd.Series(model(kind, prompts.tolist()))
            except Exception:  # noqa: BLE001  whatever the service throws
                if turn + 1 < retries:
                    time.sleep(wait)
        return pd.Series([""] * len(prompts))

    return ask


def head_summary(text: Column | str, most: int = 1500) -> Column:
    """What stands in for a summary: the text's head."""
    return F.substring(F.coalesce(T.col(text), F.lit("")), 1, most)


def summaries(nodes: DataFrame, summarise: Callable[[Column], Column] | None = None, least_tokens: int = 200) -> DataFrame:
    """nodes with summaries: short texts are their own; long ones go to the model or its stand-in. Of inner nodes it is called
    prefix_summary. The two kinds are separate branches, so the model sees only what it must."""
    ask = summarise or head_summary
    rows = nodes.withColumn("__tokens", T.estimated_tokens("text"))
    short = rows.where(F.col("__tokens") < least_tokens).withColumn("__s", F.col("text"))
    long = rows.where(F.col("__tokens") >= least_tokens).withColumn("__s", F.coalesce(F.nullif(ask(F.col("text")), F.lit("")), head_summary("text")))
    out = short.unionByName(long).drop("summary", "prefix_summary")
    return out.withColumn("summary", F.when(F.col("is_leaf"), F.col("__s"))).withColumn("prefix_summary", F.when(~F.col("is_leaf"), F.col("__s"))).drop("__tokens", "__s")


def descriptions(nodes: DataFrame, most: int = 200) -> DataFrame:
    """(doc_id, doc_description): what stands in for a drafted one, the titles of the top sections."""
    tops = nodes.where("depth = 0").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_seq", "title"))), lambda x: x["title"]), "; ").alias("t"))
    return tops.select("doc_id", F.substring("t", 1, most).alias("doc_description"))


def find_indices(items: DataFrame, pages: DataFrame) -> DataFrame:
    """physical_index of unfilled items: the first feasible page with the title at its head."""
    first = toc.first_pages(toc.filled_neighbours(items).where("physical_index is null"), pages).withColumnRenamed("page_no", "__p")
    return items.join(first, ["doc_id", "seq"], "left").withColumn("physical_index", F.coalesce("physical_index", "__p")).drop("__p")


def heading_items(pages: DataFrame) -> DataFrame:
    """Items from pages without contents: lines that look like numbered or named headings."""
    lines = pages.select("doc_id", "page_no", F.posexplode(F.split("page_text", "\n")).alias("at", "line"))
    m = lambda n: F.regexp_extract(F.trim("line"), r"^(\d{1,2}(?:\.\d{1,2}){0,3})\.?\s+([A-Z][^.!?]{2,80})$", n)
    from pyspark.sql import Window

    rows = lines.select("doc_id", "page_no", "at", m(1).alias("structure"), m(2).alias("title")).where("title <> ''")
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no", "at")) - 1
    return rows.select("doc_id", seq.cast("int").alias("seq"), "structure", "title", F.col("page_no").alias("physical_index"))
