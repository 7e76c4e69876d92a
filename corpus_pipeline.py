"""The training-data pipeline: toxicity, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; each works on everything its predecessor kept.
All but the last return the columns of documents. run() writes each stage's result in the shared folder and
reads it again for the next. Unlike the query of the n-gram Jaccard join, its stage takes five-word shingles
and a similarity of 0.8.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm import decontaminate, jaccard, packing, suffix_dedup, toxicity
from treeline.llm.common import Workspace

SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80
#: Word pieces a worker keeps while packing: fewer than alone, as the executors' heaps are full by then.
CACHED_PIECES = 250_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the toxicity operator rejects go; those without an id are scored but can't be told apart, and
    stay. Null and empty texts have no evidence of toxicity. Rows with one id go together if one of them is toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.scan(docs, labels)
    bad = scored.where("predicted = 1 and doc_id is not null").select(F.col("doc_id").alias("__toxic")).distinct()
    return docs.join(bad, docs["doc_id"].cast("long") == bad["__toxic"], "left_anti")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar documents stays, the one with the smallest id. Rows of one id with
    equal texts are one document; unlike texts under one id all stay if the id does. Documents without words
    (null and empty texts too) or without an id stay. Texts of any length are compared whole."""
    work = Workspace(spark, "near-duplicates")
    linked = jaccard.join(docs, SHINGLE_WORDS, SIMILARITY_PERCENT, 100)
    keep = linked.where("doc_id = component_id and n_shingles > 0").select("doc_id").distinct()
    empty = linked.where("n_shingles = 0 and doc_id is not null").select("doc_id").distinct()
    keep = work.table(keep.unionByName(empty).distinct().withColumnRenamed("doc_id", "__kept"), "kept")
    rows = docs.join(keep, docs["doc_id"].cast("long") == keep["__kept"], "left_semi")
    return _one_of_each(rows).unionByName(docs.where(docs["doc_id"].isNull()))


def _one_of_each(docs: DataFrame) -> DataFrame:
    """Of rows with one id and text one, without moving the texts of ids that stand once."""
    again = docs.groupBy(docs["doc_id"].alias("__again")).count().where("count > 1").select("__again")
    if again.isEmpty():
        return docs
    once = docs.join(again, docs["doc_id"] == again["__again"], "left_anti")
    return once.unionByName(docs.join(again, docs["doc_id"] == again["__again"], "left_semi").dropDuplicates(["doc_id", "text"]))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of repeated passages go from the texts (characters cut in part go too); no document goes.
    n_chars follows the text. Null and empty texts stay as they are; equal texts of a window or more, repeated rows
    among them, become empty."""
    cut = suffix_dedup.remove(docs)
    if "n_chars" not in docs.columns:
        return cut
    return cut.select(*[F.length("text").cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or a long passage of one, go. Null and empty texts hold none; rows with
    one id go together; rows without an id stay."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in training sequences. A null or empty text is a piece of the end id alone; repeated
    rows and null ids have pieces each."""
    return packing.pack(docs, cached=CACHED_PIECES)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("suffix_array_dedup", drop_repeated_passages),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("best_fit_packing", pack_sequences),
]

#: SQL can't express the trained scores, nor tokenisation; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    between = Workspace(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        docs = between.table(out, f"{i}-{name}")
