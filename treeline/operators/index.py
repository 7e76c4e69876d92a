"""The document index: tables kept up to date from a folder of trees, one manifest difference per refresh."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.functions import text as T
from treeline.functions import vectors as V
from treeline.operators import navigate, search, tree
from treeline.sources import readers

MANIFEST = "path string, mtime timestamp, size bigint, doc_id string"
DOCUMENTS = "doc_id string, doc_name string, doc_description string, doc_type string, size int, source_path string"
EMBEDDINGS = "doc_id string, node_seq int, dim int, unit array<double>"
INDEXED = ["title", "breadcrumb", "summary", "text"]
SCHEMA_VERSION = "1"


#: Ranked keys up to which they are broadcast.
BROADCAST_KEYS = 100_000


def manifest_diff(before: DataFrame, now: DataFrame, readable: Column | None = None) -> DataFrame:
    """(path, doc_id, action): add, update, skip or remove, by path, mtime and size. A file that is there but can't be read
    keeps its last good version. now may carry a boolean `ok`."""
    ok = readable if readable is not None else (F.col("n.ok") if "ok" in now.columns else F.lit(True))
    rows = before.alias("b").join(now.alias("n"), F.col("b.path") == F.col("n.path"), "full_outer")
    same = (F.col("b.mtime") == F.col("n.mtime")) & (F.col("b.size") == F.col("n.size"))
    action = (
        F.when(F.col("n.path").isNull(), "remove")
        .when(same, "skip")
        .when(~ok, F.when(F.col("b.path").isNull(), "reject").otherwise("keep"))
        .when(F.col("b.path").isNull(), "add")
        .otherwise("update")
    )
    return rows.select(F.coalesce("n.path", "b.path").alias("path"), F.coalesce("n.doc_id", "b.doc_id").alias("doc_id"), action.alias("action"))


def summary(diff: DataFrame) -> DataFrame:
    """One row: how many files were added, updated, skipped, removed."""
    count = lambda *a: F.count_if(F.col("action").isin(*a))
    return diff.agg(count("add").alias("added"), count("update").alias("updated"), count("skip", "keep", "reject").alias("skipped"), count("remove").alias("removed"))


def missing_embeddings(nodes: DataFrame, embeddings: DataFrame, keys: list[str]) -> DataFrame:
    return nodes.join(embeddings.select(*keys).distinct(), keys, "left_anti")


def rows_for_keys(nodes: DataFrame, ranked: DataFrame, keys: list[str], order: str = "rank") -> DataFrame:
    """Full rows of ranked keys, in rank order; text is fetched for these only. A top-k is small; a larger ranking
    is joined by shuffle."""
    small = ranked.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return (F.broadcast(ranked) if small else ranked).join(nodes, keys).orderBy(order)


def missing_then_delete(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """table without the rows of deleted keys."""
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table with rows put in place of those of equal keys."""
    return missing_then_delete(table, rows, keys).unionByName(rows, allowMissingColumns=True)


class IndexStore:
    """Parquet tables under one folder: documents, nodes, embeddings, manifest, meta. A refresh writes new versions of
    the tables and names them in the manifest last, so an interrupted one is simply done again."""

    TABLES = ("documents", "nodes", "embeddings", "manifest")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._hadoop = jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        root = self._hadoop(self.path)
        if not self._fs.exists(root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(root)]
        good = [int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and self._fs.exists(self._hadoop(f"{self.path}/{n}/manifest/_SUCCESS"))]
        return sorted(good)

    def _schema(self, name: str) -> str:
        return {"documents": DOCUMENTS, "nodes": tree.FLAT_SCHEMA + ", text_len int", "embeddings": EMBEDDINGS, "manifest": MANIFEST}[name]

    def table(self, name: str) -> DataFrame:
        found = self._versions()
        if not found:
            return self.spark.createDataFrame([], self._schema(name))
        return self.spark.read.schema(self._schema(name)).parquet(f"{self.path}/v{found[-1]}/{name}")

    def _commit(self, tables: dict[str, DataFrame]) -> None:
        found = self._versions()
        target = f"{self.path}/v{(found[-1] if found else 0) + 1}"
        self._fs.delete(self._hadoop(target), True)
        for name in self.TABLES:  # the manifest comes last
            tables[name].write.parquet(f"{target}/{name}")
        for old in found[:-1]:
            self._fs.delete(self._hadoop(f"{self.path}/v{old}"), True)

    def build(self, folder: str, reindex: bool = False) -> dict:
        """Refresh from a folder; counts of what was done."""
        files = readers.tree_files(self.spark, folder)
        good, _ = readers.readable(files)
        now = files.join(good.select("path", F.lit(True).alias("ok")), "path", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
        before = self.spark.createDataFrame([], MANIFEST) if reindex else self.table("manifest")
        diff = manifest_diff(before, now.drop("raw")).cache()
        changed = diff.where("action in ('add', 'update')").select("path")
        gone = diff.where("action in ('add', 'update', 'remove')").select("doc_id").distinct()
        trees = good.join(changed, "path", "left_semi")
        nodes = tree.flatten(trees).withColumn("text_len", F.length("text"))
        docs = readers.load_documents(trees).join(navigate.doc_type_and_size(nodes), "doc_id", "left")
        docs = docs.select("doc_id", "doc_name", "doc_description", F.coalesce("doc_type", F.lit("pdf")).alias("doc_type"), F.coalesce("size", F.lit(0)).cast("int").alias("size"), "source_path")
        old = {n: self.spark.createDataFrame([], self._schema(n)) if reindex else missing_then_delete(self.table(n), gone, ["doc_id"]) for n in ("documents", "nodes", "embeddings")}
        kept = missing_then_delete(before, diff.where("action not in ('skip', 'keep')"), ["path"])
        fresh = now.join(changed, "path", "left_semi").select("path", "mtime", "size", "doc_id")
        counts = summary(diff).first().asDict() | {"nodes_indexed": nodes.count()}
        self._commit({"documents": old["documents"].unionByName(docs), "nodes": old["nodes"].unionByName(nodes), "embeddings": old["embeddings"], "manifest": kept.unionByName(fresh)})
        diff.unpersist()
        return counts

    def build_embeddings(self, embed: Callable[[Column], Column], reembed: bool = False, body_chars: int = 0) -> int:
        """Embed nodes that have no vector yet with an injected column function; all vectors must share one dimension."""
        nodes, have = self.table("nodes"), self.table("embeddings")
        have = have.where("false") if reembed else have
        todo = missing_embeddings(nodes, have, ["doc_id", "node_seq"])
        vectors = todo.select("doc_id", "node_seq", V.unit(embed(T.embed_text("title", "breadcrumb", "summary", "text", body_chars))).alias("unit"))
        vectors = vectors.select("doc_id", "node_seq", F.size("unit").alias("dim"), "unit").cache()
        dims = [r["dim"] for r in have.select("dim").unionByName(vectors.select("dim")).distinct().limit(2).collect()]
        if len(dims) > 1:
            raise ValueError(f"Embedding dimensions differ: {sorted(dims)}")
        done = vectors.count()
        if done != todo.count():
            raise RuntimeError("The embedding function returned another number of vectors than texts")
        self._commit({"documents": self.table("documents"), "nodes": nodes, "embeddings": have.unionByName(vectors), "manifest": self.table("manifest")})
        vectors.unpersist()
        return done

    def meta(self) -> dict:
        e = self.table("embeddings")
        one = e.agg(F.count("*").alias("n"), F.max("dim").alias("dim")).first()
        return {"schema_version": SCHEMA_VERSION, "embed_dim": one["dim"], "embeddings": one["n"], "has_embeddings": one["n"] > 0}

    def stats(self) -> DataFrame:
        return navigate.store_stats(self.table("documents"), self.table("nodes"), self.table("embeddings"))

    def search(self, questions: DataFrame, k: int = 50) -> DataFrame:
        """BM25 top k for questions (id, question)."""
        return search.search(self.table("nodes"), ["doc_id", "node_seq"], INDEXED, questions, "id", "question", k)

    def vector_search(self, query: list[float], k: int = 50) -> DataFrame:
        return search.vector_search(self.table("embeddings"), ["doc_id", "node_seq"], "unit", query, k)


def hashing_embedder(dim: int = 64) -> Callable[[Column], Column]:
    """A deterministic stand-in for an embedding service: words hashed to buckets, all in expressions."""

    def embed(text: Column) -> Column:
        buckets = F.transform(T.tokens(text), lambda w: F.pmod(F.xxhash64(w), F.lit(dim)))
        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(buckets, lambda b: b == i)).cast("double"))

    return embed
