"""Shared plumbing: shared-folder tables, column picking, and batching of long texts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch, where the session has not set its own: rows here hold whole texts and sets.
BATCH_ROWS = 1000
#: Bytes of text handled at once inside a Python task.
SLICE_BYTES = 1 << 20


class Workspace:
    """A folder of written tables in the cluster's shared folder (spark.checkpoint.dir).

    Written tables cut lineage and outlive executors. The folder goes when the JVM ends; an operator may
    forget single tables before, once what it returns no longer reads them.
    """

    def __init__(self, spark: SparkSession, name: str):
        sc = spark.sparkContext
        root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if root is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            import tempfile  # one machine, as in tests

            root = f"file://{tempfile.gettempdir()}/treeline-checkpoints"
        if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # Spark's default
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        self.spark = spark
        self.path = f"{root.rstrip('/')}/treeline-{name}-{uuid.uuid4().hex}"
        self._at = sc._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(sc._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(self._at(self.path))

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and return a reader of what was written."""
        target = f"{self.path}/{name}"
        df.write.parquet(target)
        return self.spark.read.schema(df.schema).parquet(target)

    def forget(self, *names: str) -> None:
        """Delete tables that nothing reads any more: all that came of them has been written."""
        for name in names:
            self._fs.delete(self._at(f"{self.path}/{name}"), True)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just (doc_id, text): extra columns, whatever their names, can't clash; a null text is empty."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def fold(col: Column, n: int) -> Column:
    """crc32 of the id's text modulo n (null for a null id)."""
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(n)).cast("int")


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about limit bytes of text each (one row at least)."""
    sizes = batch.column(column).cast(pa.large_binary())
    start = size = 0
    for i, n in enumerate(pa.compute.binary_length(sizes).to_pylist()):
        if i > start and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if batch.num_rows > start:
        yield batch.slice(start)


#: What operators keep in a Python worker between their tasks, by name.
KEPT: dict[str, dict] = {}


def release(but: str | None = None) -> None:
    """Free what other operators keep in this worker."""
    for name, kept in KEPT.items():
        if name != but:
            kept.clear()


def tidy(run, keeps: str | None = None):
    """A batch function that frees what other operators keep when its task begins, and gives freed memory back when it
    ends; workers are kept for later tasks."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from treeline.llm import common  # the worker's own module, not a copy of its names

        common.release(keeps)
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            gc.collect()
            pa.default_memory_pool().release_unused()
            ctypes.CDLL(None).malloc_trim(0)

    return tidied


def bounded_labels(
    docs: DataFrame, labels: DataFrame, target: str, modulus: int, held: int, limit: int
) -> DataFrame:
    """(doc_id, label, weight) of a bounded training sample: of the rows that may be learned from, the limit
    smallest by hash of the id, per label value. The bound keeps training cost constant at any size; a row
    weighs as many learnable rows of its label as it stands for, so a sample keeps the mix of all rows."""
    rows = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[target].cast("int").alias("label"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold(F.col("doc_id"), modulus) != held))
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    many = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    parts = [
        rows.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).withColumn("weight", F.lit(max(1.0, many.get(v, 0) / limit)))
        for v in (0, 1)
    ]
    return parts[0].unionByName(parts[1])
