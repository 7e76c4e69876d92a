"""Streams: new tree files into the index, the last output per conversation and tool, and windows over events.

The file source only sees new paths; changed and vanished files need the manifest difference of IndexStore.build.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from treeline.functions import text as T
from treeline.operators import tree


def new_trees(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (path, doc_id, raw)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.json").load(folder)
    return rows.select("path", T.file_stem("path").alias("doc_id"), F.decode("content", "UTF-8").alias("raw"))


def ingest(spark: SparkSession, folder: str, target: str, checkpoint: str) -> StreamingQuery:
    """Flatten every new file once and append its rows; a batch that is repeated replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        tree.flatten(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return new_trees(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, width: str = "10 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and type; works on streams and tables."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions per user, closed by a gap."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def last_outputs(items: DataFrame) -> DataFrame:
    """The last output per conversation and tool of a log (conv_id, seq, name, output), kept as state on a stream."""
    last = F.max(F.struct("seq", "output"))
    return items.groupBy("conv_id", "name").agg(last.alias("x")).select("conv_id", "name", F.col("x.seq").alias("seq"), F.col("x.output").alias("output"))
