"""Sources: tree documents, Markdown, pages, raw HTML, question fixtures, configuration."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from treeline.functions import text as T

RELEVANT = "array<struct<doc_id: string, node_id: string>>"


def tree_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, mtime, size, doc_id, raw) of a folder's *.json files, not below it, without _meta.json and partial results."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    rows = rows.where((name != "_meta.json") & ~name.endswith(".partial.json"))
    return rows.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), T.file_stem("path").alias("doc_id"), F.decode("content", "UTF-8").alias("raw"))


def readable(trees: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trees with a structure, rejected with a reason): an object with a list `structure`, or a list."""
    v = F.try_parse_json("raw")
    shape = F.schema_of_variant(v)
    roots = F.when(shape.startswith("ARRAY"), v).otherwise(F.try_variant_get(v, "$.structure", "variant"))
    rows = trees.withColumn("__v", v).withColumn("__r", roots)
    some = F.coalesce(F.schema_of_variant("__r").startswith("ARRAY<") & (F.schema_of_variant("__r") != "ARRAY<VOID>"), F.lit(False))
    reason = F.when(F.col("__v").isNull(), "not JSON").when(~some, "no structure")
    rows = rows.withColumn("reason", reason)
    return rows.where("reason is null").drop("__v", "__r", "reason"), rows.where("reason is not null").select("path", "doc_id", "reason")


def load_documents(trees: DataFrame) -> DataFrame:
    """(doc_id, doc_name, doc_description, source_path, line_count) of readable tree files."""
    v = F.try_parse_json("raw")
    field = lambda f, t="string": F.try_variant_get(v, f"$.{f}", t)
    return trees.select("doc_id", F.coalesce(F.nullif(field("doc_name"), F.lit("")), F.col("doc_id")).alias("doc_name"), F.coalesce(field("doc_description"), F.lit("")).alias("doc_description"), F.col("path").alias("source_path"), field("line_count", "int").alias("line_count"))


def markdown_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, text, line_count) of whole Markdown files."""
    rows = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md").select("value", F.input_file_name().alias("path"))
    return rows.select(T.file_stem("path").alias("doc_id"), F.col("value").alias("text"), T.line_count("value").alias("line_count"))


def text_pages(documents: DataFrame, page_chars: int = 3000) -> DataFrame:
    """(doc_id, page_no, page_text, n_tokens) from plain texts: form feeds part pages, else about page_chars each."""
    parts = F.split(F.coalesce("text", F.lit("")), "\f", -1)
    n = F.greatest(F.ceil(F.length("text") / page_chars).cast("int"), F.lit(1))
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("text"), (i * page_chars + 1).cast("int"), F.lit(page_chars)))
    pages = F.when(F.col("text").contains("\f"), parts).otherwise(cut)
    rows = documents.select("doc_id", F.posexplode(pages).alias("at", "page_text"))
    return rows.select("doc_id", (F.col("at") + 1).alias("page_no"), "page_text", T.estimated_tokens("page_text").alias("n_tokens"))


def number_of_pages(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"))


class PdfPages(DataSource):
    """Pages of PDF files, one partition per file: spark.read.format('pdf_pages').option('paths', 'a.pdf,b.pdf').
    Needs a PDF library on the workers; option 'parser' is PyPDF2 (default) or PyMuPDF."""

    @classmethod
    def name(cls) -> str:
        return "pdf_pages"

    def schema(self) -> str:
        return "doc_id string, page_no int, page_text string, n_tokens bigint"

    def reader(self, schema) -> PdfReader:
        return PdfReader(self.options)


class PdfReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("paths", "").split(",") if p]
        self.parser = options.get("parser", "PyPDF2")
        if self.parser not in ("PyPDF2", "PyMuPDF"):
            raise ValueError(f"Unsupported PDF parser: {self.parser}")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition):
        path = partition.value
        if self.parser == "PyMuPDF":
            import pymupdf

            texts = [p.get_text() for p in pymupdf.open(path)]
        else:
            import PyPDF2

            texts = [p.extract_text() or "" for p in PyPDF2.PdfReader(path).pages]
        stem = os.path.splitext(os.path.basename(path))[0]
        for i, t in enumerate(texts, 1):
            yield stem, i, t, (len(t) + 3) // 4


def fixtures(spark: SparkSession, path: str) -> DataFrame:
    """(id, question, relevant, tags, note, overlap, bm25_rank) from JSON lines. Lines that are blank, broken or lack a question or
    relevant entries are skipped; ids default to q and the line's number."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n", -1)).alias("at", "line"))
    kind = f"id string, question string, relevant {RELEVANT}, tags array<string>, note string, overlap double, bm25_rank int"
    rows = lines.where(F.trim("line") != "").withColumn("r", F.from_json("line", kind)).where("r.question <> '' and size(r.relevant) > 0")
    number = F.col("at") + 1
    default = F.concat(F.lit("q"), F.lpad(number.cast("string"), F.greatest(F.lit(3), F.length(number.cast("string"))), F.lit("0")))
    none = F.array().cast("array<string>")
    return rows.select(F.coalesce("r.id", default).alias("id"), "r.question", "r.relevant", F.coalesce("r.tags", none).alias("tags"), "r.note", "r.overlap", "r.bm25_rank")


#: Defaults of the configuration; unknown keys are refused.
DEFAULTS = {
    "model": "", "toc_check_page_num": 20, "toc_verify_sample_num": 0, "max_page_num_each_node": 10, "max_token_num_each_node": 20_000,
    "if_add_node_id": "yes", "if_add_node_summary": "yes", "if_add_doc_description": "no", "if_add_node_text": "no",
}


def configuration(overrides: dict | None = None, path: str | None = None) -> dict:
    """Defaults, then a YAML file, then overrides that aren't None."""
    out = dict(DEFAULTS)
    if path:
        import yaml

        with open(path, encoding="utf-8") as f:
            out |= yaml.safe_load(f) or {}
    given = {k: v for k, v in (overrides or {}).items() if v is not None}
    if unknown := set(given) - set(out):
        raise ValueError(f"Unknown config keys: {sorted(unknown)}")
    return out | given


def setting(name: str, default, given=None):
    """A value by precedence: given, environment, default; of the default's type, which broken values fall back to."""
    raw = given if given is not None else os.environ.get(name)
    if raw is None or raw == "":
        return default
    if isinstance(default, bool):
        return str(raw).strip().lower() in ("1", "true", "yes", "on")
    try:
        return type(default)(raw)
    except ValueError:
        return default


def ordered_lines(lines: DataFrame) -> DataFrame:
    """lines with a running number per document."""
    return lines.withColumn("line_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_num")))
