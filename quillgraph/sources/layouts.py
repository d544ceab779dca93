"""Readers of parser layouts (three JSON forms) into one node frame, markdown and crawl sources, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.state import written

# The fields of the three layouts that are read.
OKF = "struct<nodes:array<struct<type:string,title:string,content:string,text:string,part:string,metadata:struct<page:int,level:int>,sumo_candidate_tags:array<string>,table:struct<content_data:array<array<string>>>>>>"
MINERU = "struct<pdf_body:array<struct<type:string,text:string,level:int,latex:string,table_cells:array<array<string>>,markdown:string>>>"
DOCLING = "struct<document:struct<name:string,texts:array<struct<label:string,text:string>>,tables:array<struct<data:array<array<string>>,markdown:string>>>>"

NODES = ("doc", "pos", "node_type", "level", "page", "title", "content")


def _exploded(docs: DataFrame, key: str, rows: Column) -> DataFrame:
    return docs.select(F.col(key).alias("doc"), F.posexplode(rows).alias("pos", "n"))


def okf_nodes(docs: DataFrame, key: str, json: str) -> DataFrame:
    """One row for each node of the native layout; repairable JSON is repaired."""
    rows = _exploded(docs.withColumn("_l", T.repaired_json(F.col(json), OKF)), key, F.col("_l.nodes"))
    content = F.coalesce("n.content", "n.text", T.pipe_table(F.col("n.table.content_data")))
    return rows.select("doc", "pos", F.col("n.type").alias("node_type"), F.col("n.metadata.level").alias("level"), F.col("n.metadata.page").alias("page"), F.col("n.title").alias("title"), content.alias("content"))


def mineru_nodes(docs: DataFrame, key: str, json: str) -> DataFrame:
    """Titles and headings become sections, text and equations paragraphs, tables tables."""
    rows = _exploded(docs.withColumn("_l", F.from_json(json, MINERU)), key, F.col("_l.pdf_body"))
    kind = F.col("n.type")
    section = kind.isin("title", "heading")
    node = F.when(section, "Section").when(kind == "table", "Table").when(kind == "figure", "Figure").otherwise("Paragraph")
    level = F.when(section, F.coalesce("n.level", F.lit(1)))
    content = F.when(kind == "table", F.coalesce("n.markdown", T.pipe_table(F.col("n.table_cells")))).when(kind == "equation", F.coalesce("n.latex", "n.text")).when(~section, F.col("n.text"))
    return rows.select("doc", "pos", node.alias("node_type"), level.alias("level"), F.lit(None).cast("int").alias("page"), F.when(section, F.col("n.text")).alias("title"), content.alias("content"))


def docling_nodes(docs: DataFrame, key: str, json: str) -> DataFrame:
    """Headings (heading_N) become sections, other texts paragraphs or list items; tables follow the texts."""
    docs = docs.withColumn("_l", F.from_json(json, DOCLING))
    texts = _exploded(docs, key, F.col("_l.document.texts"))
    label = F.col("n.label")
    heading = label.startswith("heading")
    level = F.when(heading, F.coalesce(F.try_to_number(F.regexp_extract(label, r"(\d+)$", 1), F.lit("9")).cast("int"), F.lit(1)))
    node = F.when(heading, "Section").when(label == "list_item", "ListItem").otherwise("Paragraph")
    none = F.lit(None)
    out = texts.select("doc", "pos", node.alias("node_type"), level.alias("level"), none.cast("int").alias("page"), F.when(heading, F.col("n.text")).alias("title"), F.when(~heading, F.col("n.text")).alias("content"))
    tables = docs.select(F.col(key).alias("doc"), F.coalesce(F.size("_l.document.texts"), F.lit(0)).alias("_base"), F.posexplode("_l.document.tables").alias("k", "n"))
    content = F.coalesce("n.markdown", T.pipe_table(F.col("n.data")))
    return out.unionByName(tables.select("doc", (F.col("_base") + F.col("k")).alias("pos"), F.lit("Table").alias("node_type"), none.cast("int").alias("level"), none.cast("int").alias("page"), none.cast("string").alias("title"), content.alias("content")))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """source_file, text, file_hash of whole Markdown files."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source_file"), F.col("value").alias("text"))
    return rows.withColumn("file_hash", F.sha2("text", 256))


def cached(requests: DataFrame, cache: DataFrame, compute) -> tuple[DataFrame, DataFrame]:
    """Answers to requests (key, ...): those in the cache (key, payload), and newly computed ones, which are also returned to be appended.

    The new ones are written before anything reads them: ``compute`` is asked once for each key, whatever is made of its answers.
    """
    requests = requests.dropDuplicates(["key"])
    new = written(compute(written(requests.join(cache.select("key"), "key", "left_anti"), "requests")), "answers")
    return cache.join(requests.select("key"), "key", "left_semi").select("key", "payload").unionByName(new.select("key", "payload")), new


def append_feedback(rows: DataFrame, path: str) -> None:
    """Valid signals only."""
    ok = F.col("signal").isin("positive", "negative") & F.col("node_id").isNotNull() & F.col("query_hash").isNotNull()
    rows.where(F.coalesce(ok, F.lit(False))).write.mode("append").parquet(path)
