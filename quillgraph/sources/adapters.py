"""The engine's collections, made from plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import docproc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of long texts. A small file may be a single row group, which one task would parse alone, so an input of
    fewer partitions than cores is dealt out first; a larger one is read as it is, without a shuffle."""
    df = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def by(group: str, order: str):
    """The window of a group's rows in order."""
    return Window.partitionBy(group).orderBy(order)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, title, content, source, lang, file_hash, published, decay_class."""
    docs = texts(spark, sf_dir, "documents")
    number = F.regexp_extract("source", r"(\d+)", 1).cast("int") % 4
    classes = F.array(*[F.lit(c) for c in ("EVERGREEN", "SCHOLARLY", "CURRENT", "EPHEMERAL")])
    return docs.select(
        F.col("doc_id").alias("node_id"),
        F.left("text", F.lit(60)).alias("title"),
        F.col("text").alias("content"),
        "source",
        "lang",
        F.sha2("text", 256).alias("file_hash"),
        F.date_add(F.to_date(F.lit("1995-01-01")), (F.col("doc_id") * 7 % 10000).cast("int")).alias("published"),
        F.get(classes, number).alias("decay_class"),
    )


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos, node_id (doc_id-pos), content: the lines of documents."""
    rows = docproc.lines(texts(spark, sf_dir, "documents"))
    return rows.select("doc_id", "pos", F.concat_ws("-", "doc_id", "pos").alias("node_id"), "content")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, pos, level, title: the headings of crawled pages."""
    pages = texts(spark, sf_dir, "pages").select("page_id", T.html_markdown(F.col("html")).alias("markdown"))
    return docproc.markdown_headings(pages, "page_id", "markdown")


def mentions(spark: SparkSession, sf_dir: str, least_length: int = 5) -> DataFrame:
    """node_id, slug: the different words of five letters or more of a document. Common words stay: rollups and counts
    aggregate before they shuffle, and a query's words are few."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) >= least_length))
    return texts(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), F.explode(words).alias("slug"))


def part_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, relation: parts on neighbouring lines of an order."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    after = items.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("other"))
    rows = items.join(after, ["l_orderkey", "l_linenumber"]).where("l_partkey <> other")
    return rows.select(F.least("l_partkey", "other").alias("src"), F.greatest("l_partkey", "other").alias("dst"), F.lit("RELATED_TO").alias("relation"))


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HAS_CHILD edges region -> nation -> customer -> order, with typed handles."""
    handle = lambda c, key: F.concat(F.lit(c), F.col(key).cast("string"))
    edge = lambda df, a, b: df.select(a.alias("src"), b.alias("dst"), F.lit("HAS_CHILD").alias("relation"))
    rows = edge(table(spark, sf_dir, "nation"), handle("R", "n_regionkey"), handle("N", "n_nationkey"))
    rows = rows.unionByName(edge(table(spark, sf_dir, "customer"), handle("N", "c_nationkey"), handle("C", "c_custkey")))
    return rows.unionByName(edge(table(spark, sf_dir, "orders"), handle("C", "o_custkey"), handle("O", "o_orderkey")))


def type_ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """child, parent: each part under its brand, each brand under its maker, each type under its leading words."""
    part = table(spark, sf_dir, "part")
    maker = F.left("p_brand", F.lit(7))
    rows = part.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("child"), F.col("p_brand").alias("parent"))
    rows = rows.unionByName(part.select(F.col("p_brand").alias("child"), maker.alias("parent")).where("child <> parent").distinct())
    return rows.unionByName(part.select(maker.alias("child"), F.lit("Thing").alias("parent")).distinct())


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, result_rank, signal: purchases are positive, errors negative."""
    signal = F.when(F.col("event_type") == "purchase", "positive").when(F.col("event_type") == "error", "negative")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("node_id"), (F.col("event_id") % 20).alias("result_rank"), signal.alias("signal"))
    return rows.where("signal IS NOT NULL")
