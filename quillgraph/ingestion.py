"""Ingestion end to end: files to a graph that grows batch by batch.

A batch takes the files that the store doesn't have, and derives in one go: documents, nested sections, paragraphs with
tags, structural edges, mentions, entities, and the similarity edges between the new documents and all. It is written below a
folder of its own and in force once its line is in the manifest, so a batch that fails leaves nothing, and one that is run
again under the same name changes nothing. What depends on all batches (entities, decay classes) is put together on reading.

The offline rules stand in for a model: headings make sections, runs of lines paragraphs, capitalised names entities. A
document's set for similarity are its entities.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillgraph.config import DEFAULT, EngineConfig
from quillgraph.functions import text as T
from quillgraph.operators import docproc, graph, ingest, mutate
from quillgraph.state import written

MANIFEST = "batch string, folder string, n_documents long"
#: What a batch holds.
FRAMES = {
    "documents": "document_id string, title string, description string, published date, file_hash string, ingestion_status string, size long",
    "sections": "node_id string, document_id string, parent_id string, position int, level int, title string",
    "paragraphs": "node_id string, document_id string, section_id string, position int, content string, tags array<string>",
    "edges": "src string, dst string, relation string",
    "mentions": "node_id string, document_id string, slug string, name string",
    "similar": "src string, dst string, weight double",
}
#: A name: two capitalised words or more.
NAME = r"\p{Lu}[\p{L}\d]+(?: \p{Lu}[\p{L}\d]+)+"


@dataclass(frozen=True)
class Store:
    """The batches of a folder that are in force."""

    path: str

    def batches(self, spark: SparkSession) -> list[tuple[str, str]]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return []
        rows = spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest").collect()  # a row a batch
        return sorted({r["batch"]: r["folder"] for r in rows}.items())

    def read(self, spark: SparkSession, frame: str) -> DataFrame:
        """A frame over all batches."""
        folders = [f"{self.path}/{folder}/{frame}" for _, folder in self.batches(spark)]
        return spark.read.schema(FRAMES[frame]).parquet(*folders) if folders else spark.createDataFrame([], FRAMES[frame])

    def entities(self, spark: SparkSession) -> DataFrame:
        """slug, name (the first by document), mention_count, n_documents."""
        return self.read(spark, "mentions").groupBy("slug").agg(F.min_by("name", F.struct("document_id", "name")).alias("name"), F.count("*").alias("mention_count"), F.countDistinct("document_id").alias("n_documents"))

    def documents(self, spark: SparkSession, config: EngineConfig = DEFAULT) -> DataFrame:
        """The documents with their decay_class: often-linked ones are EVERGREEN."""
        docs = self.read(spark, "documents").withColumns({"node_id": F.col("document_id"), "decay_class": F.lit("SCHOLARLY")})
        # Similarity has no direction: the later document points to the earlier one, as in the edges of one batch.
        return graph.evergreen(self.read(spark, "similar"), docs, config.evergreen_indegree).drop("node_id")


def structure(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """sections and blocks (document_id, position, section_at, content) of files (document_id, text): lines between blank ones and headings."""
    # Split twice, for headings and for blocks, rather than written between; outer, since an explode also tests each array for being empty.
    lines = files.select("document_id", F.posexplode_outer(F.split(F.coalesce("text", F.lit("")), r"\r?\n")).alias("position", "line"))
    order = Window.partitionBy("document_id").orderBy("position")
    head, blank = F.col("line").rlike(r"^#{1,6} \S"), F.trim("line") == ""
    heads = lines.where(head).select("document_id", "position", F.length(F.regexp_extract("line", "^(#+)", 1)).alias("level"), F.trim(F.regexp_replace("line", "^#+ ", "")).alias("title"))
    lines = lines.withColumns({"_head": head, "_stop": head | blank}).withColumns({"_run": F.sum(F.col("_stop").cast("int")).over(order), "section_at": F.last(F.when(F.col("_head"), F.col("position")), ignorenulls=True).over(order)})
    nested = docproc.normalise_levels(docproc.nest_sections(heads, "document_id", "position"), "document_id", "position")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "line"))), lambda x: x["line"]), "\n")
    # A document's lines lie together for their runs, so its blocks move no more.
    blocks = lines.where("NOT _stop").groupBy("document_id", "_run", "section_at").agg(F.min("position").alias("position"), text.alias("content"))
    return nested, blocks.select("document_id", "position", "section_at", "content")


def _tagged(paragraphs: DataFrame, vocabulary: DataFrame | None) -> DataFrame:
    """Tags: the words of a vocabulary (word) that a paragraph has; else its longest word, the first of equals, or ``text``."""
    words = T.long_words(F.col("content"))
    longest = F.array_min(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))["w"]
    rows = paragraphs.withColumn("_own", F.coalesce(longest, F.lit("text")))
    if vocabulary is None:
        return rows.withColumn("tags", F.array("_own")).drop("_own")
    known = paragraphs.select("node_id", F.explode(F.array_distinct(words)).alias("word")).join(vocabulary.select("word").distinct(), "word", "left_semi")
    found = known.groupBy("node_id").agg(F.array_sort(F.collect_set("word")).alias("tags"))
    return rows.join(found, "node_id", "left").withColumn("tags", F.coalesce("tags", F.array("_own"))).drop("_own")


def derive(files: DataFrame, vocabulary: DataFrame | None = None) -> dict[str, DataFrame]:
    """The frames of a batch but for ``similar``, of files (document_id, text, file_hash)."""
    nested, blocks = structure(files)
    key = lambda kind, at: F.concat_ws("/", "document_id", F.concat(F.lit(kind), F.col(at).cast("string")))
    sections = nested.select(key("s", "position").alias("node_id"), "document_id", F.when(F.col("parent_position").isNotNull(), key("s", "parent_position")).alias("parent_id"), "position", "level", "title")
    rows = blocks.select(key("p", "position").alias("node_id"), "document_id", F.when(F.col("section_at").isNotNull(), key("s", "section_at")).alias("section_id"), "position", "content")
    paragraphs = written(_tagged(rows, vocabulary).select("node_id", "document_id", "section_id", "position", "content", "tags"), "paragraphs")
    edges = graph.structure_edges(sections.withColumnRenamed("position", "doc_position"))
    edges = edges.unionByName(graph.belongs_edges(paragraphs)).unionByName(graph.next_edges(paragraphs.withColumn("_up", F.coalesce("section_id", "document_id")), ["document_id", "_up"], "position", "NEXT_PARA"))
    name = F.explode_outer(F.array_distinct(F.regexp_extract_all("content", F.lit(NAME), F.lit(0))))  # outer: names are sought once; a null has no slug
    mentions = paragraphs.select("node_id", "document_id", name.alias("name")).withColumn("slug", T.slug(F.col("name"))).where("slug <> ''").dropDuplicates(["node_id", "slug"])
    metadata = ingest.document_metadata(files, "document_id")
    documents = files.select("document_id", "file_hash", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size")).join(metadata, "document_id")
    documents = documents.select("document_id", "title", "description", F.col("published").try_cast("date").alias("published"), "file_hash", F.lit("complete").alias("ingestion_status"), "size")
    return {"documents": documents, "sections": sections, "paragraphs": paragraphs, "edges": edges, "mentions": mentions.select("node_id", "document_id", "slug", "name")}


def _sets(mentions: DataFrame) -> DataFrame:
    return mentions.select(F.col("document_id").alias("set_id"), F.col("slug").alias("item")).distinct()


def add_batch(spark: SparkSession, store: Store, files: DataFrame, batch: str, vocabulary: DataFrame | None = None, config: EngineConfig = DEFAULT) -> int:
    """Takes in the files (document_id, text, file_hash) that the store lacks as one batch; returns how many. A batch already there changes nothing.

    Of files of one content, and of one document_id, the first by document_id and content counts; a document_id that the store has is left as it is.
    """
    if batch in dict(store.batches(spark)):
        return 0
    stored = store.read(spark, "documents")
    first = files.where("document_id IS NOT NULL").groupBy("file_hash").agg(F.min_by(F.struct("document_id", "text"), "document_id").alias("f")).select("f.*", "file_hash")
    first = first.groupBy("document_id").agg(F.min_by(F.struct("text", "file_hash"), "file_hash").alias("f")).select(F.col("document_id").cast("string"), "f.*")
    new = written(mutate.new_files(first, stored).join(stored.select("document_id"), "document_id", "left_anti"), "files")
    n = new.count()
    folder = f"batch-{uuid.uuid4().hex}"
    frames = derive(new, vocabulary)
    for name, rows in frames.items():
        rows.select(*[f.split()[0] for f in FRAMES[name].split(", ")]).write.parquet(f"{store.path}/{folder}/{name}")
    mentions = spark.read.schema(FRAMES["mentions"]).parquet(f"{store.path}/{folder}/mentions")
    everything = _sets(store.read(spark, "mentions").unionByName(mentions))
    similar = graph.set_similarity(everything, "dice", config.similarity_threshold, _sets(mentions).select("set_id").distinct())
    similar.select("src", "dst", F.col("dice").alias("weight")).write.parquet(f"{store.path}/{folder}/similar")
    spark.createDataFrame([(batch, folder, n)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{store.path}/manifest")
    return n


def ingest_stream(stream: DataFrame, store: Store, checkpoint: str, vocabulary: DataFrame | None = None, config: EngineConfig = DEFAULT) -> StreamingQuery:
    """Every micro-batch of files is a batch of the store, under its number: one that is run again is taken in once."""
    spark = stream.sparkSession
    query = stream.writeStream.foreachBatch(lambda rows, number: add_batch(spark, store, rows, f"stream-{number}", vocabulary, config)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def all_edges(spark: SparkSession, store: Store) -> DataFrame:
    """Structural edges, MENTIONS and SIMILAR_TO over all batches: src, dst, relation."""
    mentions = store.read(spark, "mentions").select(F.col("node_id").alias("src"), F.col("slug").alias("dst"), F.lit("MENTIONS").alias("relation"))
    similar = store.read(spark, "similar").select("src", "dst", F.lit("SIMILAR_TO").alias("relation"))
    return reduce(DataFrame.unionByName, [store.read(spark, "edges"), mentions, similar])
