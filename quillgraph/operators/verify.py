"""Integrity rules of a stored graph: each gives code, severity and node_id of what breaks it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators import graph, report
from quillgraph.state import written


def _issue(rows: DataFrame, code: str, severity: str, node: str = "node_id") -> DataFrame:
    return rows.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col(node).cast("string").alias("node_id"))


def presence(documents: DataFrame, sections: DataFrame, paragraphs: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, and how often it is a document (d), section (s), section with a parent (sp) or paragraph (p), and an end of edges:
    ``into`` of HAS_CHILD, ``out`` of BELONGS_TO, ``ends`` of any. One sum over all ids: no rule needs a join of nodes and edges."""
    counted = ("d", "s", "sp", "p", "into", "out", "ends")
    one = F.lit(1).cast("long")

    def rows(node, **of) -> list:
        return [node.cast("string").alias("node_id"), *[F.coalesce(of[c].cast("long"), F.lit(0).cast("long")).alias(c) if c in of else F.lit(0).cast("long").alias(c) for c in counted]]

    node = F.col("node_id")
    parts = [
        documents.select(*rows(node, d=one)), sections.select(*rows(node, s=one, sp=F.col("parent_id").isNotNull())), paragraphs.select(*rows(node, p=one)),
        edges.select(*rows(F.col("src"), out=F.col("relation") == "BELONGS_TO", ends=one)), edges.select(*rows(F.col("dst"), into=F.col("relation") == "HAS_CHILD", ends=one)),
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("node_id").agg(*[F.sum(c).alias(c) for c in counted])


def verify(documents: DataFrame, sections: DataFrame, paragraphs: DataFrame, edges: DataFrame) -> DataFrame:
    """All issues.

    documents: node_id; sections: node_id, document_id, parent_id, level; paragraphs: node_id, document_id, section_id,
    content, tags[]; edges: src, dst, relation.
    """
    relation = lambda name: edges.where(F.col("relation") == name)
    child, sibling = relation("HAS_CHILD"), relation("NEXT_SIBLING")
    anti = lambda rows, keys, key="node_id": rows.join(keys.withColumnRenamed(keys.columns[0], key).distinct(), key, "left_anti")
    owned = sections.select("document_id").unionByName(paragraphs.select("document_id"))
    parents = sections.where(F.col("parent_id").isNotNull())
    up = sections.select(F.col("node_id").alias("parent_id"), F.col("level").alias("parent_level"))
    leaf = sections.groupBy("document_id").agg(F.count("*").alias("n"), F.count("parent_id").alias("nested"))
    # A missing id is like no other, so it is no end of an edge.
    nodes, lacks = F.col("d") + F.col("s") + F.col("p"), lambda c: F.col("node_id").isNull() | (F.col(c) == 0)
    absent = [("MISSING_SECTION_HAS_CHILD", F.col("s"), lacks("into")), ("MISSING_SECTION_PARENT_EDGE", F.col("sp"), lacks("into")), ("MISSING_BELONGS_TO", F.col("p"), lacks("out")), ("ORPHANED_NODES", nodes, lacks("ends"))]
    times = [F.struct(F.lit(code).alias("code"), F.when(no, n).otherwise(0).alias("n")) for code, n, no in absent]
    no_node = F.struct(F.lit("").alias("code"), (nodes == 0).cast("long").alias("n"))
    broken = presence(documents, sections, paragraphs, edges).select("node_id", F.filter(F.array(no_node, *times), lambda x: x["n"] > 0).alias("x")).where(F.size("x") > 0)
    broken = written(broken.select("node_id", F.explode("x").alias("x")).select("node_id", "x.code", "x.n"), "broken")
    lacking = broken.where("code <> ''").select("code", F.lit("error").alias("severity"), "node_id", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select("code", "severity", "node_id")
    strays = broken.where("code = '' AND node_id IS NOT NULL").select("node_id")
    rules = [
        lacking,
        _issue(anti(documents, owned.select("document_id")), "NO_NODES", "error"),
        _issue(graph.duplicate_edges(edges), "DUPLICATE_EDGES", "warning", "src"),
        _issue(child.groupBy("dst").agg(F.countDistinct("src").alias("n")).where("n > 1"), "MULTI_PARENT_EDGE", "error", "dst"),
        _issue(parents.where(F.col("parent_id").contains("/") & ~F.col("node_id").contains("/")), "LEGACY_PARENT_SECTION_ID", "warning"),
        _issue(anti(parents.withColumn("parent_id", report.document_key(F.col("parent_id"))), sections.select(report.document_key(F.col("node_id"))), "parent_id"), "DANGLING_PARENT_SECTION_ID", "error"),
        _issue(parents.join(up, "parent_id").where(F.col("level") > F.col("parent_level") + 1), "LEVEL_GAP", "warning"),
        _issue(leaf.where("n > 1 AND nested = 0"), "ALL_SECTIONS_LEAF", "warning", "document_id"),
        _issue(graph.touching(edges, strays), "DEAD_EDGES", "error", "src"),
        _issue(paragraphs.where(F.coalesce(F.trim("content"), F.lit("")) == ""), "EMPTY_PARAGRAPHS", "warning"),
        _issue(sibling.groupBy("src").agg(F.count("*").alias("n")).where("n > 1"), "MULTI_NEXT_SIBLING", "warning", "src"),
        _issue(paragraphs.where(F.coalesce(F.size("tags"), F.lit(0)) == 0), "NO_TAGS", "info"),
    ]
    return reduce(DataFrame.unionByName, rules)


def coverage(documents: DataFrame, paragraphs: DataFrame, sources: DataFrame, low: float = 0.3, partial: float = 0.5) -> DataFrame:
    """Issues of documents whose paragraphs hold too little of the text they were made from, or whose source is gone.

    documents: node_id; paragraphs: document_id, content; sources: document_id, size.
    """
    held = paragraphs.groupBy("document_id").agg(F.sum(F.length(F.coalesce("content", F.lit("")))).alias("chars"))
    rows = documents.select(F.col("node_id").alias("document_id")).join(sources, "document_id", "left").join(held, "document_id", "left")
    rows = rows.withColumn("ratio", F.try_divide(F.coalesce("chars", F.lit(0)), F.col("size")))
    return reduce(DataFrame.unionByName, [
        _issue(rows.where("size IS NULL"), "ORIGINAL_FILE_NOT_FOUND", "warning", "document_id"),
        _issue(rows.where(F.col("ratio") < low), "LOW_CONTENT_COVERAGE", "error", "document_id"),
        _issue(rows.where((F.col("ratio") >= low) & (F.col("ratio") < partial)), "PARTIAL_CONTENT_COVERAGE", "warning", "document_id"),
    ])


def spot_checks(sources: DataFrame, paragraphs: DataFrame, most: int = 10, least: int = 60, lead: int = 40, seed: str = "spot") -> DataFrame:
    """Issues of documents of which too few sampled source paragraphs are found in the graph.

    Of each source, ``most`` paragraphs of ``least`` characters or more are drawn; one is found if some stored paragraph of
    the document has its first ``lead`` letters and digits in its own text. A sample is the feature here: it is a check.
    sources: document_id, text; paragraphs: document_id, content.
    """
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")
    pieces = sources.select("document_id", F.posexplode(F.split("text", r"\n\s*\n")).alias("at", "piece")).where((F.length("piece") >= least) & ~F.col("piece").rlike(r"^\s*[#|-]"))
    draw = F.row_number().over(Window.partitionBy("document_id").orderBy(F.xxhash64(F.lit(seed), "document_id", "at"), "at"))
    drawn = pieces.withColumn("k", draw).where(F.col("k") <= most).select("document_id", "k", F.left(F.trim(plain(F.col("piece"))), F.lit(lead)).alias("lead"))
    wanted = drawn.groupBy("document_id").agg(F.collect_list("lead").alias("leads"))  # at most ``most``
    held = paragraphs.join(wanted, "document_id").select("document_id", F.explode(F.filter("leads", lambda x: plain(F.col("content")).contains(x))).alias("lead")).distinct()
    hits = held.groupBy("document_id").agg(F.count("*").alias("hits"))
    rows = wanted.select("document_id", F.size(F.array_distinct("leads")).alias("n")).join(hits, "document_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    failed, partial = F.col("hits") < F.ceil(F.col("n") * 0.4), F.col("hits") < F.ceil(F.col("n") * 0.6)
    return _issue(rows.where(failed), "SPOT_CHECK_FAILED", "error", "document_id").unionByName(_issue(rows.where(~failed & partial), "SPOT_CHECK_PARTIAL", "warning", "document_id"))


def missing_edges(sections: DataFrame, paragraphs: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges that mend MISSING_SECTION_PARENT_EDGE and MISSING_BELONGS_TO: src, dst, relation."""
    has = lambda name, end: edges.where(F.col("relation") == name).select(F.col(end).alias("node_id")).distinct()
    child = sections.where("parent_id IS NOT NULL").join(has("HAS_CHILD", "dst"), "node_id", "left_anti")
    child = child.select(F.col("parent_id").alias("src"), F.col("node_id").alias("dst"), F.lit("HAS_CHILD").alias("relation"))
    return child.unionByName(graph.belongs_edges(paragraphs.join(has("BELONGS_TO", "src"), "node_id", "left_anti")))
