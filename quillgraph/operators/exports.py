"""Pages and files of a stored graph for readers outside it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import report


def _front(title, kind: str):
    return F.concat(F.lit('---\ntitle: "'), title, F.lit(f'"\ntags: ["{kind}"]\n---\n\n'))


def section_pages(documents: DataFrame, sections: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """path, body of a page for each section: its front matter, a link to its document, its paragraphs in order.

    documents: document_id, title; sections: node_id, document_id, title; paragraphs: section_id, position, content.
    """
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "content"))), lambda x: F.concat(x["content"], F.lit("\n\n"))), "")
    bodies = paragraphs.groupBy(F.col("section_id").alias("node_id")).agg(text.alias("text"))
    rows = sections.join(documents.select("document_id", T.wiki_slug(F.col("title")).alias("_d")), "document_id").join(bodies, "node_id", "left")
    body = F.concat(_front(F.col("title"), "section"), F.lit("[[documents/"), F.col("_d"), F.lit("/index|Back to the document]]\n\n# "), F.col("title"), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    return rows.select("node_id", F.concat(F.lit("documents/"), F.col("_d"), F.lit("/"), T.wiki_slug(F.col("title")), F.lit(".md")).alias("path"), body.alias("body"))


def entity_pages(entities: DataFrame, mentions: DataFrame, paragraphs: DataFrame, titles: DataFrame) -> DataFrame:
    """path, body of a page for each entity: its front matter, and the documents that mention it with their counts.

    entities: slug, name, type; mentions: node_id, slug; paragraphs: node_id, document_id; titles: document_id, title.
    """
    back = report.back_references(mentions, paragraphs, titles)
    line = F.concat(F.lit("- [["), F.coalesce("title", F.col("document_id").cast("string")), F.lit("]] ("), F.col("n_paragraphs").cast("string"), F.lit(")\n"))
    links = back.groupBy("slug").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("document_id", line.alias("l")))), lambda x: x["l"]), "").alias("links"))
    rows = entities.join(links, "slug", "left")
    body = F.concat(_front(F.col("name"), "entity"), F.lit("# "), F.col("name"), F.lit("\n\n"), F.coalesce("links", F.lit("")))
    return rows.select("slug", F.concat(F.lit("entities/"), T.wiki_slug(F.col("name")), F.lit(".md")).alias("path"), body.alias("body"))


def entity_listing(entities: DataFrame) -> DataFrame:
    """path, body of an index page for each entity type."""
    listed = report.entity_index(entities)
    lines = F.array_join(F.transform("names", lambda n: F.concat(F.lit("- [["), n, F.lit("]]"))), "\n")
    return listed.select(F.concat(F.lit("entities/"), F.lower("type"), F.lit(".md")).alias("path"), F.concat(_front(F.col("type"), "index"), lines).alias("body"))


def as_json(rows: DataFrame) -> DataFrame:
    """json: each row as one object, null fields left out."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def write_json(collections: dict[str, DataFrame], path: str) -> None:
    """A folder of JSON lines for each collection."""
    for name, rows in collections.items():
        rows.write.mode("overwrite").json(f"{path}/{name}")


def layout_json(nodes: DataFrame) -> DataFrame:
    """doc, json: a document's nodes as one raw layout object, in order; a document's nodes come from one parsed file.

    nodes: doc, pos, node_type, level, page, title, content.
    """
    node = F.struct("pos", F.struct(F.col("node_type").alias("type"), "title", "content", F.struct("page", "level").alias("metadata")).alias("n"))
    listed = F.transform(F.array_sort(F.collect_list(node), lambda a, b: a["pos"] - b["pos"]), lambda x: x["n"])
    return nodes.groupBy("doc").agg(F.to_json(F.struct(listed.alias("nodes"))).alias("json"))
