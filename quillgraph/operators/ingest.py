"""Steps of ingestion around a provider: structuring, metadata, prefixes, contents of pages, resolution, backfills, upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.functions import vector as V
from quillgraph.operators import mutate
from quillgraph.sources import layouts


def preflight(files: DataFrame, stored: DataFrame, most_bytes: int = 200 << 20, force: bool = False) -> DataFrame:
    """file_hash, verdict of incoming files (file_hash, size, text): ok, empty, too_large or known."""
    todo = mutate.new_files(files, stored, force).select("file_hash", F.lit(True).alias("_new"))
    rows = files.dropDuplicates(["file_hash"]).join(todo, "file_hash", "left")
    empty = F.trim(F.coalesce("text", F.lit(""))) == ""
    return rows.select("file_hash", F.when(F.col("_new").isNull(), "known").when(empty, "empty").when(F.col("size") > most_bytes, "too_large").otherwise("ok").alias("verdict"))


def structured_chunks(chunks: DataFrame, cache: DataFrame, provider) -> tuple[DataFrame, DataFrame]:
    """Nodes of chunks (document_id, chunk, text) from a provider's JSON, and the new cache entries (key, payload).

    A chunk that the cache has isn't asked for. JSON is repaired; a chunk whose answer stays unreadable is one raw
    paragraph with status ``llm_pending``, so no text is lost. Nodes: document_id, chunk, pos, node_type, title, content, status.
    """
    keyed = chunks.withColumn("key", T.cache_key(F.lit("structure"), F.col("text")))
    answers, new = layouts.cached(keyed.select("key", F.col("text").alias("prompt")), cache, provider.answer)
    schema = "struct<nodes:array<struct<type:string,title:string,content:string>>>"
    rows = keyed.join(answers.withColumn("n", T.repaired_json(F.col("payload"), schema)["nodes"]).select("key", "n"), "key", "left")
    raw = F.array(F.struct(F.lit("Paragraph").alias("type"), F.lit(None).cast("string").alias("title"), F.col("text").alias("content")))
    good = F.coalesce(F.size("n"), F.lit(0)) > 0
    rows = rows.select("document_id", "chunk", F.when(good, "structured").otherwise("llm_pending").alias("status"), F.posexplode(F.when(good, F.col("n")).otherwise(raw)).alias("pos", "x"))
    return rows.select("document_id", "chunk", "pos", F.col("x.type").alias("node_type"), F.col("x.title").alias("title"), F.col("x.content").alias("content"), "status"), new


def document_metadata(docs: DataFrame, key: str = "doc_id", text: str = "text", chars: int = 300) -> DataFrame:
    """key, title, description, published: first heading or line, first sentences, first date in a text (offline stand-ins)."""
    lines = F.filter(F.split(F.col(text), r"\r?\n"), lambda x: F.trim(x) != "")
    first = F.trim(F.regexp_replace(F.get(lines, F.lit(0)), r"^#+\s*", ""))
    prose = F.trim(F.regexp_replace(F.array_join(F.filter(lines, lambda x: ~x.startswith("#")), " "), r"\s+", " "))
    date = F.nullif(F.regexp_extract(text, r"\b((?:1[5-9]|20)\d{2}-\d{2}-\d{2})\b", 1), F.lit(""))
    return docs.select(key, F.left(first, F.lit(120)).alias("title"), F.left(prose, F.lit(chars)).alias("description"), date.alias("published"))


def running_positions(nodes: DataFrame) -> DataFrame:
    """Adds doc_position: the place of a node in its whole document, from 0, over all chunks and kinds of nodes.

    nodes: document_id, chunk, pos and more; nodes of one chunk and pos keep an order by their other columns.
    """
    rest = [c for c in nodes.columns if c not in ("document_id", "chunk", "pos")]
    order = Window.partitionBy("document_id").orderBy("chunk", "pos", *rest)
    return nodes.withColumn("doc_position", F.row_number().over(order) - 1)


def best_dates(candidates: DataFrame) -> DataFrame:
    """Of each document's dates, found in its chunks, the row of the highest confidence (none counts as 0); the first chunk of equals, then the smallest of the rest.

    candidates: document_id, chunk, confidence and what goes with them.
    """
    rest = [c for c in candidates.columns if c not in ("document_id", "chunk", "confidence")]
    best = F.min(F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("_c"), "chunk", *rest, "confidence")).alias("b")
    return candidates.groupBy("document_id").agg(best).select("document_id", *[f"b.{c}" for c in ("chunk", "confidence", *rest)])


def batches(rows: DataFrame, by: list[str], order: str, size: int) -> DataFrame:
    """Adds batch, from 0: rows of a group in order, so many to a batch."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1
    return rows.withColumn("batch", F.floor(place / size).cast("int"))


def context_prefixes(paragraphs: DataFrame, metadata: DataFrame, size: int = 8) -> DataFrame:
    """node_id, batch, prefix: where a paragraph stands, for its embedding; paragraphs of a document in batches of ``size``.

    paragraphs: node_id, document_id, position, section_title; metadata: document_id, title.
    """
    rows = batches(paragraphs, ["document_id"], "position", size).join(metadata, "document_id", "left")
    return rows.select("node_id", "batch", F.concat_ws(" / ", "title", "section_title").alias("prefix"))


def enriched(edges: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Edges with verb (100 characters), tags (4) and summary (300): the shared tags of both ends, the offline stand-in for a model.

    left, right: node_id, title, tags[] of the ends.
    """
    end = lambda df, name: df.select(F.col("node_id").alias(name), F.col("title").alias(f"_t_{name}"), F.col("tags").alias(f"_g_{name}"))
    rows = edges.join(end(left, "src"), "src").join(end(right, "dst"), "dst")
    shared = F.slice(F.array_sort(F.array_intersect("_g_src", "_g_dst")), 1, 4)
    verb = F.when(F.size(shared) > 0, F.concat(F.lit("shares "), F.array_join(shared, ", "))).otherwise(F.lit("relates to"))
    summary = F.concat(F.col("_t_src"), F.lit(" "), verb, F.lit(" with "), F.col("_t_dst"))
    return rows.select(*edges.columns, F.left(verb, F.lit(100)).alias("verb"), shared.alias("tags"), F.left(summary, F.lit(300)).alias("summary"))


def pseudo_questions(paragraphs: DataFrame, least: int = 100, most: int = 2) -> DataFrame:
    """node_id, question, key: up to two questions of a paragraph of ``least`` characters or more, by its longest words.

    The offline stand-in for a model: paragraphs with the same leading words answer the same question.
    """
    words = F.array_distinct(T.tokens(F.col("content")))
    ordered = F.transform(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w")))), lambda x: x["w"])
    rows = paragraphs.where(F.length("content") >= least).select("node_id", F.explode(F.slice(ordered, 1, most)).alias("word"))
    question = F.concat(F.lit("What is "), F.col("word"), F.lit("?"))
    return rows.select("node_id", question.alias("question"), T.question_key(question).alias("key"))


def page_sections(pages: DataFrame, is_boundary: Column, window: int = 5, least: int = 3) -> DataFrame:
    """document_id, section, first_page, last_page: contents of a document without headings.

    Pages are taken in windows; a section begins where a window is on another topic than the one before it
    (``is_boundary`` over vector and before). A section of fewer than ``least`` pages joins the more similar neighbour, the later one
    of equals. pages: document_id, page (from 0), vector.
    """
    own = Window.partitionBy("document_id").orderBy("window")
    mean = F.array(*[F.avg(F.get("vector", F.lit(k))) for k in range(pages.select(F.size("vector").alias("n")).head(1)[0]["n"])]) if not pages.isEmpty() else F.array().cast("array<double>")
    rows = pages.withColumn("window", F.floor(F.col("page") / window).cast("int"))
    wins = rows.groupBy("document_id", "window").agg(mean.alias("vector"), F.min("page").alias("first"), F.max("page").alias("last"), F.count("*").alias("n"))
    wins = wins.withColumn("before", F.lag("vector").over(own)).withColumn("opens", F.col("before").isNull() | is_boundary)
    wins = wins.withColumn("section", F.sum(F.col("opens").cast("int")).over(own))
    merged = wins.groupBy("document_id", "section").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"), F.min_by("vector", "window").alias("head"), F.max_by("vector", "window").alias("tail"))
    order = Window.partitionBy("document_id").orderBy("section")
    near = merged.withColumns({"_prev": F.lag("tail").over(order), "_next": F.lead("head").over(order)})
    back = F.when(F.col("_next").isNull(), F.col("_prev").isNotNull()).when(F.col("_prev").isNull(), False).otherwise(V.cosine(F.col("head"), F.col("_prev")) > V.cosine(F.col("tail"), F.col("_next")))
    small = F.col("n") < least
    # A section begins anew unless it is small and goes back, or the one before it is small and comes forward.
    near = near.withColumns({"_back": small & back, "_ahead": small & ~back & F.col("_next").isNotNull()})
    starts = ~F.col("_back") & ~F.coalesce(F.lag("_ahead").over(order), F.lit(False))
    near = near.withColumn("_starts", starts).withColumn("part", F.sum(F.col("_starts").cast("int")).over(order))
    return near.groupBy("document_id", F.greatest("part", F.lit(1)).alias("section")).agg(F.min("first").alias("first_page"), F.max("last").alias("last_page"))


def resolution(entities: DataFrame, size: int = 60) -> tuple[DataFrame, DataFrame]:
    """Merges (type, batch, survivor, slug) and variants (type, parent, child) of entities within batches of one type.

    The offline stand-in for a model: entities whose sorted words are the same are one; one whose words all occur in
    another's, with more, is its parent. entities: slug, type, canonical. A batch has ``size`` entities, in order of slug.
    """
    rows = batches(entities.dropDuplicates(["type", "slug"]), ["type"], "slug", size)
    words = F.array_sort(F.array_distinct(T.tokens(F.col("canonical"))))
    rows = rows.withColumn("words", words).where(F.size("words") > 0)
    first = rows.groupBy("type", "batch", "words").agg(F.min("slug").alias("survivor"), F.count("*").alias("n")).where("n > 1")
    merges = rows.join(first, ["type", "batch", "words"]).where("slug <> survivor").select("type", "batch", "survivor", "slug")
    child = rows.select("type", "batch", F.col("slug").alias("child"), F.col("words").alias("_c"))
    pairs = rows.join(child, ["type", "batch"])  # at most ``size`` rows each
    inside = (F.size("words") < F.size("_c")) & (F.size(F.array_except("words", "_c")) == 0)
    return merges, pairs.where(inside).select("type", F.col("slug").alias("parent"), "child")


def promoted_tags(nodes: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """node_id, tags (canonical, distinct), and one row of counts: kept, changed and dropped tags. nodes: node_id, tags[]."""
    long = nodes.select("node_id", F.posexplode("tags").alias("at", "tag")).join(resolved, "tag", "left")
    good = F.col("canonical").isNotNull()
    listed = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(good, F.struct("at", "canonical")))), lambda x: x["canonical"]))
    kept = nodes.select("node_id").join(long.groupBy("node_id").agg(listed.alias("tags")), "node_id", "left")
    counts = long.agg(F.count_if(good & (F.col("canonical") == F.col("tag"))).alias("kept"), F.count_if(good & (F.col("canonical") != F.col("tag"))).alias("changed"), F.count_if(~good).alias("dropped"))
    return kept.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>"))), counts


def tag_terms(texts: DataFrame, terms: DataFrame, key: str, text: str, least: int = 20, fill: int = 50, most: int = 60) -> DataFrame:
    """key, terms: the ontology's terms that a text names as words, filled up with the first ones where there are few; sorted, at most ``most``.

    terms: term. Terms meet texts by word, so nothing is compared with every term.
    """
    words = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)))).alias("_w"))
    named = words.join(terms.select(F.lower("term").alias("_w"), "term").distinct(), "_w").groupBy(key).agg(F.collect_set("term").alias("named"))
    first = terms.select("term").distinct().orderBy("term").limit(fill).agg(F.collect_list("term").alias("first"))
    rows = texts.select(key).join(named, key, "left").withColumn("named", F.coalesce("named", F.array().cast("array<string>"))).crossJoin(F.broadcast(first))
    full = F.when(F.size("named") < least, F.array_union("named", "first")).otherwise(F.col("named"))
    return rows.select(key, F.slice(F.array_sort(full), 1, most).alias("terms"))


def read_tags(answers: DataFrame, terms: DataFrame) -> DataFrame:
    """key, tags: a tag service's answer (key, payload): its JSON, or else the quoted capitalised words that are terms."""
    parsed = T.repaired_json(F.col("payload"), "struct<sumo_tags:array<string>>")["sumo_tags"]
    quoted = F.regexp_extract_all("payload", F.lit('"([A-Z][a-zA-Z]+)"'), F.lit(1))
    rows = answers.withColumns({"_p": parsed, "_q": F.array_distinct(quoted)})
    long = rows.select("key", F.posexplode("_q").alias("at", "term")).join(terms.select("term").distinct(), "term", "left_semi")
    found = long.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "term"))), lambda x: x["term"]).alias("_f"))
    return rows.join(found, "key", "left").select("key", F.coalesce("_p", "_f", F.array().cast("array<string>")).alias("tags"))


def date_excerpts(documents: DataFrame, paragraphs: DataFrame, least: int = 50, most: int = 5) -> DataFrame:
    """document_id, excerpt of documents without a date: their first paragraphs of over ``least`` characters.

    What is sent to a provider in a backfill. documents: document_id, published; paragraphs: document_id, position, content.
    """
    todo = documents.where("published IS NULL").select("document_id")
    rows = paragraphs.where(F.length("content") > least).join(todo, "document_id", "left_semi")
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("document_id").orderBy("position"))).where(F.col("_k") <= most)
    joined = F.transform(F.array_sort(F.collect_list(F.struct("_k", "content"))), lambda x: x["content"])
    return rows.groupBy("document_id").agg(F.array_join(joined, "\n\n").alias("excerpt"))


def missing_embeddings(nodes: DataFrame, model: str) -> DataFrame:
    """Nodes whose embedding is null, or of another model. nodes: node_id, embedding, embedding_model."""
    return nodes.where(F.col("embedding").isNull() | ~F.col("embedding_model").eqNullSafe(F.lit(model)))


def cleanup(documents: DataFrame, owned: DataFrame, edges: DataFrame, jobs: DataFrame, now: Column, days: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What an upkeep run leaves: nodes whose document exists, edges between nodes that are left, jobs that aren't old and over.

    documents: node_id; owned: node_id, document_id; jobs: status, updated_at.
    """
    nodes = owned.join(documents.select(F.col("node_id").alias("document_id")).distinct(), "document_id", "left_semi").select(*owned.columns)
    ids = documents.select("node_id").unionByName(nodes.select("node_id")).distinct()
    left = edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi").select(*edges.columns)
    over = F.col("status").isin("completed", "failed") & (F.col("updated_at") < now - F.make_dt_interval(F.lit(days)))
    return nodes, left, jobs.where(~F.coalesce(over, F.lit(False)))
