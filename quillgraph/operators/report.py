"""Summaries of runs, entities, contents and evaluations, and the joins they need."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usage(calls: DataFrame, by: list[str]) -> DataFrame:
    """Sums of token counts over calls (prompt_tokens, output_tokens, cached), and how many were answered from the cache."""
    return calls.groupBy(*by).agg(F.count("*").alias("n_calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count_if("cached").alias("n_cached"))


def ingestion_status(chunks: DataFrame) -> DataFrame:
    """document_id, n_chunks, n_failed, status from the chunks of each document (document_id, failed)."""
    rows = chunks.groupBy("document_id").agg(F.count("*").alias("n_chunks"), F.count_if("failed").alias("n_failed"))
    return rows.withColumn("status", F.when(F.col("n_failed") == 0, "complete").when(F.col("n_failed") < F.col("n_chunks"), "partial").otherwise("failed"))


def latest_diagnostics(runs: DataFrame, most: int = 10) -> DataFrame:
    """The latest runs, one row each with its sums. runs: run_id, at, n_nodes, n_dropped, seconds (a row for each document)."""
    rows = runs.groupBy("run_id").agg(F.max("at").alias("at"), F.count("*").alias("n_documents"), F.sum("n_nodes").alias("n_nodes"), F.sum("n_dropped").alias("n_dropped"), F.sum("seconds").alias("seconds"))
    return rows.orderBy(F.desc("at"), "run_id").limit(most)


def entity_index(entities: DataFrame) -> DataFrame:
    """type, n, names of the entities of each type, sorted without regard to case, then as they are."""
    named = entities.select("type", F.struct(F.lower("name").alias("k"), "name").alias("e")).distinct()
    return named.groupBy("type").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list("e")), lambda e: e["name"]).alias("names"))


def by_title(rows: DataFrame, title: str = "title") -> DataFrame:
    """Rows in the order of their titles as a reader expects it: case and accents don't count, then the title itself."""
    return rows.orderBy(F.collate(F.col(title), "UNICODE_CI_AI"), title)


def source_distribution(hits: DataFrame) -> DataFrame:
    """source, n, share of results by the phases that found them (node_id, sources[])."""
    rows = hits.select(F.explode("sources").alias("source")).groupBy("source").agg(F.count("*").alias("n"))
    return rows.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # one row a phase


def content_stats(paragraphs: DataFrame) -> DataFrame:
    """document_id, n, chars, empty_ratio, tag_coverage of a document's paragraphs (content, tags[])."""
    text = F.trim(F.coalesce("content", F.lit("")))
    tagged = F.coalesce(F.size("tags"), F.lit(0)) > 0
    share = lambda test: F.count_if(test) / F.count("*")
    return paragraphs.groupBy("document_id").agg(F.count("*").alias("n"), F.sum(F.length(text)).alias("chars"), share(text == "").alias("empty_ratio"), share(tagged).alias("tag_coverage"))


def weight_suggestions(feedback: DataFrame) -> DataFrame:
    """One row: n, accuracy (per cent) and what to change: parameter and its new value, by whether answers please too seldom or nearly always."""
    rows = feedback.agg(F.count("*").alias("n"), F.round(100.0 * F.count_if(F.col("signal") == "positive") / F.count("*"), 1).alias("accuracy"))
    change = lambda *pairs: F.map_from_arrays(F.array(*[F.lit(a) for a, _ in pairs]), F.array(*[F.lit(b) for _, b in pairs]))
    low, high = change(("weight.entity_pivot", 0.4), ("principal_percentile", 0.85)), change(("weight.cross_doc_edge", 0.6), ("expand_depth", 2.0))
    return rows.withColumn("changes", F.when(F.col("accuracy") < 50, low).when(F.col("accuracy") > 80, high).otherwise(F.create_map().cast("map<string,double>")))


def quality(per_query: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Principal hits, abstention on questions without an answer, document hits, and ranks within the right document.

    per_query: is_null, principal_hit, principal_count, doc_hit (null where unknown), oracle_rank (from 1 among the results
    of the right document, null without a hit). Rates without a question to count are null.
    """
    answerable, right = ~F.col("is_null"), F.col("doc_hit")
    rate = lambda test, of, name: F.try_divide(F.count_if(test & of), F.count_if(of)).alias(name)
    within = lambda k: rate(F.coalesce(F.col("oracle_rank") <= k, F.lit(False)), F.coalesce(right, F.lit(False)), f"oracle_hits_{k}")
    return per_query.groupBy(*(by or [])).agg(
        F.count("*").alias("n_queries"), rate(F.col("principal_hit"), answerable, "principal_hit_rate"), rate(F.col("principal_count") == 0, F.col("is_null"), "null_abstention"),
        rate(F.coalesce(right, F.lit(False)), right.isNotNull(), "doc_hits"), within(4), within(10),
    )


def normal_text(c):
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))


def title_matches(gold: DataFrame, manifest: DataFrame) -> DataFrame:
    """query_id, source_file of gold titles found in a manifest (title, source_file), by normalised title."""
    m = manifest.select(normal_text(F.col("title")).alias("_t"), "source_file").distinct()
    return gold.select("query_id", normal_text(F.col("title")).alias("_t")).join(m, "_t").select("query_id", "source_file").distinct()


def evidence_matches(results: DataFrame, evidence: DataFrame, least: int = 40, lead: int = 200) -> DataFrame:
    """query_id, node_id, evidence_id: a result's text holds the beginning of a piece of evidence, or the other way round.

    Results and evidence meet by query only, and both are few for a query. Evidence of at most ``least`` characters doesn't count.
    """
    e = evidence.select("query_id", "evidence_id", normal_text(F.col("evidence")).alias("_e")).where(F.length("_e") > least)
    r = results.select("query_id", "node_id", normal_text(F.col("content")).alias("_c")).where("_c <> ''")
    holds = F.col("_c").contains(F.left("_e", F.lit(lead))) | F.col("_e").contains(F.left("_c", F.lit(lead)))
    return r.join(e, "query_id").where(holds).select("query_id", "node_id", "evidence_id")


def document_key(column):
    """The key of a document handle, with or without its collection."""
    return F.element_at(F.split(column, "/"), -1)


def with_parents(results: DataFrame, documents: DataFrame, sections: DataFrame) -> DataFrame:
    """Results with the titles of their document and section. Handles are joined by key, whichever form they have.

    results: node_id, document_id, section_id; documents: key, title; sections: node_id, title, level.
    """
    d = documents.select(document_key(F.col("key")).alias("_d"), F.col("title").alias("document_title"))
    s = sections.select(F.col("node_id").alias("section_id"), F.col("title").alias("section_title"), F.col("level").alias("section_level"))
    return results.withColumn("_d", document_key(F.col("document_id"))).join(d, "_d", "left").join(s, "section_id", "left").drop("_d")


#: Mentions that one task holds, or about.
TASK_MENTIONS = 1 << 19


def back_references(mentions: DataFrame, paragraphs: DataFrame, titles: DataFrame) -> DataFrame:
    """slug, document_id, title, n_paragraphs of the documents that mention an entity.

    Rows are dealt by their paragraph, so many that a task's distinct ones fit into a fixed memory, and then counted once.
    """
    parts = max(mentions.sparkSession.sparkContext.defaultParallelism, -(-mentions.count() // TASK_MENTIONS))
    both = mentions.select("node_id", "slug").repartition(parts, "node_id").join(paragraphs.select("node_id", "document_id").repartition(parts, "node_id"), "node_id")
    rows = both.distinct().groupBy("slug", "document_id").agg(F.count("*").alias("n_paragraphs"))
    return rows.join(titles.select("document_id", "title"), "document_id", "left").select("slug", "document_id", "title", "n_paragraphs")


def in_tree_order(nodes: DataFrame) -> DataFrame:
    """Nodes of each document by position, level and key."""
    return nodes.orderBy("document_id", "doc_position", F.col("level").asc_nulls_last(), "node_id")


def page(rows: DataFrame, order: list, offset: int, size: int) -> tuple[DataFrame, DataFrame]:
    """A page of rows, and one row, full_count, of all of them."""
    return rows.orderBy(*order).offset(offset).limit(size), rows.agg(F.count("*").alias("full_count"))
