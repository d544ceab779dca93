"""What an answer is made of: context, guidance, frontier, cards, sources; and the providers' parts with offline stand-ins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.config import DEFAULT, EngineConfig
from quillgraph.functions import text as T
from quillgraph.operators import search


def community_context(members: DataFrame, communities: DataFrame, slugs: DataFrame, most: int = 3) -> DataFrame:
    """label, hits, summary, member_count of the communities that most of a query's slugs are in, ties to the smaller label.

    members: slug, label; communities: label, summary, member_count; slugs: slug (a query's few).
    """
    hits = members.join(slugs.select("slug").distinct(), "slug", "left_semi").groupBy("label").agg(F.countDistinct("slug").alias("hits"))
    return hits.join(communities, "label").orderBy(F.desc("hits"), "label").limit(most)


def guided_sections(sections: DataFrame, documents: DataFrame, words: list[str], most: int = 5) -> DataFrame:
    """node_id, score of the sections whose title and summary hold most words of the query, of a few seed documents.

    The offline stand-in for a model that reads the section tree. sections: node_id, document_id, title, summary.
    """
    low = F.lower(F.concat_ws(" ", "title", "summary"))
    hits = reduce(lambda a, w: a + low.contains(w).cast("int"), words, F.lit(0))
    found = sections.join(documents.select("document_id").distinct(), "document_id", "left_semi").withColumn("score", hits / F.lit(float(max(len(words), 1))))
    return search.top(found.where("score > 0"), most).select("node_id", "score")


def subqueries(lexical: DataFrame, words: list[str], content: str = "content", most: int = 2) -> DataFrame:
    """word: a query's words that fewest of the first results hold, as follow-up queries (the offline stand-in for a model)."""
    held = lexical.agg(*[F.count_if(F.lower(F.col(content)).contains(w)).alias(f"_{k}") for k, w in enumerate(words)])
    rows = F.explode(F.array(*[F.struct(F.lit(w).alias("word"), F.col(f"_{k}").alias("n")) for k, w in enumerate(words)]))
    return held.select(rows.alias("r")).select("r.word", "r.n").orderBy("n", "word").limit(most)


def with_subqueries(first: DataFrame, more: list[DataFrame]) -> DataFrame:
    """The first results, and those of sub-queries that are new, the best score of each; order is part: 0 for the first."""
    rows = reduce(DataFrame.unionByName, [df.select("node_id", "score", F.lit(k).alias("part")) for k, df in enumerate([first, *more])])
    return rows.groupBy("node_id").agg(F.min(F.struct("part", (-F.col("score")).alias("m"))).alias("b")).select("node_id", (-F.col("b.m")).alias("score"), F.col("b.part").alias("part"))


def frontier(sources: dict[str, DataFrame], seen: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """node_id, source, score of candidates in the explorer's band that no tier has; a node may come from several sources.

    sources: cross-document, same-answer, Adamic-Adar and community candidates, each node_id, score and at most a few rows.
    """
    rows = reduce(DataFrame.unionByName, [df.select("node_id", F.lit(name).alias("source"), F.col("score").cast("double").alias("score")) for name, df in sources.items()])
    rows = rows.where((F.col("score") >= config.explorer_stop) & (F.col("score") < config.integrity_min))
    return rows.join(seen.select("node_id").distinct(), "node_id", "left_anti")


def stop_reason(principal: DataFrame, frontier_: DataFrame) -> str:
    if principal.isEmpty():
        return "no_principal_seeds"
    return "no_candidates_in_band" if frontier_.isEmpty() else "weight_below_threshold"


def gap_cards(entities: DataFrame, most: int = 10) -> DataFrame:
    """entity_name, entity_slug, reason, hint of isolated entities. entities: slug, name, isolated, isolation_reason."""
    rows = entities.where("isolated").orderBy("slug").limit(most)
    hint = F.concat(F.lit("Add documents about "), F.col("name"), F.lit(" to connect it"))
    return rows.select(F.col("name").alias("entity_name"), F.col("slug").alias("entity_slug"), F.coalesce("isolation_reason", F.lit("no connecting documents")).alias("reason"), hint.alias("hint"))


def connection_cards(edges: DataFrame, names: DataFrame, slugs: DataFrame, most_slugs: int = 15, most: int = 5) -> DataFrame:
    """from_slug, from_name, to_slug, to_name of surprising edges that leave the principal tier's entities.

    edges: src, dst, is_surprising; names: slug, name.
    """
    wanted = slugs.select("slug").distinct().orderBy("slug").limit(most_slugs)
    rows = edges.where("is_surprising").join(wanted.withColumnRenamed("slug", "src"), "src", "left_semi").select("src", "dst").distinct()
    name = lambda end, out: names.select(F.col("slug").alias(end), F.col("name").alias(out))
    rows = rows.join(name("src", "from_name"), "src").join(name("dst", "to_name"), "dst")
    return rows.orderBy("src", "dst").limit(most).select(F.col("src").alias("from_slug"), "from_name", F.col("dst").alias("to_slug"), "to_name")


def answer_sources(principal: DataFrame, results: DataFrame, most: int = 6, chars: int = 600) -> DataFrame:
    """n (from 1), node_id, excerpt, citation: what an answer is written from; the principal tier, or the results without one.

    Both: node_id, score, content. At most ``limit`` rows each, so the ranks are one small window.
    """
    both = principal.select("node_id", "score", "content", F.lit(0).alias("tier")).unionByName(results.select("node_id", "score", "content", F.lit(1).alias("tier")))
    rows = both.withColumn("_first", F.min("tier").over(Window.partitionBy())).where("tier = _first")
    rows = rows.withColumn("n", F.row_number().over(Window.orderBy(F.desc("score"), "node_id"))).where(F.col("n") <= most)
    return rows.select("n", "node_id", F.left("content", F.lit(chars)).alias("excerpt"), F.concat(F.lit("["), F.col("n").cast("string"), F.lit("]")).alias("citation"))


def synthesised(sources: DataFrame, question: str, provider) -> DataFrame:
    """payload: a provider's answer to the question from numbered excerpts; without excerpts there is none."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n", "citation", "excerpt"))), lambda x: F.concat(x["citation"], F.lit(" "), x["excerpt"]))
    prompt = sources.agg(F.count("*").alias("k"), F.array_join(lines, "\n").alias("body")).where("k > 0")
    return provider.answer(prompt.select(F.lit(question).alias("key"), F.concat(F.col("body"), F.lit("\n\n"), F.lit(question)).alias("prompt")))


def reranked(results: DataFrame, order: list, most: int = 5) -> DataFrame:
    """Results with the first ``most`` in a provider's order (node ids), if that is a permutation of them; else as they are.

    Adds rank, from 1.
    """
    by = Window.orderBy(F.desc("score"), "node_id")
    rows = results.withColumn("rank", F.row_number().over(by))  # at most ``limit`` rows
    first = [r["node_id"] for r in rows.where(F.col("rank") <= most).select("node_id").collect()]
    if not order or len(order) != len(set(order)) or set(order) != set(first):
        return rows
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("node_id")).cast("int")
    return rows.withColumn("rank", F.when(F.col("rank") <= most, place).otherwise(F.col("rank")))


def self_checked(results: DataFrame, keep: Column) -> DataFrame:
    """Results that a check lets through; where it would drop all, all stay."""
    marked = results.withColumn("_ok", F.coalesce(keep, F.lit(False))).withColumn("_any", F.max("_ok").over(Window.partitionBy()))
    return marked.where(F.col("_ok") | ~F.col("_any")).drop("_ok", "_any")


def verified(integrity: DataFrame, documents: DataFrame, holds: Column) -> DataFrame:
    """Integrity entries: those whose evidence spans two documents or more are checked, and fall if not principal.

    integrity: node_id, provenance, ...; documents: node_id, document_id of the evidence; holds: over integrity's columns.
    """
    spans = documents.groupBy("node_id").agg(F.countDistinct("document_id").alias("_docs"))
    rows = integrity.join(spans, "node_id", "left")
    checked = (F.coalesce("_docs", F.lit(1)) >= 2) & (F.col("provenance") != "principal")
    return rows.where(~checked | F.coalesce(holds, F.lit(False))).drop("_docs")


def web_results(hits: DataFrame) -> DataFrame:
    """node_id, score, title, url, ephemeral of a web search's answer (query_id, position from 0, title, url): each place a tenth less."""
    score = F.greatest(F.lit(0.0), 1.0 - 0.1 * F.col("position"))
    return hits.select("query_id", F.concat(F.lit("web/"), T.url_key(F.col("url"))).alias("node_id"), score.alias("score"), "title", "url", F.lit(True).alias("ephemeral"))


def agent(spark: SparkSession, question: str, tools: dict[str, Callable[[str], DataFrame]], policy: Callable[[str, list[str], list[str]], str | None], most: int = 4) -> tuple[DataFrame, list[str]]:
    """The best score of each node over at most so many tools, each used once, in the order that a policy picks; and the trace.

    policy(question, tools left, trace) names the next tool, or None to stop.
    """
    found, trace, left = None, [], sorted(tools)
    while left and len(trace) < most:
        pick = policy(question, left, trace)
        if pick not in left:
            break
        rows = tools[pick](question).select("node_id", "score")
        found = rows if found is None else found.unionByName(rows)
        trace.append(pick)
        left.remove(pick)
    empty = spark.createDataFrame([], "node_id string, score double")
    return (empty if found is None else found.groupBy("node_id").agg(F.max("score").alias("score"))), trace
