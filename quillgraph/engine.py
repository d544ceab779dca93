"""The retrieval engine: one query over a stored graph, as a composition of phases, fusion, time and tiers."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.config import DEFAULT, EngineConfig
from quillgraph.functions import temporal as TT
from quillgraph.functions import text as T
from quillgraph.operators import answer, fusion, graph, search, textindex
from quillgraph.state import written


@dataclass
class Graph:
    """A stored graph. paragraphs: node_id, document_id, content, tags[], types[], entity_slugs[], embedding[];
    documents: document_id, published, decay_class and, if known, coverage_start, coverage_end (dates); mentions: node_id, slug;
    similar: src, dst, weight; edges: src, dst, relation. The rest may be absent: hierarchy: child, parent; clusters:
    node_id, summary; questions: node_id, class_id; ties: slug, other, weight; members: slug, label; communities: label,
    summary, member_count; sections: node_id, document_id, title, summary; entities: slug, name, isolated,
    isolation_reason; related: src, dst, is_surprising (slugs). index: the stored text index of the paragraphs; without it
    the first phase reads all texts."""

    paragraphs: DataFrame
    documents: DataFrame
    mentions: DataFrame
    similar: DataFrame
    edges: DataFrame
    hierarchy: DataFrame | None = None
    clusters: DataFrame | None = None
    questions: DataFrame | None = None
    ties: DataFrame | None = None
    members: DataFrame | None = None
    communities: DataFrame | None = None
    sections: DataFrame | None = None
    entities: DataFrame | None = None
    related: DataFrame | None = None
    index: textindex.TextIndex | None = None


@dataclass(frozen=True)
class Query:
    """What is known of a query: its words, kind, mode, intent and years from its text; hints from the caller or a provider."""

    raw: str
    words: tuple[str, ...]
    mode: str
    intent: str
    tags: tuple[str, ...] = ()
    entities: tuple[str, ...] = ()
    vector: tuple[float, ...] = ()
    kind: str = "keyword"
    date_from: str | None = None
    date_to: str | None = None
    strict_dates: bool = False


def understand(spark: SparkSession, raw: str, **hints) -> Query:
    """The query's fingerprint by the offline rules; intent from key words is for queries of few words only."""
    q = F.lit(raw)
    row = spark.range(1).select(T.tokens(q).alias("w"), T.input_type(T.tokens(q)).alias("k"), T.query_mode(q).alias("m"), T.temporal_intent(q).alias("i"), T.date_range(q).alias("r")).first()
    known = {"kind": row["k"], "date_from": row["r"]["from"], "date_to": row["r"]["to"]}
    known |= {k: tuple(v) if isinstance(v, (list, tuple)) else v for k, v in hints.items()}
    return Query(raw, tuple(row["w"]), row["m"], row["i"], **known)


STRUCTURE = ["HAS_CHILD", "NEXT_SIBLING", "BELONGS_TO", "ADJACENT_TO", "NEXT_PARA"]


def _dated(graph_: Graph) -> DataFrame:
    none = F.lit(None).cast("date")
    docs = graph_.documents
    return docs.select("document_id", "published", "decay_class", *[F.col(c) if c in docs.columns else none.alias(c) for c in ("coverage_start", "coverage_end")])


def _lexical(graph_: Graph, query: Query, config: EngineConfig, subqueries: bool) -> DataFrame:
    """The first phase, within the query's years; at most a few times ``limit`` rows, which all other phases read, so they are written."""
    nodes = graph_.paragraphs.select("node_id", "document_id", "content")
    if not query.words:
        return nodes.select("node_id", "document_id", F.lit(0.0).alias("score")).limit(0)
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    keep = None
    if query.strict_dates and (query.date_from or query.date_to):
        nodes = nodes.join(_dated(graph_), "document_id", "left")
        keep = TT.in_window(text("published"), text("coverage_start"), text("coverage_end"), query.date_from, query.date_to)
    scan = lambda words, k: search.bm25_topk(nodes, words, k, keep, config)

    def stored(words: list[str], k: int) -> DataFrame:
        best = textindex.topk(nodes.sparkSession, graph_.index, words, 2 * k, config).join(nodes.drop("content"), "node_id")
        return search.top(best if keep is None else best.where(keep), k)

    find = lambda words, k: (scan if graph_.index is None else stored)(words, k).select("node_id", "document_id", "score")
    first = written(find(list(query.words), config.limit), "lexical")
    if subqueries:
        held = first.join(graph_.paragraphs.select("node_id", "content"), "node_id")
        words = [r["word"] for r in answer.subqueries(held, list(query.words)).collect()]  # two words
        more = answer.with_subqueries(first, [find([w], -(-config.limit // 2)) for w in words])
        first = written(more.join(graph_.paragraphs.select("node_id", "document_id"), "node_id").select("node_id", "document_id", "score"), "lexical")
    return first


def run(graph_: Graph, query: Query, as_of: str, config: EngineConfig = DEFAULT, subqueries: bool = False) -> dict[str, DataFrame]:
    """The answer to a query, lazily but for its first phase: results (fused, with time), and the tiers principal, integrity
    and explorer; and, where the graph has what they need, context (communities), gaps and connections (cards)."""
    nodes, limit = graph_.paragraphs, config.limit
    lexical = _lexical(graph_, query, config, subqueries)
    phases = {"fulltext": lexical}
    seeds = search.top(lexical, config.seed_rows)
    if query.tags and graph_.hierarchy is not None:
        wanted = F.col("tag").isin(list(query.tags))
        up = graph.ancestors(graph_.hierarchy, config.ontology_depth).where(wanted).groupBy("ancestor").agg(F.min("distance").alias("d"))
        weights = {r["ancestor"]: 1.0 / (r["d"] + 1) for r in up.collect()}  # ancestors of a query's few tags
        phases["sumo"] = search.tag_expansion(nodes, list(query.tags), weights, [], limit)
    slugs = graph_.mentions.join(seeds, "node_id", "left_semi").select("slug")
    if query.entities:
        slugs = slugs.unionByName(nodes.sparkSession.createDataFrame([(s,) for s in query.entities], "slug string"))
    slugs = written(slugs.distinct(), "slugs")  # of a few rows
    phases["entity_pivot"] = search.entity_pivot(graph_.mentions, slugs, lexical, limit, graph_.ties)
    tied = search.cross_document(graph_.similar, nodes, seeds, list(query.entities), config.cross_doc_limit, depth=config.expand_depth, tags=list(query.tags))
    phases["cross_doc_edge"] = tied
    if query.vector:
        phases["vector"] = search.vector_topk(nodes.select("node_id", "embedding"), list(query.vector), config.vector_limit)
    if graph_.questions is not None:
        phases["answers_same"] = search.answers_same(graph_.questions, seeds, lexical, -(-limit // 2))
    if graph_.clusters is not None and query.mode != "factoid" and query.words:
        phases["cluster_summary"] = search.cluster_summaries(graph_.clusters, list(query.words), -(-limit // 2))
    phases["structural"] = _structural(graph_, query, lexical, config)
    fused = fusion.fuse(fusion.contributions(phases, config.phase_weights(query.mode)))
    fused = written(fused.join(nodes.select("node_id", "document_id").join(_dated(graph_), "document_id"), "node_id", "left"), "fused")
    strong = fusion.principal(fused, config).select("node_id", F.lit(True).alias("_strong"))
    day = lambda year, end: F.to_date(F.lit(f"{year}-{end}")) if year and len(year) == 4 else F.to_date(F.lit(year))
    covered = TT.coverage(F.col("coverage_start"), F.col("coverage_end"), F.col("published"), day(query.date_from, "01-01"), day(query.date_to, "12-31"))
    time = TT.temporal_score(F.lit(query.intent), F.col("_strong"), F.col("raw_bm25"), F.col("decay_class"), F.col("published"), covered, F.to_date(F.lit(as_of)), config)
    fused = fused.join(strong, "node_id", "left").withColumn("temporal", time).drop("_strong")
    # Time counts as a contribution of its own where it adds something.
    fused = fused.withColumns({"score": F.col("score") + F.col("temporal"), "n_contributions": F.col("n_contributions") + (F.col("temporal") > 0).cast("int")})
    results = written(search.top(fused, limit), "results")
    return {"results": results} | _tiers(graph_, query, results, phases, config)


def _structural(graph_: Graph, query: Query, lexical: DataFrame, config: EngineConfig) -> DataFrame:
    """Neighbours of the best lexical node, and of the sections that the contents of the first documents point to.

    Where the query has tags, neighbours without any of them fall, but for guided ones.
    """
    nodes = graph_.paragraphs
    best = search.top(lexical, 1).select("node_id")
    near = lambda start: graph.traverse(graph_.edges, start, config.structural_depth, STRUCTURE, seen=lexical).select("node_id")
    rows = near(best).select("node_id", F.lit(False).alias("guided"))
    if graph_.sections is not None and query.kind != "keyword" and query.words:
        chosen = answer.guided_sections(graph_.sections, search.top(lexical, 3), list(query.words)).select("node_id")
        rows = rows.unionByName(near(chosen).select("node_id", F.lit(True).alias("guided")))
    rows = rows.groupBy("node_id").agg(F.max("guided").alias("guided")).join(nodes.select("node_id", "tags"), "node_id", "left")
    return fusion.corrective_filter(rows, list(query.tags), F.col("guided")).select("node_id", F.lit(1.0).alias("score")).orderBy("node_id").limit(config.limit)


def _tiers(graph_: Graph, query: Query, results: DataFrame, phases: dict[str, DataFrame], config: EngineConfig) -> dict[str, DataFrame]:
    chosen = written(fusion.principal(results, config), "principal")  # five rows, read by all below
    contradicts = graph_.edges.where("relation = 'CONTRADICTS'")
    near = graph_.edges.where(F.col("relation").isin(STRUCTURE))
    integrity = fusion.integrity(chosen.select("node_id"), near, phases["cross_doc_edge"], contradicts, config)
    own = written(graph_.mentions.join(chosen, "node_id", "left_semi").select("slug").distinct().orderBy("slug").limit(20), "slugs")
    seen = results.select("node_id").unionByName(integrity.select("node_id"))
    k = config.cross_doc_limit
    sources = {"cross_doc_edge": search.cross_document(graph_.similar, graph_.paragraphs, chosen, list(query.entities), k, depth=config.expand_depth + 1, tags=list(query.tags))}
    if graph_.questions is not None:
        sources["answers_same"] = search.answers_same(graph_.questions, chosen, seen, k, 0.4)
    if graph_.ties is not None:
        sources["adamic_adar"] = search.adamic_pivot(graph_.mentions, graph_.ties, own, seen, k)
    if graph_.members is not None:
        sources["community"] = search.community_pivot(graph_.mentions, graph_.members, own, seen, k)
    out = {"principal": chosen, "integrity": integrity, "explorer": answer.frontier(sources, seen, config)}
    if graph_.members is not None and graph_.communities is not None:
        out["context"] = answer.community_context(graph_.members, graph_.communities, own)
    if graph_.entities is not None:
        out["gaps"] = answer.gap_cards(graph_.entities)
        if graph_.related is not None:
            out["connections"] = answer.connection_cards(graph_.related, graph_.entities.select("slug", "name"), own)
    return out


def reason(graph_: Graph, query: Query, as_of: str, config: EngineConfig = DEFAULT) -> tuple[DataFrame, int]:
    """Runs again with the frontier's entities as hints until nothing improves; the best score of each node, and the rounds taken."""
    spark = graph_.paragraphs.sparkSession
    found, before, rounds = None, 0.0, 0
    for _ in range(config.reasoning_iterations):
        answer = run(graph_, query, as_of, config)["results"].select("node_id", "score")
        found = answer if found is None else fusion.best_of(found.unionByName(answer))
        rounds += 1
        rows = search.top(found, config.limit).collect()  # at most ``limit`` rows
        now = sum(r["score"] for r in rows) / max(len(rows), 1)
        if not rows or now - before < config.reasoning_delta:
            break
        before = now
        ids = spark.createDataFrame([(r["node_id"],) for r in rows], graph_.mentions.select("node_id").schema)
        slugs = graph_.mentions.join(F.broadcast(ids), "node_id", "left_semi").groupBy("slug").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "slug").limit(5)
        query = replace(query, entities=tuple(r["slug"] for r in slugs.collect()))
    return found, rounds
