"""Queries of answers and reports: context, guidance, frontier, cards, sources, evaluation, usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph import engine
from quillgraph.functions import temporal as TT
from quillgraph.operators import answer, evaluate, fusion, graph, report, search, textindex
from quillgraph.plans.admin import _gold, _ranked
from quillgraph.plans.graphs import PARTS, SECT
from quillgraph.plans.retrieval import BM25, DOCS, OVERLAP, TERMS
from quillgraph.sources import adapters as A


def _mentions(spark, d):
    """Orders mention the suppliers of their lines."""
    return A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("node_id"), F.col("l_suppkey").alias("slug"))


def _members(spark, d):
    return A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("slug"), F.col("s_nationkey").alias("label"))


def lenient_window(spark, d):
    """Orders as documents: dates, coverage of a year, and some undated."""
    o = A.table(spark, d, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    published = F.when(F.col("o_orderstatus") != "P", day)
    start = F.when(F.col("o_orderpriority").startswith("1"), day)
    end = F.when(F.col("o_orderpriority").startswith("1"), F.date_format(F.date_add(F.to_date("o_orderdate"), 365), "yyyy-MM-dd"))
    keep = lambda strict: TT.in_window(published, start, end, "1996", "1998", strict)
    return o.select("o_orderkey", keep(False).alias("lenient"), keep(True).alias("strict"))


def community_context(spark, d):
    members = _members(spark, d)
    sizes = members.groupBy("label").agg(F.count("*").alias("member_count"))
    communities = sizes.join(A.table(spark, d, "nation").select(F.col("n_nationkey").alias("label"), F.col("n_name").alias("summary")), "label")
    wanted = A.table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("slug"))
    return answer.community_context(members, communities, wanted)


def guided_sections(spark, d):
    s = A.sections(spark, d).select(F.concat_ws("-", "page_id", "pos").alias("node_id"), F.col("page_id").alias("document_id"), "title", F.lit(None).cast("string").alias("summary"))
    return answer.guided_sections(s, s.select("document_id"), TERMS).select("node_id", F.round("score", 6).alias("score"))


def subqueries(spark, d):
    return answer.subqueries(A.documents(spark, d).select("content"), TERMS)


def subquery_union(spark, d):
    c = A.table(spark, d, "customer").select(F.col("c_custkey").alias("node_id"), F.col("c_acctbal").alias("score"), "c_mktsegment", "c_nationkey")
    more = [search.top(c.where(F.col("c_nationkey") == n), 10) for n in (1, 2)]
    return answer.with_subqueries(search.top(c.where("c_mktsegment = 'BUILDING'"), 20), more)


def frontier(spark, d):
    """Candidates by ties of suppliers, by their nations, and by the price of an order."""
    mentions, wanted = _mentions(spark, d), A.table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("slug"))
    ties = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("slug"), (F.col("s_suppkey") + 1).alias("other"), (F.col("s_suppkey") % 10 / 10).alias("weight"))
    seen = A.table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("node_id"))
    priced = search.top(A.table(spark, d, "orders").select(F.col("o_orderkey").alias("node_id"), (F.col("o_totalprice") / 1000000).alias("score")), 50)
    found = {"adamic_adar": search.adamic_pivot(mentions, ties, wanted, seen, 50), "community": search.community_pivot(mentions, _members(spark, d), wanted, seen, 50), "cross_document": priced}
    return answer.frontier(found, seen).select("node_id", "source", F.round("score", 6).alias("score"))


def gap_cards(spark, d):
    part = A.table(spark, d, "part").select(F.col("p_partkey").alias("node_id"), "p_name")
    flags = graph.isolation(part, A.part_neighbours(spark, d), 40).join(part, "node_id")
    return answer.gap_cards(flags.select(F.col("node_id").alias("slug"), F.col("p_name").alias("name"), "isolated", F.lit(None).cast("string").alias("isolation_reason"))).select("entity_slug", "entity_name", "reason")


def connection_cards(spark, d):
    part = A.table(spark, d, "part")
    edges = graph.surprising(A.part_neighbours(spark, d), part.select(F.col("p_partkey").alias("node_id"), F.col("p_type").alias("label")))
    names = part.select(F.col("p_partkey").alias("slug"), F.col("p_name").alias("name"))
    return answer.connection_cards(edges, names, part.where("p_brand = 'Brand#12'").select(F.col("p_partkey").alias("slug")))


def answer_sources(spark, d):
    found = search.term_overlap(A.documents(spark, d).select("node_id", "content"), TERMS, 20)
    rows = answer.answer_sources(found.where("score >= 0.99"), found)
    return rows.select("n", "node_id", F.md5("excerpt").alias("digest"), "citation")


def reranked(spark, d):
    """The five first customers in the order of their keys, as a reranker might return them."""
    found = search.top(A.table(spark, d, "customer").select(F.col("c_custkey").alias("node_id"), F.col("c_acctbal").alias("score")), 20)
    return answer.reranked(found, sorted(r["node_id"] for r in search.top(found, 5).collect())).select("node_id", "rank")


def integrity_tier(spark, d):
    """The five first customers, their orders, and suppliers of high balance; customers of one nation are contradicted."""
    c = A.table(spark, d, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("node_id"), F.col("c_acctbal").alias("score"), "c_nationkey")
    strong = A.table(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("node_id"), (F.col("s_acctbal") / 10000).alias("score"))
    against = c.where("c_nationkey % 2 = 0").select(F.lit("X").alias("src"), F.col("node_id").alias("dst"))
    return fusion.integrity(search.top(c, 5), A.hierarchy(spark, d), strong, against)


def corrective_rows(spark, d):
    rows = A.table(spark, d, "part").select("p_partkey", "p_size", F.array("p_brand", "p_type").alias("tags"))
    return fusion.corrective_filter(rows, ["Brand#12", "Brand#34"], F.col("p_size") > 45).select("p_partkey")


def verified_rows(spark, d):
    evidence = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("node_id"), F.col("l_suppkey").alias("document_id"))
    rows = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("node_id"), F.when(F.col("o_orderstatus") == "F", "principal").otherwise("structural").alias("provenance"), "o_totalprice")
    return answer.verified(rows, evidence, F.col("o_totalprice") > 100000).select("node_id")


def web_results(spark, d):
    pages = A.table(spark, d, "pages")
    hits = pages.select((F.col("page_id") % 20).alias("query_id"), F.floor(F.col("page_id") / 20).alias("position"), F.lit("t").alias("title"), "url")
    return answer.web_results(hits).select("query_id", "node_id", F.round("score", 6).alias("score"))


def _per_query(spark, d):
    o = A.table(spark, d, "orders")
    doc_hit = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") > 150000)
    rank = F.when(F.col("o_custkey") % 4 > 0, F.col("o_custkey") % 12 + 1)
    return o.select((F.left("o_orderpriority", F.lit(1)) == "5").alias("is_null"), (F.col("o_orderstatus") == "F").alias("principal_hit"), (F.col("o_custkey") % 3).alias("principal_count"), doc_hit.alias("doc_hit"), rank.alias("oracle_rank"), F.col("o_orderstatus").alias("question_type"))


def eval_quality(spark, d):
    rates = ("principal_hit_rate", "null_abstention", "doc_hits", "oracle_hits_4", "oracle_hits_10")
    return report.quality(_per_query(spark, d), ["question_type"]).select("question_type", "n_queries", *[F.round(c, 6).alias(c) for c in rates])


def recall_at(spark, d):
    m = evaluate.recall_at(evaluate.hit_ranks(_ranked(spark, d), _gold(spark, d), 20))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


def weight_suggestions(spark, d):
    found = report.weight_suggestions(A.feedback(spark, d))
    listed = F.transform(F.array_sort(F.map_entries("changes")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return found.select("n", "accuracy", F.array_join(listed, ",").alias("changes"))


def usage_sums(spark, d):
    calls = A.table(spark, d, "events").select("event_type", F.col("user_id").alias("prompt_tokens"), F.length("props").cast("long").alias("output_tokens"), (F.col("value") > 20).alias("cached"))
    return report.usage(calls, ["event_type"])


def ingestion_status(spark, d):
    chunks = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), (F.col("l_returnflag") == "R").alias("failed"))
    return report.ingestion_status(chunks)


def diagnostics_latest(spark, d):
    runs = A.table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("run_id"), F.col("ts").alias("at"), F.col("user_id").alias("n_nodes"), F.length("props").alias("n_dropped"), F.lit(1).alias("seconds"))
    return report.latest_diagnostics(runs).select("run_id", "n_documents", "n_nodes", "n_dropped", "seconds")


def entity_index(spark, d):
    found = report.entity_index(A.table(spark, d, "customer").select(F.col("c_mktsegment").alias("type"), F.col("c_name").alias("name")))
    return found.select("type", "n", F.md5(F.array_join("names", ",")).alias("digest"))


def title_order(spark, d):
    """Nations in a reader's order of their names, numbered."""
    n = report.by_title(A.table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("title")))
    return n.agg(F.collect_list("n_nationkey").alias("k")).select(F.posexplode("k").alias("place", "n_nationkey"))


def source_distribution(spark, d):
    hits = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("node_id"), F.array("o_orderpriority", "o_orderstatus").alias("sources"))
    return report.source_distribution(hits).select("source", "n", F.round("share", 6).alias("share"))


def content_stats(spark, d):
    paras = A.paragraphs(spark, d).select(F.col("doc_id").alias("document_id"), "content", F.when(F.col("pos") == 0, F.array(F.lit("t"))).alias("tags"))
    found = report.content_stats(paras)
    return found.select("document_id", "n", "chars", F.round("empty_ratio", 6).alias("empty_ratio"), F.round("tag_coverage", 6).alias("tag_coverage"))


def parent_titles(spark, d):
    """Lines with the priority of their order and the name of their supplier; order handles come with and without a collection."""
    key = F.col("l_orderkey").cast("string")
    rows = A.table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("node_id"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("documents/"), key)).otherwise(key).alias("document_id"), F.col("l_suppkey").alias("section_id"))
    docs = A.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderpriority").alias("title"))
    sections = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("node_id"), F.col("s_name").alias("title"), F.lit(1).alias("level"))
    return report.with_parents(rows, docs, sections).select("node_id", "document_title", "section_title")


def gold_titles(spark, d):
    part = A.table(spark, d, "part")
    gold = part.select((F.col("p_partkey") % 50).alias("query_id"), F.concat(F.lit(" "), F.upper("p_name")).alias("title"))
    return report.title_matches(gold, part.select(F.replace("p_name", F.lit(" "), F.lit("  ")).alias("title"), F.col("p_brand").alias("source_file")))


def back_references(spark, d):
    orders = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("node_id"), F.col("o_custkey").alias("document_id"))
    titles = A.table(spark, d, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("title"))
    return report.back_references(_mentions(spark, d), orders, titles)


def full_count(spark, d):
    rows, total = report.page(A.table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 40, 20)
    return rows.crossJoin(F.broadcast(total)).select("o_orderkey", "full_count")  # one row


def engine_answer(spark, d):
    """The whole engine over documents as paragraphs: their words as entities, sources as tags and neighbours in doc_id as edges."""
    docs = A.documents(spark, d)
    none = F.array().cast("array<string>")
    paragraphs = docs.select("node_id", F.col("node_id").alias("document_id"), "content", F.array("source").alias("tags"), none.alias("types"), none.alias("entity_slugs"), F.lit(None).cast("array<double>").alias("embedding"))
    pairs = docs.select(F.col("node_id").alias("src"), (F.col("node_id") + 1).alias("dst"))
    stored = engine.Graph(
        paragraphs, docs.select(F.col("node_id").alias("document_id"), "published", "decay_class"), A.mentions(spark, d),
        pairs.withColumn("weight", F.col("src") % 10 / 10.0), pairs.withColumn("relation", F.lit("NEXT_PARA")),
        questions=docs.select("node_id", F.col("file_hash").alias("class_id")),
        index=textindex.stored(docs.select("node_id", "content"), f"documents of {d}"),
    )
    query = engine.understand(spark, "latest " + " ".join(TERMS))
    return engine.run(stored, query, "2025-01-01")["results"].select("node_id", F.round("score", 6).alias("score"), "n_contributions", F.array_join("sources", ",").alias("sources"))


QUERIES = {f.__name__: f for f in (lenient_window, community_context, guided_sections, subqueries, subquery_union, frontier, gap_cards, connection_cards, answer_sources, reranked, integrity_tier, corrective_rows, verified_rows, web_results, eval_quality, recall_at, weight_suggestions, usage_sums, ingestion_status, diagnostics_latest, entity_index, title_order, source_distribution, content_stats, parent_titles, gold_titles, back_references, full_count, engine_answer)}

_held = " + ".join(f"contains(lower(title), '{t}')::INT" for t in TERMS)
_key = "replace(translate(base64(encode(url)), '+/', '-_'), '=', '')"
_nt = r"trim(regexp_replace(lower({x}), '\s+', ' ', 'g'))"

ORACLE = {
    "lenient_window": """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d') END AS p, CASE WHEN o_orderpriority LIKE '1%' THEN strftime(o_orderdate, '%Y-%m-%d') END AS a, CASE WHEN o_orderpriority LIKE '1%' THEN strftime(o_orderdate::DATE + 365, '%Y-%m-%d') END AS b FROM orders),
t AS (SELECT o_orderkey, p IS NULL AND a IS NULL AND b IS NULL AS u, coalesce(p >= '1996', false) OR coalesce(b >= '1996', false) AS lo, coalesce(p <= '1998', false) OR coalesce(a <= '1998', false) AS hi FROM o) SELECT o_orderkey, (u OR lo) AND (u OR hi) AS lenient, lo AND hi AS strict FROM t""",
    "community_context": "WITH h AS (SELECT s_nationkey AS label, count(*) AS hits FROM supplier WHERE s_acctbal < 0 GROUP BY 1), c AS (SELECT s_nationkey AS label, count(*) AS member_count FROM supplier GROUP BY 1) SELECT label, hits, member_count, n_name AS summary FROM h JOIN c USING (label) JOIN nation ON n_nationkey = label ORDER BY hits DESC, label LIMIT 3",
    "guided_sections": f"WITH {SECT}, q AS (SELECT page_id || '-' || pos AS node_id, ({_held}) / 5.0::DOUBLE AS score FROM sec) SELECT node_id, round(score, 6) AS score FROM q WHERE score > 0 ORDER BY q.score DESC, node_id LIMIT 5",
    "subqueries": "WITH q AS (" + " UNION ALL ".join(f"SELECT '{t}' AS word, count(*) FILTER (WHERE contains(lower(text), '{t}')) AS n FROM documents" for t in TERMS) + ") SELECT word, n FROM q ORDER BY n, word LIMIT 2",
    "subquery_union": "WITH p AS (SELECT * FROM (SELECT c_custkey, c_acctbal, 0 AS part FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 20) UNION ALL SELECT * FROM (SELECT c_custkey, c_acctbal, 1 FROM customer WHERE c_nationkey = 1 ORDER BY c_acctbal DESC, c_custkey LIMIT 10) UNION ALL SELECT * FROM (SELECT c_custkey, c_acctbal, 2 FROM customer WHERE c_nationkey = 2 ORDER BY c_acctbal DESC, c_custkey LIMIT 10)) SELECT c_custkey AS node_id, any_value(c_acctbal) AS score, min(part) AS part FROM p GROUP BY 1",
    "frontier": """WITH q AS (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier WHERE s_acctbal < 0), seen AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'P'),
a AS (SELECT l_orderkey AS node_id, max(w) * 0.4::DOUBLE AS score FROM lineitem JOIN (SELECT k + 1 AS o, k % 10 / 10.0::DOUBLE AS w FROM q WHERE k % 10 >= 5) ON o = l_suppkey WHERE l_orderkey NOT IN (SELECT k FROM seen) GROUP BY 1 ORDER BY score DESC, node_id LIMIT 50),
c AS (SELECT DISTINCT l_orderkey AS node_id FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey IN (SELECT n FROM q) AND s_suppkey NOT IN (SELECT k FROM q) AND l_orderkey NOT IN (SELECT k FROM seen) ORDER BY 1 LIMIT 50),
p AS (SELECT o_orderkey AS node_id, o_totalprice / 1000000 AS score FROM orders ORDER BY 2 DESC, 1 LIMIT 50), u AS (SELECT node_id, 'adamic_adar' AS source, score FROM a UNION ALL SELECT node_id, 'community', 0.35::DOUBLE FROM c UNION ALL SELECT node_id, 'cross_document', score FROM p)
SELECT node_id, source, round(score, 6) AS score FROM u WHERE u.score >= 0.15::DOUBLE AND u.score < 0.6::DOUBLE AND node_id NOT IN (SELECT k FROM seen)""",
    "gap_cards": f"WITH {PARTS}, e AS (SELECT src AS k FROM pn UNION ALL SELECT dst FROM pn), n AS (SELECT k, count(*) AS c FROM e GROUP BY k) SELECT p_partkey AS entity_slug, p_name AS entity_name, 'no connecting documents' AS reason FROM part LEFT JOIN n ON k = p_partkey WHERE coalesce(c, 0) < 40 ORDER BY 1 LIMIT 10",
    "connection_cards": f"WITH {PARTS}, s AS (SELECT p_partkey AS k FROM part WHERE p_brand = 'Brand#12' ORDER BY 1 LIMIT 15) SELECT DISTINCT src AS from_slug, a.p_name AS from_name, dst AS to_slug, b.p_name AS to_name FROM pn JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst WHERE src IN (SELECT k FROM s) AND a.p_type <> b.p_type ORDER BY from_slug, to_slug LIMIT 5",
    "answer_sources": f"WITH {DOCS}, {OVERLAP}, f AS (SELECT node_id, score FROM ov WHERE score > 0 ORDER BY score DESC, node_id LIMIT 20), g AS (SELECT * FROM f WHERE score >= 0.99::DOUBLE OR NOT EXISTS (SELECT 1 FROM f WHERE score >= 0.99::DOUBLE)), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, node_id) AS n FROM g) SELECT n, node_id, md5(left(content, 600)) AS digest, '[' || n || ']' AS citation FROM r JOIN docs USING (node_id) WHERE n <= 6",
    "reranked": "WITH r AS (SELECT c_custkey AS node_id, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer) SELECT node_id, CASE WHEN k <= 5 THEN row_number() OVER (PARTITION BY k <= 5 ORDER BY node_id) ELSE k END AS rank FROM r WHERE k <= 20",
    "integrity_tier": """WITH c AS (SELECT c_custkey AS k, 'C' || c_custkey AS node_id, c_nationkey FROM customer ORDER BY c_acctbal DESC, node_id LIMIT 5),
r AS (SELECT node_id, 'principal' AS provenance FROM c UNION ALL SELECT 'O' || o_orderkey, 'structural' FROM orders JOIN c ON o_custkey = k UNION ALL SELECT 'S' || s_suppkey, 'cross_document' FROM supplier WHERE s_acctbal / 10000 >= 0.6::DOUBLE)
SELECT node_id, provenance, provenance = 'principal' AND node_id IN (SELECT node_id FROM c WHERE c_nationkey % 2 = 0) AS contradicted FROM r""",
    "corrective_rows": "SELECT p_partkey FROM part WHERE p_size > 45 OR p_brand IN ('Brand#12', 'Brand#34')",
    "verified_rows": "WITH s AS (SELECT l_orderkey AS k, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1) SELECT o_orderkey AS node_id FROM orders LEFT JOIN s ON k = o_orderkey WHERE coalesce(n, 1) < 2 OR o_orderstatus = 'F' OR o_totalprice > 100000",
    "web_results": f"SELECT page_id % 20 AS query_id, 'web/' || {_key} AS node_id, round(greatest(0.0::DOUBLE, 1.0::DOUBLE - 0.1::DOUBLE * (page_id // 20)), 6) AS score FROM pages",
    "eval_quality": """WITH q AS (SELECT o_orderstatus AS question_type, o_orderpriority LIKE '5%' AS z, o_orderstatus = 'F' AS h, o_custkey % 3 AS c, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice > 150000 END AS d, CASE WHEN o_custkey % 4 > 0 THEN o_custkey % 12 + 1 END AS r FROM orders)
SELECT question_type, count(*) AS n_queries, round(count(*) FILTER (WHERE h AND NOT z) / nullif(count(*) FILTER (WHERE NOT z), 0)::DOUBLE, 6) AS principal_hit_rate, round(count(*) FILTER (WHERE c = 0 AND z) / nullif(count(*) FILTER (WHERE z), 0)::DOUBLE, 6) AS null_abstention,
 round(count(*) FILTER (WHERE d) / nullif(count(d), 0)::DOUBLE, 6) AS doc_hits, round(count(*) FILTER (WHERE d AND r <= 4) / nullif(count(*) FILTER (WHERE d), 0)::DOUBLE, 6) AS oracle_hits_4, round(count(*) FILTER (WHERE d AND r <= 10) / nullif(count(*) FILTER (WHERE d), 0)::DOUBLE, 6) AS oracle_hits_10 FROM q GROUP BY 1""",
    "recall_at": """WITH gold AS (SELECT DISTINCT o_custkey % 50 AS query_id, o_orderkey % 30 AS node_id FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'),
rk AS (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM (SELECT o_custkey % 50 AS query_id, o_orderkey % 30 AS node_id, max(o_totalprice) AS score FROM orders GROUP BY 1, 2)),
q AS (SELECT g.query_id, count(*) AS n, """ + ", ".join(f"count(*) FILTER (WHERE rank <= {k}) AS r{k}" for k in (1, 5, 10, 20)) + " FROM gold g LEFT JOIN rk USING (query_id, node_id) GROUP BY 1) SELECT " + ", ".join(f"round(avg(r{k} / n::DOUBLE), 6) AS recall_{k}" for k in (1, 5, 10, 20)) + " FROM q",
    "weight_suggestions": "WITH f AS (SELECT event_type = 'purchase' AS p FROM events WHERE event_type IN ('purchase', 'error')), a AS (SELECT count(*) AS n, round(100.0::DOUBLE * count(*) FILTER (WHERE p) / count(*), 1) AS accuracy FROM f) SELECT n, accuracy, CASE WHEN accuracy < 50 THEN 'principal_percentile=0.85,weight.entity_pivot=0.4' WHEN accuracy > 80 THEN 'expand_depth=2.0,weight.cross_doc_edge=0.6' ELSE '' END AS changes FROM a",
    "usage_sums": "SELECT event_type, count(*) AS n_calls, sum(user_id)::BIGINT AS prompt_tokens, sum(length(props))::BIGINT AS output_tokens, count(*) FILTER (WHERE value > 20) AS n_cached FROM events GROUP BY 1",
    "ingestion_status": "SELECT l_orderkey AS document_id, count(*) AS n_chunks, count(*) FILTER (WHERE l_returnflag = 'R') AS n_failed, CASE WHEN count(*) FILTER (WHERE l_returnflag = 'R') = 0 THEN 'complete' WHEN count(*) FILTER (WHERE l_returnflag = 'R') < count(*) THEN 'partial' ELSE 'failed' END AS status FROM lineitem GROUP BY 1",
    "diagnostics_latest": "SELECT strftime(ts, '%Y-%m-%d') AS run_id, count(*) AS n_documents, sum(user_id)::BIGINT AS n_nodes, sum(length(props))::BIGINT AS n_dropped, count(*) AS seconds FROM events GROUP BY 1 ORDER BY max(ts) DESC, 1 LIMIT 10",
    "entity_index": "SELECT c_mktsegment AS type, count(DISTINCT c_name) AS n, md5(string_agg(DISTINCT c_name, ',' ORDER BY c_name)) AS digest FROM customer GROUP BY 1",
    "title_order": "SELECT (row_number() OVER (ORDER BY lower(n_name), n_name) - 1)::INT AS place, n_nationkey FROM nation",
    "source_distribution": "WITH s AS (SELECT unnest([o_orderpriority, o_orderstatus]) AS source FROM orders) SELECT source, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM s GROUP BY 1",
    "content_stats": "WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents) SELECT doc_id AS document_id, count(*) AS n, sum(length(trim(content)))::BIGINT AS chars, round(count(*) FILTER (WHERE trim(content) = '') / count(*)::DOUBLE, 6) AS empty_ratio, round(count(*) FILTER (WHERE pos = 0) / count(*)::DOUBLE, 6) AS tag_coverage FROM p GROUP BY 1",
    "parent_titles": "SELECT l_orderkey || '-' || l_linenumber AS node_id, o_orderpriority AS document_title, s_name AS section_title FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN supplier ON s_suppkey = l_suppkey",
    "gold_titles": f"WITH g AS (SELECT p_partkey % 50 AS query_id, {_nt.format(x='p_name')} AS t FROM part), m AS (SELECT DISTINCT {_nt.format(x='p_name')} AS t, p_brand AS source_file FROM part) SELECT DISTINCT query_id, source_file FROM g JOIN m USING (t)",
    "back_references": "SELECT l_suppkey AS slug, o_custkey AS document_id, any_value(c_name) AS title, count(DISTINCT o_orderkey) AS n_paragraphs FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2",
    "full_count": "SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS full_count FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40",
}
