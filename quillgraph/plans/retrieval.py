"""Retrieval queries: lexical, tags, entities, vectors, time, fusion and tiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.config import DEFAULT
from quillgraph.functions import temporal as TT
from quillgraph.functions import text as T
from quillgraph.operators import fusion, graph, search
from quillgraph.sources import adapters as A

TERMS = ["ere", "anth", "aux", "den", "reat"]
AS_OF = "2025-01-01"
VECTOR = [((k * 37) % 64 - 31.5) / 32 for k in range(64)]


def _r(c: str, n: int = 6):
    return F.round(F.col(c), n).alias(c)


def _nodes(spark, d):
    return A.documents(spark, d).select("node_id", "content", "published", "decay_class")


def bm25_topk(spark, d):
    return search.bm25_topk(_nodes(spark, d), TERMS, DEFAULT.limit).select("node_id", _r("score"))


def date_filter_bm25(spark, d):
    keep = TT.in_window(F.date_format("published", "yyyy-MM-dd"), F.lit(None).cast("string"), F.lit(None).cast("string"), "2000", "2010")
    return search.bm25_topk(_nodes(spark, d), TERMS, DEFAULT.limit, keep).select("node_id", _r("score"))


def term_overlap(spark, d):
    return search.term_overlap(_nodes(spark, d), TERMS, DEFAULT.limit).select("node_id", _r("score"))


def entity_pivot(spark, d):
    slugs = A.mentions(spark, d).groupBy("slug").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "slug").limit(8).select("slug")
    seen = search.bm25_topk(_nodes(spark, d), TERMS, DEFAULT.seed_rows)
    return search.entity_pivot(A.mentions(spark, d), slugs, seen, DEFAULT.limit).select("node_id", _r("score"))


def vector_topk(spark, d):
    nodes = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("node_id"), "embedding")
    return search.vector_topk(nodes, VECTOR, DEFAULT.vector_limit).select("node_id", _r("score", 5))


def vector_mean(spark, d):
    rows = A.table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    return rows.groupBy("label", "dim").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


def sumo_expansion(spark, d):
    up = graph.ancestors(A.type_ontology(spark, d).where("parent <> child"), DEFAULT.ontology_depth)
    tags = up.groupBy(F.col("tag").alias("node_id")).agg(F.array_sort(F.collect_set("ancestor")).alias("tags"))
    nodes = tags.where("node_id LIKE 'P%'").withColumn("types", F.array().cast("array<string>"))
    return search.tag_expansion(nodes, ["Brand#2"], {"Thing": 1 / 3, "Brand#1": 0.5}, [], 40).select("node_id", _r("score"))


def cross_doc_expand(spark, d):
    sets = A.table(spark, d, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_nationkey").alias("n"))
    similar = A.table(spark, d, "nation").select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") + 1) % 25).alias("dst"), (F.col("n_nationkey") / 25.0).alias("weight"))
    slug = F.concat(F.lit("s"), (F.col("document_id") % 7).cast("string"))
    paras = sets.select(F.col("document_id").alias("node_id"), F.col("n").alias("document_id"), F.array(slug).alias("entity_slugs"))
    seeds = A.table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("document_id"))
    return search.cross_document(similar, paras, seeds, ["s1", "s3"], 50).select("node_id", _r("score"), "overlap")


def answers_same(spark, d):
    """Messages of equal normalised text answer the same question: the class of each, and how many others it has."""
    turns = A.table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("node_id"), T.question_key(F.col("text")).alias("key")).where("length(key) > 0")
    return search.question_classes(turns).select("node_id", "class_id", "n_others")


def decay_score(spark, d):
    orders = A.table(spark, d, "orders")
    days = F.datediff(F.to_date(F.lit(AS_OF)), F.to_date("o_orderdate"))
    rows = orders.withColumn("klass", F.when(F.col("o_orderpriority").startswith("1"), "CURRENT").when(F.col("o_orderpriority").startswith("2"), "EVERGREEN").otherwise("SCHOLARLY"))
    return rows.select("o_orderkey", F.round(F.exp(-TT.decay_rate(F.col("klass")) * days), 6).alias("decay"), F.round(1 - F.exp(-F.lit(DEFAULT.age_lambda) * days), 6).alias("authority"))


def coverage_overlap(spark, d):
    orders = A.table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    covered = TT.coverage(F.col("day"), F.date_add("day", 365), F.lit(None).cast("date"), F.to_date(F.lit("1997-01-01")), F.to_date(F.lit("1999-01-01")))
    return orders.select("o_orderkey", F.round(covered, 6).alias("coverage"))


def temporal_scores(spark, d):
    docs = A.documents(spark, d)
    score = TT.temporal_score(F.when(F.col("lang") == "en", "current_state").when(F.col("lang") == "fr", "historical_fact").otherwise("none"), F.lit(False), F.when(F.col("source") == "src3", 9.0).otherwise(1.0), F.col("decay_class"), F.col("published"), F.lit(0.0), F.to_date(F.lit(AS_OF)))
    return docs.select("node_id", F.round(score, 6).alias("temporal"))


def _phases(spark, d):
    nodes = _nodes(spark, d)
    lexical = search.bm25_topk(nodes, TERMS, 200)
    overlap = search.term_overlap(nodes, TERMS, 200)
    slugs = A.mentions(spark, d).groupBy("slug").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "slug").limit(8).select("slug")
    pivot = search.entity_pivot(A.mentions(spark, d), slugs, None, 200)
    return fusion.contributions({"fulltext": lexical, "cluster_summary": overlap, "entity_pivot": pivot}, DEFAULT.phase_weights("synthesis"))


def fused_search(spark, d):
    return fusion.fuse(_phases(spark, d)).select("node_id", _r("score"), "n_contributions", _r("raw_bm25"), F.array_join("sources", ",").alias("sources"))


def principal_tier(spark, d):
    fused = fusion.fuse(_phases(spark, d)).withColumn("score", F.round("score", 6))
    return fusion.principal(fused).select("node_id", "score", "n_contributions")


def explorer_band(spark, d):
    fused = fusion.fuse(_phases(spark, d)).withColumn("score", F.round("score", 6))
    return fusion.explorer(fused).select("node_id", "score")


def percentile_floor(spark, d):
    return fusion.percentile_floor(A.table(spark, d, "customer"), "c_acctbal", DEFAULT.principal_percentile)


def query_understanding(spark, d):
    """Tokens, type, mode, intent and range of every user message, read as a query."""
    rows = A.table(spark, d, "conversations").where("role = 'user'").withColumn("q", F.concat_ws(" ", F.col("text"), F.when(F.col("turn") % 3 == 0, "compare before 2008").when(F.col("turn") % 3 == 1, "history 1994").otherwise("latest 1990s")))
    rng = T.date_range(F.col("q"))
    return rows.select("conv_id", "turn", F.size(T.tokens(F.col("q"))).cast("long").alias("n_tokens"), T.input_type(T.tokens(F.col("q"))).alias("kind"), T.query_mode(F.col("q")).alias("mode"), T.temporal_intent(F.col("q")).alias("intent"), rng["from"].alias("date_from"), rng["to"].alias("date_to"))


def facet_search(spark, d):
    docs = A.documents(spark, d)
    found = search.facets(docs, "the and", F.concat_ws(" ", "title", "content"), F.col("published"), "1996-01-01", "2005-12-31")
    return found.select("node_id", "title").orderBy("title", "node_id")


QUERIES = {f.__name__: f for f in (bm25_topk, date_filter_bm25, term_overlap, entity_pivot, vector_topk, vector_mean, sumo_expansion, cross_doc_expand, answers_same, decay_score, coverage_overlap, temporal_scores, fused_search, principal_tier, explorer_band, percentile_floor, query_understanding, facet_search)}

STOP_SQL = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_terms = ", ".join(f"('{t}')" for t in TERMS)
DOCS = """docs AS (SELECT doc_id AS node_id, text AS content, left(text, 60) AS title, source, lang, DATE '1995-01-01' + (doc_id * 7 % 10000)::INT AS published,
 ['EVERGREEN', 'SCHOLARLY', 'CURRENT', 'EPHEMERAL'][regexp_extract(source, '(\\d+)', 1)::INT % 4 + 1] AS decay_class FROM documents)"""
BM25 = f"""{DOCS},
tok AS (SELECT node_id, list_filter(regexp_extract_all(lower(coalesce(content, '')), '[a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ({STOP_SQL})) AS w FROM docs),
stat AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM tok),
tf AS (SELECT node_id, len(w) AS dl, t, len(list_filter(w, lambda x: x = t)) AS tf FROM tok, (VALUES {_terms}) q(t)),
df AS (SELECT t, count(*) FILTER (WHERE tf > 0) AS df FROM tf GROUP BY t),
bm AS (SELECT node_id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score FROM tf JOIN df USING (t), stat WHERE tf > 0 GROUP BY node_id)"""
OVERLAP = "ov AS (SELECT node_id, (" + " + ".join(f"contains(lower(coalesce(content, '')), '{t}')::INT" for t in TERMS) + f") / {len(TERMS)}.0::DOUBLE AS score FROM docs)"
MENTIONS = """wd AS (SELECT doc_id AS node_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) >= 5))) AS slug FROM documents),
mn AS (SELECT node_id, slug FROM wd),
sl AS (SELECT slug FROM mn GROUP BY slug ORDER BY count(*) DESC, slug LIMIT 8)"""
_w = DEFAULT.phase_weights("synthesis")
FUSED = f"""WITH {BM25}, {OVERLAP}, {MENTIONS},
b AS (SELECT node_id, score FROM (SELECT * FROM bm WHERE score > 0 ORDER BY score DESC, node_id LIMIT 400) ORDER BY score DESC, node_id LIMIT 200),
o AS (SELECT node_id, score FROM ov WHERE score > 0 ORDER BY score DESC, node_id LIMIT 200),
p AS (SELECT node_id, count(DISTINCT slug) / 8.0::DOUBLE AS score FROM mn JOIN sl USING (slug) GROUP BY node_id ORDER BY score DESC, node_id LIMIT 200),
c AS (SELECT 1 AS k, 'fulltext' AS phase, node_id, score AS raw, {_w["fulltext"]!r}::DOUBLE * score / max(score) OVER () AS score FROM b
 UNION ALL SELECT 3, 'entity_pivot', node_id, score, {_w["entity_pivot"]!r}::DOUBLE * score / max(score) OVER () FROM p
 UNION ALL SELECT 8, 'cluster_summary', node_id, score, {_w["cluster_summary"]!r}::DOUBLE * score / max(score) OVER () FROM o),
f AS (SELECT node_id, round(sum(score), 6) AS score, count(*) AS n_contributions, round(max(raw) FILTER (WHERE phase = 'fulltext'), 6) AS raw_bm25, string_agg(phase, ',' ORDER BY k) AS sources FROM c GROUP BY node_id)"""
_rate = "CASE WHEN {p} = '1' THEN 0.01::DOUBLE WHEN {p} = '2' THEN 0.000001::DOUBLE ELSE 0.0001::DOUBLE END".format(p="left(o_orderpriority, 1)")
_q = "concat_ws(' ', text, CASE WHEN turn % 3 = 0 THEN 'compare before 2008' WHEN turn % 3 = 1 THEN 'history 1994' ELSE 'latest 1990s' END)"
_vec = "[" + ", ".join(f"{x!r}::DOUBLE" for x in VECTOR) + "]"

ORACLE = {
    "bm25_topk": f"WITH {BM25} SELECT node_id, round(score, 6) AS score FROM (SELECT * FROM bm WHERE score > 0 ORDER BY score DESC, node_id LIMIT 20)",
    "date_filter_bm25": f"WITH {BM25} SELECT node_id, round(score, 6) AS score FROM (SELECT bm.*, published FROM bm JOIN docs USING (node_id) WHERE score > 0 ORDER BY score DESC, node_id LIMIT 40) WHERE published::VARCHAR >= '2000' AND published::VARCHAR <= '2010' ORDER BY score DESC, node_id LIMIT 20",
    "term_overlap": f"WITH {DOCS}, {OVERLAP} SELECT node_id, round(score, 6) AS score FROM ov WHERE score > 0 ORDER BY ov.score DESC, node_id LIMIT 20",
    "entity_pivot": f"WITH {BM25}, {MENTIONS}, seen AS (SELECT node_id FROM (SELECT * FROM bm WHERE score > 0 ORDER BY score DESC, node_id LIMIT 5)) SELECT node_id, round(count(DISTINCT slug) / 8.0::DOUBLE, 6) AS score FROM mn JOIN sl USING (slug) WHERE node_id NOT IN (SELECT node_id FROM seen) GROUP BY node_id ORDER BY score DESC, node_id LIMIT 20",
    "vector_topk": f"SELECT vec_id AS node_id, round(list_cosine_similarity(embedding::DOUBLE[], {_vec}), 5) AS score FROM embeddings WHERE list_cosine_similarity(embedding::DOUBLE[], {_vec}) > 0 ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_vec}) DESC, vec_id LIMIT 10",
    "vector_mean": "SELECT label, dim, round(avg(x::DOUBLE), 6) AS mean FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding)))::INT AS dim FROM embeddings) GROUP BY label, dim",
    "sumo_expansion": "WITH t AS (SELECT 'P' || p_partkey AS node_id, (left(p_brand, 7) = 'Brand#2')::INT AS e, 1 + (left(p_brand, 7) = 'Brand#1')::INT AS a FROM part WHERE p_brand IS NOT NULL) SELECT node_id, round((e + a * ((1.0::DOUBLE / 3 + 0.5::DOUBLE) / 2)) / 3, 6) AS score FROM t ORDER BY (e + a * ((1.0::DOUBLE / 3 + 0.5::DOUBLE) / 2)) / 3 DESC, node_id LIMIT 40",
    "cross_doc_expand": """WITH e AS (SELECT n_nationkey AS src, (n_nationkey + 1) % 25 AS dst, n_nationkey / 25.0::DOUBLE AS weight FROM nation), b AS (SELECT * FROM e UNION ALL SELECT dst, src, weight FROM e),
s AS (SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1), r AS (SELECT dst, max(weight) AS score FROM b WHERE weight > 0.3 AND src IN (SELECT k FROM s) AND dst NOT IN (SELECT k FROM s) GROUP BY dst)
SELECT c_custkey AS node_id, round(score, 6) AS score, 1 AS overlap FROM customer JOIN r ON c_nationkey = dst WHERE c_custkey % 7 IN (1, 3) ORDER BY overlap DESC, r.score DESC, node_id LIMIT 50""",
    "answers_same": r"""WITH t AS (SELECT conv_id || '-' || turn AS node_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')) AS key FROM conversations), u AS (SELECT * FROM t WHERE length(key) > 0)
SELECT node_id, min(node_id) OVER (PARTITION BY key) AS class_id, count(*) OVER (PARTITION BY key) - 1 AS n_others FROM u""",
    "decay_score": f"SELECT o_orderkey, round(exp(-({_rate}) * date_diff('day', o_orderdate::DATE, DATE '{AS_OF}')), 6) AS decay, round(1 - exp(-0.000274::DOUBLE * date_diff('day', o_orderdate::DATE, DATE '{AS_OF}')), 6) AS authority FROM orders",
    "coverage_overlap": "SELECT o_orderkey, round(CASE WHEN d + 365 >= DATE '1997-01-01' AND d <= DATE '1999-01-01' THEN least((least(d + 365, DATE '1999-01-01') - greatest(d, DATE '1997-01-01')) / 730.0::DOUBLE, 1.0::DOUBLE) ELSE 0 END, 6) AS coverage FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)",
    "temporal_scores": f"WITH {DOCS} SELECT node_id, round(CASE WHEN lang NOT IN ('en', 'fr') OR source = 'src3' THEN 0.0::DOUBLE WHEN lang = 'fr' THEN 0.2::DOUBLE * CASE WHEN days >= 0 THEN 1 - exp(-0.000274::DOUBLE * days) ELSE 0 END ELSE 0.2::DOUBLE * CASE WHEN days < 0 THEN 0 ELSE exp(-rate * days) END END, 6) AS temporal FROM (SELECT *, date_diff('day', published, DATE '{AS_OF}') AS days, CASE decay_class WHEN 'EVERGREEN' THEN 1e-6::DOUBLE WHEN 'CURRENT' THEN 1e-2::DOUBLE WHEN 'EPHEMERAL' THEN 1e-1::DOUBLE ELSE 1e-4::DOUBLE END AS rate FROM docs)",
    "fused_search": f"{FUSED} SELECT * FROM f",
    "principal_tier": f"{FUSED}, g AS (SELECT score AS floor FROM (SELECT score, row_number() OVER (ORDER BY score) - 1 AS k, count(*) OVER () AS n FROM f) WHERE k = least(n - 1, floor(n * 0.75::DOUBLE)::BIGINT)) SELECT node_id, score, n_contributions FROM f, g WHERE n_contributions >= 2 AND score >= floor ORDER BY score DESC, node_id LIMIT 5",
    "explorer_band": f"{FUSED} SELECT node_id, score FROM f WHERE score >= 0.15::DOUBLE AND score < 0.6::DOUBLE",
    "percentile_floor": "SELECT c_acctbal AS floor FROM (SELECT c_acctbal, row_number() OVER (ORDER BY c_acctbal) - 1 AS k, count(*) OVER () AS n FROM customer) WHERE k = least(n - 1, floor(n * 0.75::DOUBLE)::BIGINT)",
    "query_understanding": rf"""WITH q AS (SELECT conv_id, turn, {_q} AS q, len(list_filter(regexp_extract_all(lower({_q}), '[a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ({STOP_SQL}))) AS n FROM conversations WHERE role = 'user')
SELECT conv_id, turn, n AS n_tokens, CASE WHEN n <= 3 THEN 'keyword' WHEN n <= 30 THEN 'phrase' ELSE 'paragraph' END AS kind, CASE WHEN turn % 3 = 0 THEN 'synthesis' ELSE 'factoid' END AS mode,
 CASE turn % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'historical_fact' ELSE 'current_state' END AS intent, CASE turn % 3 WHEN 0 THEN NULL WHEN 1 THEN '1992' ELSE '1990' END AS date_from, CASE turn % 3 WHEN 0 THEN '2008' WHEN 1 THEN '1996' ELSE '1999' END AS date_to FROM q""",
    "facet_search": f"WITH {DOCS} SELECT node_id, title FROM docs WHERE contains(lower(concat_ws(' ', title, content)), 'the') AND contains(lower(concat_ws(' ', title, content)), 'and') AND published BETWEEN DATE '1996-01-01' AND DATE '2005-12-31'",
}
