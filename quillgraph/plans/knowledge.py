"""Ontology, entity, cluster and evaluation-set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.config import DEFAULT
from quillgraph.operators import clusters, entities, evaluate, ontology, search
from quillgraph.plans.retrieval import BM25, TERMS
from quillgraph.sources import adapters as A


def bm25_two_fields(spark, d):
    nodes = A.documents(spark, d).select("node_id", "content", "title")
    return search.bm25_fields(nodes, ["content", "title"], TERMS, DEFAULT.limit).select("node_id", F.round("score", 6).alias("score"))


def _names(spark, d):
    part = A.table(spark, d, "part")
    return part.select(F.col("p_brand").alias("name")).unionByName(part.select(F.initcap("p_type").alias("name"))).distinct()


def tag_resolution(spark, d):
    """Names of parts as tags, against the names of brands and types."""
    part = A.table(spark, d, "part")
    tags = part.select(F.explode(F.array("p_type", F.lower(F.replace("p_brand", F.lit("#"), F.lit("_#"))), F.concat(F.initcap("p_type"), F.lit("Thing")), F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")))).alias("tag"))
    aliases = A.table(spark, d, "region").select(F.lower("r_name").alias("alias_key"), F.col("r_regionkey").alias("place"), F.lit("Economy").alias("name"))
    return ontology.resolve_tags(tags, _names(spark, d), aliases)


def vocabulary_hits(spark, d):
    vocabulary = A.table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return ontology.known_words(A.texts(spark, d, "documents"), vocabulary, "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("n"))


def lanes(spark, d):
    return ontology.primary_depth(A.type_ontology(spark, d).where("child <> parent"), "Thing").groupBy("lane", "depth").agg(F.count("*").alias("n"))


def lane_weights(spark, d):
    found = ontology.primary_depth(A.type_ontology(spark, d).where("child <> parent"), "Thing")
    return ontology.lane_weights(found).select("lane", "n", F.round("share", 6).alias("share"), "place")


def entity_validation(spark, d):
    c = A.table(spark, d, "customer")
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "ORG").when(F.col("c_mktsegment") == "MACHINERY", "PERSON").otherwise("THING")
    rows = c.select(F.col("c_nationkey").alias("node_id"), F.col("c_custkey").alias("at"), F.col("c_name").alias("name"), F.concat(F.lit("unit-s-"), (F.col("c_custkey") % 40).cast("string")).alias("canonical"), kind.alias("type"), (F.col("c_acctbal") / 5000).alias("confidence"), F.lit(None).cast("string").alias("context"))
    merged = entities.merge(entities.validate(rows), ["node_id"])
    return merged.select("node_id", "norm_key", "canonical", "type", F.round("confidence", 6).alias("confidence"), F.size("aliases").cast("long").alias("n_aliases"), "mentions")


def section_dedup(spark, d):
    s = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("node_id"), F.col("o_custkey").alias("document_id"), F.length("o_orderpriority").alias("level"), F.col("o_orderpriority").alias("title"), F.col("o_orderkey").alias("doc_position"))
    return entities.first_sections(s).select("node_id", "section_key")


def answer_rule(spark, d):
    rows = A.table(spark, d, "part")
    return rows.select("p_partkey", entities.correct_answer(F.split("p_name", " ")[1], F.col("p_name")).alias("holds"), entities.correct_answer(F.col("p_brand"), F.concat(F.lit("it is "), F.lower("p_brand"), F.lit("!"))).alias("said"), entities.correct_answer(F.col("p_name"), F.lit(None).cast("string")).alias("none"))


def kmeans_clusters(spark, d):
    nodes = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("node_id"), "embedding")
    return clusters.kmeans(nodes)


def report_diff(spark, d):
    """How each nation's share of urgent orders moved between two years."""
    o = A.table(spark, d, "orders").join(A.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    part = lambda year: o.where(F.year("o_orderdate") == year).groupBy(F.col("c_nationkey").cast("string").alias("config")).agg(F.avg((F.col("o_orderpriority") == "1-URGENT").cast("double")).alias("urgent"), F.count("*").alias("n"))
    return evaluate.compare_reports(part(1996), part(1997)).select("config", F.round("urgent", 6).alias("urgent"), "n")


QUERIES = {f.__name__: f for f in (bm25_two_fields, tag_resolution, vocabulary_hits, lanes, lane_weights, entity_validation, section_dedup, answer_rule, kmeans_clusters, report_diff)}

_title = BM25.replace("content", "title").replace("text AS title", "text AS x").replace("docs AS", "docs2 AS").replace("FROM docs)", "FROM docs2)").replace("tok AS", "tok2 AS").replace("FROM tok", "FROM tok2").replace("stat AS", "stat2 AS").replace(", stat WHERE", ", stat2 WHERE").replace("tf AS (SELECT node_id", "tf2 AS (SELECT node_id").replace("FROM tf ", "FROM tf2 ").replace("df AS (SELECT t", "df2 AS (SELECT t").replace("JOIN df USING", "JOIN df2 USING").replace("bm AS", "bm2 AS")
_first = "o AS (SELECT child, min(parent) AS parent FROM (SELECT DISTINCT * FROM (SELECT 'P' || p_partkey AS child, p_brand AS parent FROM part UNION ALL SELECT p_brand, left(p_brand, 7) FROM part UNION ALL SELECT left(p_brand, 7), 'Thing' FROM part) WHERE child <> parent) GROUP BY child), l(name, depth, lane) AS (SELECT child, 1, child FROM o WHERE parent = 'Thing' UNION ALL SELECT o.child, l.depth + 1, l.lane FROM l JOIN o ON o.parent = l.name)"
_na = "trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g'))"

ORACLE = {
    "bm25_two_fields": f"WITH {BM25}, {_title} SELECT node_id, round(sum(score), 6) AS score FROM (SELECT * FROM bm UNION ALL SELECT * FROM bm2) GROUP BY node_id ORDER BY sum(score) DESC, node_id LIMIT 20",
    "tag_resolution": r"""WITH nm AS (SELECT DISTINCT p_brand AS name FROM part UNION SELECT DISTINCT upper(left(p_type, 1)) || lower(substr(p_type, 2)) FROM part), ky AS (SELECT regexp_replace(lower(name), '[_\s-]', '', 'g') AS k, min(name) AS name FROM nm GROUP BY 1),
tg AS (SELECT p_type AS tag FROM part UNION SELECT lower(replace(p_brand, '#', '_#')) FROM part UNION SELECT upper(left(p_type, 1)) || lower(substr(p_type, 2)) || 'Thing' FROM part UNION SELECT array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), '') FROM part),
pw AS (SELECT tag, unnest(p) AS w, unnest(range(len(p))) AS i FROM (SELECT tag, list_filter(string_split_regex(trim(regexp_replace(tag, '([A-Z])', ' \1', 'g')), '\s+'), lambda w: length(w) >= 3) AS p FROM tg) WHERE len(p) > 1),
pt AS (SELECT tag, arg_min(name, (-length(w)) * 1000 + i) AS name FROM pw JOIN ky ON ky.k = lower(w) GROUP BY tag)
SELECT tag, coalesce((SELECT name FROM nm WHERE nm.name = trim(tag)), ky.name, CASE WHEN EXISTS (SELECT 1 FROM region WHERE lower(r_name) = regexp_replace(lower(trim(tag)), '[_\s-]', '', 'g')) THEN 'Economy' END, pt.name) AS canonical
FROM tg LEFT JOIN ky ON ky.k = regexp_replace(lower(trim(tag)), '[_\s-]', '', 'g') LEFT JOIN pt USING (tag)""",
    "vocabulary_hits": "WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark) SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS w FROM documents) JOIN v USING (w) GROUP BY doc_id",
    "lanes": f"WITH RECURSIVE {_first} SELECT lane, depth, count(*) AS n FROM l GROUP BY lane, depth",
    "lane_weights": f"WITH RECURSIVE {_first}, s AS (SELECT lane, count(*) AS n FROM l GROUP BY lane) SELECT lane, n, round(sqrt(n) / sum(sqrt(n)) OVER (), 6) AS share, row_number() OVER (ORDER BY n DESC, lane) AS place FROM s",
    "entity_validation": """WITH e AS (SELECT c_nationkey AS node_id, c_custkey AS at_, c_name AS name, 'Unit''s ' || (c_custkey % 40) AS canonical, CASE c_mktsegment WHEN 'BUILDING' THEN 'ORG' ELSE 'PERSON' END AS type, greatest(0.0::DOUBLE, least(1.0::DOUBLE, c_acctbal / 5000)) AS confidence FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))
SELECT node_id, regexp_replace(lower(canonical), '[^a-z0-9]', '', 'g') AS norm_key, canonical, arg_min(type, at_) AS type, round(max(confidence), 6) AS confidence, count(DISTINCT name) AS n_aliases, count(*) AS mentions FROM e GROUP BY node_id, canonical""",
    "section_dedup": "SELECT o_orderkey AS node_id, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) AS section_key FROM orders",
    "answer_rule": f"WITH a AS (SELECT p_partkey, {_na.format(x='p_brand')} AS g, {_na.format(x=chr(39) + 'it is ' + chr(39) + ' || p_brand')} AS s FROM part) SELECT p_partkey, true AS holds, contains(s, g) AS said, false AS none FROM a",
    "report_diff": "WITH r AS (SELECT year(o_orderdate) AS y, c_nationkey::VARCHAR AS config, avg((o_orderpriority = '1-URGENT')::INT::DOUBLE) AS urgent, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) SELECT b.config, round(b.urgent - a.urgent, 6) AS urgent, b.n - a.n AS n FROM r a JOIN r b ON a.config = b.config AND a.y = 1996 AND b.y = 1997",
}
