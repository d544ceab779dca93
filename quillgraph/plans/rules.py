"""Queries of smaller rules: dates, tables, levels, tags, contents, evidence, summaries, merges of extracted entities."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import clusters, docproc, entities, fusion, ingest, ontology, report, search
from quillgraph.plans.graphs import PARTS, SECT
from quillgraph.sources import adapters as A
from quillgraph.sources import layouts
from quillgraph.state import shared_folder


def date_forms(spark, d):
    """Ship dates written as years, months, days and in a foreign way: the normal form and the day each stands for."""
    k = F.col("l_linenumber") % 4
    said = F.when(k == 0, F.date_format("l_shipdate", "yyyy")).when(k == 1, F.date_format("l_shipdate", "yyyy-MM")).when(k == 2, F.date_format("l_shipdate", "yyyy-MM-dd")).otherwise(F.date_format("l_shipdate", "MM/yyyy"))
    rows = A.table(spark, d, "lineitem").select(T.normal_date(said).alias("normal")).groupBy("normal").agg(F.count("*").alias("n"))
    return rows.select("normal", F.date_format(T.parsed_date(F.col("normal")), "yyyy-MM-dd").alias("day"), "n")


def node_rules(spark, d):
    """Lines of documents: formulas, pages claimed within and outside their chunk, and what a verb says of time."""
    verb = F.element_at(F.array(*[F.lit(v) for v in ("Extends and supersedes", "SUPERSEDES it", "discusses", "mentions")]), (F.col("pos") % 4 + 1).cast("int"))
    rows = A.paragraphs(spark, d).select(T.is_latex(F.col("content")).alias("latex"), T.page_of(F.col("pos") % 9, F.lit(3), F.lit(6)).alias("page"), T.temporal_relation(verb).alias("relation"))
    return rows.groupBy("latex", "page", "relation").agg(F.count("*").alias("n"))


def pipe_tables(spark, d):
    """The nations of a region as a Markdown table."""
    row = F.struct("n_nationkey", F.array(F.col("n_nationkey").cast("string"), "n_name").alias("cells"))
    body = F.transform(F.array_sort(F.collect_list(row)), lambda r: r["cells"])
    rows = A.table(spark, d, "nation").groupBy("n_regionkey").agg(body.alias("cells"))
    head = F.array(F.array(F.lit("key"), F.lit("name")))
    return rows.select("n_regionkey", T.pipe_table(F.concat(head, "cells")).alias("markdown"))


def best_scores(spark, d):
    """The best score of each customer over rounds of a loop."""
    return fusion.best_of(A.table(spark, d, "orders").select(F.col("o_custkey").alias("node_id"), F.round(F.col("o_totalprice"), 2).alias("score")))


def merged_entities(spark, d):
    """Parts as extracted entities: one a name and type, with other spellings and the count; the first one gives the rest."""
    p = A.table(spark, d, "part")
    name = F.when(F.col("p_partkey") % 4 == 0, F.upper("p_name")).otherwise(F.initcap("p_name"))
    rows = p.select("p_brand", name.alias("name"), F.initcap("p_name").alias("canonical"), F.col("p_type").alias("type"), T.norm_key(F.col("p_name")).alias("norm_key"), T.slug(F.col("p_name")).alias("slug"), (F.col("p_size") / 100.0).alias("confidence"), F.col("p_partkey").alias("at"))
    found = entities.merge(rows, ["p_brand"])
    return found.select("p_brand", "norm_key", "canonical", "type", F.round("confidence", 6).alias("confidence"), F.array_join("aliases", "|").alias("aliases"), "mentions")


def cluster_hits(spark, d):
    """Parts clustered by size: the summary of each cluster is its most frequent words, and a query finds clusters by them."""
    p = A.table(spark, d, "part")
    words = p.select(F.col("p_partkey").alias("node_id"), F.explode(F.split(F.concat_ws(" ", "p_name", F.lower("p_type")), " ")).alias("word"))
    told = clusters.summaries(p.select(F.col("p_partkey").alias("node_id"), F.col("p_size").alias("cluster")), words, 4)
    found = search.cluster_summaries(told.withColumnRenamed("cluster", "node_id"), ["economy", "small", "bolt"], 20)
    return found.select("node_id", "summary", F.round("score", 6).alias("score"))


def section_levels(spark, d):
    """Levels of the sections of pages without gaps."""
    nested = docproc.nest_sections(A.sections(spark, d), "page_id", "pos")
    return docproc.normalise_levels(nested, "page_id", "pos").groupBy("level").agg(F.count("*").alias("n"), F.count("parent_position").alias("nested"))


def valid_tags(spark, d):
    """Tags of parts against an ontology that knows some of their spellings."""
    p = A.table(spark, d, "part")
    tags = F.array(F.col("p_brand"), F.upper("p_brand"), F.col("p_type"), F.split("p_name", " ")[0])
    names = p.select(F.col("p_brand").alias("name")).distinct().unionByName(p.select(F.split("p_name", " ")[0].alias("name")).where("name < 'm'").distinct())
    none = spark.createDataFrame([], "alias_key string, place int, name string")
    nodes = p.select(F.col("p_partkey").alias("node_id"), tags.alias("tags"))
    resolved = ontology.resolve_tags(nodes.select(F.explode("tags").alias("tag")), names, none)
    found = ontology.validate_tags(nodes, resolved)
    return found.select("node_id", F.array_join("valid", "|").alias("valid"), F.array_join("invalid", "|").alias("invalid"), F.size("resolved_map").alias("n_changed"))


def contents_links(spark, d):
    """Contents of customers (their orders' dates and statuses as titles): each entry to the first order that it names."""
    o = A.table(spark, d, "orders")
    s = o.select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("node_id"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("title"), F.year("o_orderdate").alias("page"), F.col("o_orderkey").alias("doc_position"))
    e = s.where("node_id % 3 = 0").select("document_id", F.col("node_id").alias("entry"), F.concat(F.lit(" "), F.upper("title")).alias("title"), F.when(F.col("node_id") % 2 == 0, F.col("page")).alias("page"))
    return docproc.link_contents(e, s)


def evidence_found(spark, d):
    """Evidence of queries (documents) in what was found for them (documents of neighbouring ids)."""
    docs = A.table(spark, d, "documents").where("doc_id IS NOT NULL")
    found = docs.select(F.explode(F.array((F.col("doc_id") / 2).cast("long"), F.col("doc_id"))).alias("query_id"), F.col("doc_id").alias("node_id"), F.col("text").alias("content"))
    evidence = docs.select(F.col("doc_id").alias("query_id"), F.col("doc_id").alias("evidence_id"), F.substring("text", 1, 150).alias("evidence"))
    return report.evidence_matches(found, evidence).groupBy("node_id").agg(F.count("*").alias("n"))


def best_dates(spark, d):
    """Each order's date by its lines' ship dates, the one of the highest discount; the first line of equals."""
    lines = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("chunk"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("published"), F.when(F.col("l_quantity") % 5 > 0, F.col("l_discount")).alias("confidence"))
    return ingest.best_dates(lines).select("document_id", "chunk", "published")


def running_positions(spark, d):
    """Lines as nodes of a supplier's document, in chunks by order: their places in the whole document."""
    rows = A.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("document_id"), F.col("l_orderkey").alias("chunk"), F.col("l_linenumber").alias("pos"), "l_partkey", "l_extendedprice")
    found = ingest.running_positions(rows)
    return found.groupBy("document_id").agg(F.max("doc_position").alias("last"), F.sum((F.col("doc_position") + 1) * (F.col("chunk") % 7 + F.col("pos"))).alias("digest"))


def opaque_names(spark, d):
    """Names of parts, their digests, UUIDs, runs of consonants and short hex: how many of each kind are opaque."""
    p = A.table(spark, d, "part").select("p_partkey", "p_name", F.md5(F.concat("p_name", F.col("p_partkey").cast("string"))).alias("h"))
    uuid = F.concat_ws("-", *[F.substring("h", a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    forms = {"name": F.replace("p_name", F.lit(" "), F.lit("")), "hex": F.col("h"), "uuid": uuid, "run": F.translate("h", "0123456789abcdef", "bcdfghjklmnpqrae"), "short": F.left("h", F.lit(15)), "dashed": F.concat(F.col("h"), F.lit("-x"))}
    rows = p.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("token")) for k, v in forms.items()])).alias("x"))
    return rows.groupBy("x.kind").agg(F.count("*").alias("n"), F.count_if(T.is_opaque(F.col("x.token"))).alias("opaque"))


def ontology_files(spark, d):
    """Brands as classes of RDF/XML files under their makers, written and read back: names and edges."""
    p = A.table(spark, d, "part").select("p_brand", F.left("p_brand", F.lit(7)).alias("maker"), "p_type").distinct()
    up = lambda c: F.concat(F.lit('<rdfs:subClassOf rdf:resource="http://x.org/o#'), F.regexp_replace(c, "#", "-"), F.lit('"/>'))
    element = F.concat(F.lit('<owl:Class rdf:about="http://x.org/o#'), F.regexp_replace("p_brand", "#", "-"), F.lit('">'), up("maker"), up("p_type"), F.lit("</owl:Class>"))
    path = f"{shared_folder(spark)}/ontology-{uuid.uuid4().hex}"
    p.select(element.alias("value")).write.text(path)
    names, edges = ontology.read_classes(spark, path)
    return edges.groupBy("parent").agg(F.count("*").alias("n"), F.min("child").alias("first")).join(names.withColumnRenamed("name", "parent"), "parent", "left_semi")


def seeded_nations(spark, d):
    """Settings of nations: those of customers that exist stay, defaults fill in the others."""
    c = A.table(spark, d, "customer").where("c_nationkey % 3 = 0").groupBy("c_nationkey").agg(F.max("c_name").alias("value"))
    return ontology.seed(c, A.table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("value")), "c_nationkey")


def feedback_sink(spark, d):
    """Events as feedback, appended in two parts and read back: invalid signals don't get in."""
    rows = A.table(spark, d, "events").select(F.when(F.col("event_id") % 11 > 0, F.col("user_id")).alias("node_id"), F.col("event_type").alias("query_hash"), F.when(F.col("event_id") % 3 == 0, "positive").when(F.col("event_id") % 3 == 1, "negative").otherwise("unsure").alias("signal"))
    path = f"{shared_folder(spark)}/feedback-{uuid.uuid4().hex}"
    for part in (rows.where("query_hash = 'purchase'"), rows.where("query_hash <> 'purchase'")):
        layouts.append_feedback(part, path)
    return spark.read.parquet(path).groupBy("query_hash", "signal").agg(F.count("*").alias("n"))


def strata(spark, d):
    """Forty customers of each nation, drawn by key and seed: how many, and that a second draw is the same."""
    c = A.table(spark, d, "customer")
    draw = lambda seed: entities.stratified(c, "c_nationkey", "c_custkey", 40, seed).select("c_nationkey", "c_custkey")
    both = draw("a").join(draw("a").withColumn("again", F.lit(1)), ["c_nationkey", "c_custkey"], "left")
    return both.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count("again").alias("again"))


def tied_pivot(spark, d):
    """Orders by the parts that they have, and the ties of those parts by neighbouring lines."""
    mentions = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("node_id"), F.col("l_partkey").alias("slug"))
    ties = A.part_neighbours(spark, d).groupBy(F.col("src").alias("slug"), F.col("dst").alias("other")).agg((F.count("*") / 10.0).alias("weight"))
    slugs = A.table(spark, d, "part").where("p_brand = 'Brand#7'").select(F.col("p_partkey").alias("slug"))
    return search.entity_pivot(mentions, slugs, None, 30, ties).select("node_id", F.round("score", 6).alias("score"))


QUERIES = {f.__name__: f for f in (date_forms, node_rules, pipe_tables, best_scores, merged_entities, cluster_hits, section_levels, valid_tags, contents_links, evidence_found, tied_pivot, best_dates, running_positions, opaque_names, ontology_files, seeded_nations, feedback_sink, strata)}

ORACLE = {
    "ontology_files": "WITH e AS (SELECT DISTINCT replace(p_brand, '#', '-') AS child, unnest([replace(left(p_brand, 7), '#', '-'), p_type]) AS parent FROM part) SELECT parent, count(*) AS n, min(child) AS first FROM e GROUP BY 1",
    "seeded_nations": "WITH c AS (SELECT c_nationkey, max(c_name) AS value FROM customer WHERE c_nationkey % 3 = 0 GROUP BY 1) SELECT * FROM c UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM c)",
    "feedback_sink": "SELECT event_type AS query_hash, CASE event_id % 3 WHEN 0 THEN 'positive' ELSE 'negative' END AS signal, count(*) AS n FROM events WHERE event_id % 11 > 0 AND event_id % 3 < 2 AND user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2",
    "strata": "SELECT c_nationkey, least(count(*), 40) AS n, least(count(*), 40) AS again FROM customer GROUP BY 1",
    "running_positions": "WITH r AS (SELECT l_suppkey AS document_id, l_orderkey % 7 + l_linenumber AS x, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS k FROM lineitem) SELECT document_id, max(k)::INT - 1 AS last, sum(k * x)::BIGINT AS digest FROM r GROUP BY 1",
    "opaque_names": r"""WITH p AS (SELECT p_name, md5(p_name || p_partkey) AS h FROM part), t AS (SELECT 'name' AS kind, replace(p_name, ' ', '') AS t FROM p UNION ALL SELECT 'hex', h FROM p UNION ALL SELECT 'uuid', h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] FROM p UNION ALL SELECT 'run', translate(h, '0123456789abcdef', 'bcdfghjklmnpqrae') FROM p UNION ALL SELECT 'short', h[1:15] FROM p UNION ALL SELECT 'dashed', h || '-x' FROM p)
SELECT kind, count(*) AS n, count(*) FILTER (WHERE regexp_full_match(t, '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}') OR (length(t) >= 20 AND (regexp_full_match(t, '[0-9a-f]{16,}') OR (regexp_full_match(t, '[a-zA-Z0-9]+') AND length(regexp_replace(t, '[^aeiou]', '', 'g')) < 0.15 * length(t))))) AS opaque FROM t GROUP BY kind""",
    "evidence_found": r"""WITH n AS (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')) AS c, trim(regexp_replace(lower(coalesce(text[1:150], '')), '\s+', ' ', 'g')) AS e FROM documents WHERE doc_id IS NOT NULL),
p AS (SELECT doc_id, doc_id // 2 AS q FROM n UNION ALL SELECT doc_id, doc_id FROM n)
SELECT d.doc_id AS node_id, count(*) AS n FROM p JOIN n d ON d.doc_id = p.doc_id JOIN n q ON q.doc_id = p.q WHERE length(q.e) > 40 AND d.c <> '' AND (contains(d.c, q.e[1:200]) OR contains(q.e, d.c[1:200])) GROUP BY 1""",
    "best_dates": "SELECT l_orderkey AS document_id, l_linenumber AS chunk, strftime(l_shipdate, '%Y-%m-%d') AS published FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_quantity % 5 > 0 THEN l_discount ELSE 0 END DESC, l_linenumber, l_shipdate) = 1",
    "date_forms": "WITH s AS (SELECT CASE l_linenumber % 4 WHEN 0 THEN strftime(l_shipdate, '%Y') WHEN 1 THEN strftime(l_shipdate, '%Y-%m-01') WHEN 2 THEN strftime(l_shipdate, '%Y-%m-%d') END AS normal FROM lineitem) SELECT normal, CASE WHEN length(normal) = 4 THEN normal || '-01-01' ELSE normal END AS day, count(*) AS n FROM s GROUP BY 1, 2",
    "node_rules": r"WITH p AS (SELECT unnest(string_split(text, chr(10))) AS content, unnest(range(len(string_split(text, chr(10)))))::INT AS pos FROM documents) SELECT regexp_matches(content, '[\\^_]') AS latex, CASE WHEN pos % 9 BETWEEN 3 AND 6 THEN pos % 9 ELSE 3 END AS page, ['extends', 'supersedes', 'discusses', NULL][pos % 4 + 1] AS relation, count(*) AS n FROM p GROUP BY ALL",
    "pipe_tables": "SELECT n_regionkey, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY 1",
    "best_scores": "SELECT o_custkey AS node_id, max(round(o_totalprice, 2)) AS score FROM orders GROUP BY 1",
    "merged_entities": r"""WITH w AS (SELECT *, string_split(p_name, ' ') AS w FROM part), c AS (SELECT *, array_to_string(list_transform(w, lambda x: upper(x[1]) || lower(x[2:])), ' ') AS canonical, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS norm_key FROM w),
n AS (SELECT *, CASE WHEN p_partkey % 4 = 0 THEN upper(p_name) ELSE canonical END AS name FROM c)
SELECT p_brand, norm_key, min_by(canonical, p_partkey) AS canonical, min_by(p_type, p_partkey) AS type, round(max(p_size / 100.0::DOUBLE), 6) AS confidence, coalesce(string_agg(DISTINCT name, '|' ORDER BY name) FILTER (WHERE name <> canonical), '') AS aliases, count(*) AS mentions FROM n GROUP BY p_brand, norm_key""",
    "cluster_hits": """WITH w AS (SELECT p_size AS node_id, unnest(string_split(p_name || ' ' || lower(p_type), ' ')) AS word FROM part), c AS (SELECT node_id, word, row_number() OVER (PARTITION BY node_id ORDER BY count(*) DESC, word) AS k FROM w GROUP BY node_id, word),
s AS (SELECT node_id, string_agg(word, ' ' ORDER BY k) AS summary FROM c WHERE k <= 4 GROUP BY 1), t AS (SELECT *, (contains(summary, 'economy')::INT + contains(summary, 'small')::INT + contains(summary, 'bolt')::INT) / 3.0::DOUBLE AS score FROM s)
SELECT node_id, summary, round(score, 6) AS score FROM t WHERE score > 0 ORDER BY score DESC, node_id LIMIT 20""",
    "section_levels": f"""WITH RECURSIVE {SECT}, lv(page_id, pos, level, parent) AS (SELECT page_id, pos, level, parent FROM nest WHERE parent IS NULL UNION ALL SELECT n.page_id, n.pos, lv.level + 1, n.parent FROM nest n JOIN lv ON n.page_id = lv.page_id AND n.parent = lv.pos)
SELECT level, count(*) AS n, count(parent) AS nested FROM lv GROUP BY level""",
    "valid_tags": r"""WITH a AS (SELECT p_partkey, p_brand, p_type, string_split(p_name, ' ')[1] AS w FROM part), n AS (SELECT DISTINCT p_brand AS name FROM a UNION SELECT DISTINCT w FROM a WHERE w < 'm'),
l AS (SELECT p_partkey, unnest([p_brand, upper(p_brand), p_type, w]) AS tag, unnest([1, 2, 3, 4]) AS pl FROM a), k AS (SELECT regexp_replace(lower(name), '[_\s-]', '', 'g') AS k, min(name) AS same FROM n GROUP BY 1),
pt AS (SELECT DISTINCT tag, list_filter(regexp_split_to_array(trim(regexp_replace(trim(tag), '([A-Z])', ' \1', 'g')), '\s+'), lambda x: length(x) >= 3) AS ps FROM l), pw AS (SELECT tag, unnest(ps) AS word, unnest(range(len(ps))) AS i FROM pt WHERE len(ps) > 1),
lp AS (SELECT tag, min_by(same, (-length(word), i)) AS part FROM pw JOIN k ON k.k = regexp_replace(lower(word), '[_\s-]', '', 'g') GROUP BY tag),
r AS (SELECT l.*, coalesce(x.name, k.same, lp.part) AS canonical FROM l LEFT JOIN n x ON x.name = l.tag LEFT JOIN k ON k.k = regexp_replace(lower(l.tag), '[_\s-]', '', 'g') LEFT JOIN lp ON lp.tag = l.tag),
v AS (SELECT p_partkey, canonical, min(pl) AS pl FROM r WHERE canonical IS NOT NULL GROUP BY 1, 2), vs AS (SELECT p_partkey, string_agg(canonical, '|' ORDER BY pl) AS valid FROM v GROUP BY 1)
SELECT p_partkey AS node_id, coalesce(any_value(valid), '') AS valid, coalesce(string_agg(tag, '|' ORDER BY pl) FILTER (WHERE canonical IS NULL), '') AS invalid, count(DISTINCT tag) FILTER (WHERE canonical <> tag)::INT AS n_changed FROM r LEFT JOIN vs USING (p_partkey) GROUP BY p_partkey""",
    "contents_links": "WITH s AS (SELECT o_custkey AS document_id, o_orderkey AS node_id, lower(o_orderpriority || ' ' || o_orderstatus) AS t, year(o_orderdate) AS page FROM orders), e AS (SELECT document_id, node_id AS entry, t, CASE WHEN node_id % 2 = 0 THEN page END AS page FROM s WHERE node_id % 3 = 0) SELECT e.document_id, e.entry, min(s.node_id) AS section_id FROM e JOIN s ON s.document_id = e.document_id AND (s.page = e.page OR s.t = e.t) GROUP BY 1, 2",
    "tied_pivot": f"""WITH {PARTS}, ti AS (SELECT src AS slug, dst AS other, count(*) / 10.0::DOUBLE AS weight FROM pn GROUP BY 1, 2), sl AS (SELECT p_partkey AS slug FROM part WHERE p_brand = 'Brand#7'),
h AS (SELECT l_orderkey AS node_id, count(DISTINCT l_partkey) / (SELECT count(*) FROM sl)::DOUBLE AS s FROM lineitem WHERE l_partkey IN (SELECT slug FROM sl) GROUP BY 1), b AS (SELECT l_orderkey AS node_id, max(weight) AS aa FROM lineitem JOIN ti ON l_partkey = other WHERE ti.slug IN (SELECT slug FROM sl) GROUP BY 1)
SELECT node_id, round(s + 0.2::DOUBLE * coalesce(aa, 0), 6) AS score FROM h LEFT JOIN b USING (node_id) ORDER BY s + 0.2::DOUBLE * coalesce(aa, 0) DESC, node_id LIMIT 30""",
}
