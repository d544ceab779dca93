"""Queries of ingestion steps, upkeep, categories and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.operators import exports, graph, ingest, ontology, verify
from quillgraph.plans.graphs import PARA
from quillgraph.plans.retrieval import DOCS, STOP_SQL
from quillgraph.sources import adapters as A
from quillgraph.sources import layouts


def preflight(spark, d):
    docs = A.documents(spark, d).select("file_hash", F.length("content").alias("size"), F.col("content").alias("text"), "lang")
    stored = docs.where("lang = 'en'").select("file_hash").withColumn("ingestion_status", F.lit("complete"))
    return ingest.preflight(docs.drop("lang"), stored, 20000)


def document_metadata(spark, d):
    found = ingest.document_metadata(A.texts(spark, d, "documents"))
    return found.select("doc_id", "title", F.md5("description").alias("digest"), "published")


def context_prefixes(spark, d):
    o = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("node_id"), F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("position"), F.col("o_orderpriority").alias("section_title"))
    return ingest.context_prefixes(o, A.table(spark, d, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("title")))


def enriched_edges(spark, d):
    """Neighbouring parts with what they share."""
    p = A.table(spark, d, "part").select(F.col("p_partkey").alias("node_id"), F.col("p_name").alias("title"), F.array_distinct(F.array(F.col("p_brand"), F.col("p_type"), F.concat(F.lit("size "), F.col("p_size").cast("string")))).alias("tags"))
    found = ingest.enriched(A.part_neighbours(spark, d).select("src", "dst").distinct(), p, p)
    return found.select("src", "dst", "verb", F.array_join("tags", "|").alias("tags"), "summary")


def pseudo_questions(spark, d):
    return ingest.pseudo_questions(A.paragraphs(spark, d)).groupBy("key").agg(F.count("*").alias("n"), F.min("node_id").alias("first"))


def entity_resolution(spark, d):
    """Parts as entities of the type of their brand: names of the same words are one."""
    p = A.table(spark, d, "part").select(F.col("p_partkey").alias("slug"), F.col("p_brand").alias("type"), F.col("p_name").alias("canonical"))
    return ingest.resolution(p)[0]


def entity_variants(spark, d):
    p = A.table(spark, d, "part")
    name = F.when(F.col("p_partkey") % 3 == 0, F.get(F.split("p_name", " "), F.lit(0))).otherwise(F.col("p_name"))
    return ingest.resolution(p.select(F.col("p_partkey").alias("slug"), F.col("p_brand").alias("type"), name.alias("canonical")))[1]


def promoted_tags(spark, d):
    p = A.table(spark, d, "part")
    resolved = p.select(F.col("p_brand").alias("tag"), F.left("p_brand", F.lit(7)).alias("canonical")).distinct().unionByName(p.select(F.col("p_type").alias("tag"), F.lit(None).cast("string").alias("canonical")).distinct())
    return ingest.promoted_tags(p.select(F.col("p_partkey").alias("node_id"), F.array("p_brand", "p_type").alias("tags")), resolved)[1]


def tag_terms(spark, d):
    """Brands and words of part names as an ontology's terms, in the names of parts with their types."""
    p = A.table(spark, d, "part")
    terms = p.select(F.explode(F.split("p_name", " ")).alias("term")).distinct()
    found = ingest.tag_terms(p.select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("text")), terms, "p_partkey", "text", 2, 5, 6)
    return found.select("p_partkey", F.array_join("terms", ",").alias("terms"))


def date_excerpts(spark, d):
    docs = A.documents(spark, d).select(F.col("node_id").alias("document_id"), F.when(F.col("lang") == "en", F.col("published")).alias("published"))
    paras = A.paragraphs(spark, d).select(F.col("doc_id").alias("document_id"), F.col("pos").alias("position"), "content")
    return ingest.date_excerpts(docs, paras).select("document_id", F.md5("excerpt").alias("digest"))


def missing_embeddings(spark, d):
    nodes = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("node_id"), F.when(F.col("vec_id") % 7 > 0, F.col("embedding")).alias("embedding"), F.when(F.col("label") % 3 > 0, F.concat(F.lit("m"), (F.col("label") % 3).cast("string"))).alias("embedding_model"))
    return ingest.missing_embeddings(nodes, "m1").select("node_id")


def cleanup(spark, d):
    """Upkeep: orders of missing customers go, and what touches them; old finished jobs go."""
    c = A.table(spark, d, "customer").where("c_acctbal > 0").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("node_id"))
    o = A.table(spark, d, "orders").select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("node_id"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("document_id"))
    jobs = A.table(spark, d, "events").select(F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "completed").otherwise("waiting").alias("status"), F.col("ts").alias("updated_at"))
    nodes, edges, left = ingest.cleanup(c, o, A.hierarchy(spark, d), jobs, F.lit("2024-01-20").cast("timestamp"))
    rows = [nodes.agg(F.lit("nodes").alias("what"), F.count("*").alias("n")), edges.agg(F.lit("edges").alias("what"), F.count("*").alias("n")), left.groupBy(F.col("status").alias("what")).agg(F.count("*").alias("n"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def adjacent_edges(spark, d):
    nodes = A.paragraphs(spark, d).withColumn("node_type", F.when(F.length("content") > 300, "Table").otherwise("Paragraph"))
    return graph.adjacent_edges(nodes, ["doc_id"], "pos")


def belongs_edges(spark, d):
    o = A.table(spark, d, "orders")
    return graph.belongs_edges(o.select(F.col("o_orderkey").alias("node_id"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("section_id"), F.col("o_custkey").cast("string").alias("document_id")))


def dedup_edges(spark, d):
    edges = A.table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("relation"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return graph.keep_first(edges, "at")


def doc_cross_edges(spark, d):
    """Nations as documents, customers as their paragraphs, market segments as entities."""
    n, c = A.table(spark, d, "nation"), A.table(spark, d, "customer")
    similar = n.select(F.col("n_nationkey").cast("string").alias("src"), ((F.col("n_nationkey") + 1) % 25).cast("string").alias("dst"))
    mentions = c.select(F.col("c_custkey").alias("node_id"), F.col("c_mktsegment").alias("slug"))
    paras = c.select(F.col("c_custkey").alias("node_id"), F.col("c_nationkey").cast("string").alias("document_id"))
    wanted = n.where("n_regionkey = 1").select(F.col("n_nationkey").cast("string").alias("document_id"))
    return graph.cross_edges(similar, mentions, paras, n.select(F.col("n_nationkey").cast("string").alias("node_id"), F.col("n_name").alias("title")), wanted)


def _tree(spark, d):
    part = A.table(spark, d, "part")
    names = part.select(F.col("p_brand").alias("name")).unionByName(part.select(F.lit("Thing").alias("name"))).distinct()
    return ontology.category_tree(A.type_ontology(spark, d).where("child <> parent"), names)


def category_tree(spark, d):
    return _tree(spark, d)


def category_angles(spark, d):
    sizes = A.table(spark, d, "part").groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("n"))
    found = ontology.angles(ontology.subtree_weights(_tree(spark, d), sizes))
    return found.select("name", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"))


def section_pages(spark, d):
    """Regions as documents, nations as sections, customers as paragraphs."""
    docs = A.table(spark, d, "region").select(F.col("r_regionkey").alias("document_id"), F.initcap("r_name").alias("title"))
    sections = A.table(spark, d, "nation").select(F.col("n_nationkey").alias("node_id"), F.col("n_regionkey").alias("document_id"), F.col("n_name").alias("title"))
    paras = A.table(spark, d, "customer").select(F.col("c_nationkey").alias("section_id"), F.col("c_custkey").alias("position"), F.col("c_name").alias("content"))
    return exports.section_pages(docs, sections, paras).select("node_id", "path", F.md5("body").alias("digest"))


def entity_pages(spark, d):
    """Suppliers as entities, orders as paragraphs, customers as documents."""
    entities = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("slug"), F.col("s_name").alias("name"), F.lit("ORG").alias("type"))
    mentions = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("node_id"), F.col("l_suppkey").alias("slug"))
    paras = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("node_id"), F.col("o_custkey").alias("document_id"))
    titles = A.table(spark, d, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("title"))
    return exports.entity_pages(entities, mentions, paras, titles).select("slug", "path", F.md5("body").alias("digest"))


def json_export(spark, d):
    return exports.as_json(A.table(spark, d, "nation"))


def layout_roundtrip(spark, d):
    """Orders of a customer as the nodes of a document, written as raw layout JSON and read by its reader."""
    nodes = A.table(spark, d, "orders").select(F.col("o_custkey").alias("doc"), F.row_number().over(A.by("o_custkey", "o_orderkey")).alias("pos"), F.lit("Paragraph").alias("node_type"), F.lit(None).cast("int").alias("level"), F.lit(3).alias("page"), F.col("o_orderstatus").alias("title"), F.col("o_orderpriority").alias("content"))
    return layouts.okf_nodes(exports.layout_json(nodes), "doc", "json")


def content_coverage(spark, d):
    """Lines of over forty characters as what was kept of a document; some sources are gone."""
    docs = A.texts(spark, d, "documents")
    paras = A.paragraphs(spark, d).where("length(content) > 40").select(F.col("doc_id").alias("document_id"), "content")
    sources = docs.where("lang <> 'fr'").select(F.col("doc_id").alias("document_id"), F.length("text").alias("size"))
    return verify.coverage(docs.select(F.col("doc_id").alias("node_id")), paras, sources)


def missing_edges(spark, d):
    """Nations under regions and orders under customers, of which some have their edge."""
    n, o = A.table(spark, d, "nation"), A.table(spark, d, "orders")
    sections = n.select(F.col("n_name").alias("node_id"), F.when(F.col("n_regionkey") > 0, F.col("n_regionkey").cast("string")).alias("parent_id"))
    paras = o.select(F.col("o_orderkey").cast("string").alias("node_id"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("section_id"), F.col("o_custkey").cast("string").alias("document_id"))
    edges = n.where("n_regionkey < 3").select(F.lit("x").alias("src"), F.col("n_name").alias("dst"), F.lit("HAS_CHILD").alias("relation"))
    edges = edges.unionByName(o.where("o_totalprice > 100000").select(F.col("o_orderkey").cast("string").alias("src"), F.lit("x").alias("dst"), F.lit("BELONGS_TO").alias("relation")))
    return verify.missing_edges(sections, paras, edges)


QUERIES = {f.__name__: f for f in (preflight, document_metadata, context_prefixes, enriched_edges, pseudo_questions, entity_resolution, entity_variants, promoted_tags, tag_terms, date_excerpts, missing_embeddings, cleanup, adjacent_edges, belongs_edges, dedup_edges, doc_cross_edges, category_tree, category_angles, section_pages, entity_pages, json_export, layout_roundtrip, content_coverage, missing_edges)}

_slug = r"regexp_replace(regexp_replace(regexp_replace(trim(lower({x})), '\s+', '-', 'g'), '[^\w-]', '', 'g'), '-{{2,}}', '-', 'g')"
_words = f"list_sort(list_distinct(list_filter(regexp_extract_all(lower({{x}}), '[a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ({STOP_SQL}))))"
_batched = "SELECT p_brand AS type, p_partkey AS slug, {name} AS canonical, ((row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 60)::INT AS batch FROM part"
_nl = "chr(10)"
_front = "'---' || chr(10) || 'title: \"' || {x} || '\"' || chr(10) || 'tags: [\"{k}\"]' || chr(10) || '---' || chr(10) || chr(10)"

_brands = "b AS (SELECT p_brand AS name, sqrt(count(*)) AS own FROM part GROUP BY 1), t AS (SELECT name, own, CASE WHEN left(name, 7) <> name AND left(name, 7) IN (SELECT name FROM b) THEN left(name, 7) ELSE 'Thing' END AS parent FROM b)"
_arcs = """s{k} AS (SELECT *, w / sum(w) OVER (PARTITION BY parent) * arc AS s, count(*) OVER (PARTITION BY parent) * 8 <= arc AS room FROM ({rows})),
f{k} AS (SELECT *, sum(CASE WHEN s < 8 THEN 8 - s ELSE 0 END) OVER (PARTITION BY parent) AS lack, sum(CASE WHEN s < 8 THEN 0 ELSE s END) OVER (PARTITION BY parent) AS rest FROM s{k}),
g{k} AS (SELECT *, CASE WHEN NOT room OR rest <= 0 THEN s WHEN s < 8 THEN 8 WHEN s > 8 THEN s - lack * s / rest ELSE s END AS z FROM f{k}),
a{k} AS (SELECT name, a0 + sum(z) OVER o - z AS a, a0 + sum(z) OVER o AS e FROM g{k} WINDOW o AS (PARTITION BY parent ORDER BY w DESC, name))"""

ORACLE = {
    "preflight": "SELECT file_hash, CASE WHEN file_hash IN (SELECT sha256(text) FROM documents WHERE lang = 'en') THEN 'known' WHEN e THEN 'empty' WHEN n > 20000 THEN 'too_large' ELSE 'ok' END AS verdict FROM (SELECT sha256(text) AS file_hash, any_value(trim(text) = '') AS e, any_value(length(text)) AS n FROM documents GROUP BY 1)",
    "document_metadata": r"""WITH l AS (SELECT doc_id, text, list_filter(string_split_regex(text, '\r?\n'), lambda x: trim(x) <> '') AS l FROM documents)
SELECT doc_id, left(trim(regexp_replace(l[1], '^#+\s*', '')), 120) AS title, md5(left(trim(regexp_replace(array_to_string(list_filter(l, lambda x: NOT starts_with(x, '#')), ' '), '\s+', ' ', 'g')), 300)) AS digest, nullif(regexp_extract(text, '\b((?:1[5-9]|20)\d{2}-\d{2}-\d{2})\b', 1), '') AS published FROM l""",
    "context_prefixes": "SELECT o_orderkey AS node_id, ((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 8)::INT AS batch, concat_ws(' / ', c_name, o_orderpriority) AS prefix FROM orders LEFT JOIN customer ON c_custkey = o_custkey",
    "enriched_edges": """WITH pn AS (SELECT DISTINCT least(a.l_partkey, b.l_partkey) AS src, greatest(a.l_partkey, b.l_partkey) AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber - 1 WHERE a.l_partkey <> b.l_partkey),
e AS (SELECT src, dst, a.p_name AS x, b.p_name AS y, list_sort(list_filter([CASE WHEN a.p_brand = b.p_brand THEN a.p_brand END, CASE WHEN a.p_type = b.p_type THEN a.p_type END, CASE WHEN a.p_size = b.p_size THEN 'size ' || a.p_size END], lambda t: t IS NOT NULL)) AS t FROM pn JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst),
v AS (SELECT *, CASE WHEN len(t) > 0 THEN 'shares ' || array_to_string(t, ', ') ELSE 'relates to' END AS v FROM e) SELECT src, dst, left(v, 100) AS verb, array_to_string(t, '|') AS tags, left(x || ' ' || v || ' with ' || y, 300) AS summary FROM v""",
    "pseudo_questions": f"""WITH {PARA}, w AS (SELECT doc_id || '-' || pos AS node_id, unnest(list_transform(list_sort(list_transform(list_distinct(list_filter(regexp_extract_all(lower(content), '[a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ({STOP_SQL}))), lambda w: {{'l': -length(w), 'w': w}})), lambda s: s.w)[1:2]) AS word FROM pa WHERE length(content) >= 100)
SELECT 'what is ' || word AS key, count(*) AS n, min(node_id) AS first FROM w GROUP BY 1""",
    "entity_resolution": f"WITH b AS ({_batched.format(name='p_name')}), w AS (SELECT *, {_words.format(x='canonical')} AS w FROM b), g AS (SELECT *, min(slug) OVER (PARTITION BY type, batch, w) AS survivor FROM w WHERE len(w) > 0) SELECT type, batch, survivor, slug FROM g WHERE slug <> survivor",
    "entity_variants": f"WITH b AS ({_batched.format(name=chr(67) + 'ASE WHEN p_partkey % 3 = 0 THEN string_split(p_name, chr(32))[1] ELSE p_name END')}), w AS (SELECT *, {_words.format(x='canonical')} AS w FROM b) SELECT p.type, p.slug AS parent, c.slug AS child FROM w p JOIN w c ON p.type = c.type AND p.batch = c.batch AND len(p.w) > 0 AND len(p.w) < len(c.w) AND list_has_all(c.w, p.w)",
    "promoted_tags": "SELECT count(*) FILTER (WHERE p_brand = left(p_brand, 7)) AS kept, count(*) FILTER (WHERE p_brand <> left(p_brand, 7)) AS changed, count(*) AS dropped FROM part",
    "tag_terms": """WITH t AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS term FROM part), f AS (SELECT list(term ORDER BY term) AS first FROM (SELECT term FROM t ORDER BY term LIMIT 5)),
w AS (SELECT p_partkey, unnest(list_distinct(regexp_extract_all(lower(concat_ws(' ', p_name, p_type)), '[a-z]+'))) AS w FROM part), n AS (SELECT p_partkey, list(term) AS named FROM w JOIN t ON lower(term) = w GROUP BY 1)
SELECT p_partkey, array_to_string(list_sort(CASE WHEN len(coalesce(named, [])) < 2 THEN list_distinct(list_concat(coalesce(named, []), first)) ELSE named END)[1:6], ',') AS terms FROM part LEFT JOIN n USING (p_partkey), f""",
    "date_excerpts": f"WITH {PARA}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM pa WHERE length(content) > 50 AND doc_id IN (SELECT doc_id FROM documents WHERE coalesce(lang, '') <> 'en')) SELECT doc_id AS document_id, md5(string_agg(content, chr(10) || chr(10) ORDER BY k)) AS digest FROM r WHERE k <= 5 GROUP BY 1",
    "missing_embeddings": "SELECT vec_id AS node_id FROM embeddings WHERE vec_id % 7 = 0 OR coalesce(label, 0) % 3 <> 1",
    "cleanup": """WITH c AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0), o AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT k FROM c))
SELECT 'nodes' AS what, count(*) AS n FROM o UNION ALL SELECT 'edges', count(*) FROM o UNION ALL SELECT CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'completed' ELSE 'waiting' END, count(*) FROM events WHERE NOT (event_type IN ('error', 'view') AND ts < TIMESTAMP '2024-01-13') GROUP BY 1""",
    "adjacent_edges": f"WITH {PARA}, t AS (SELECT doc_id, pos, CASE WHEN length(content) > 300 THEN 'Table' ELSE 'Paragraph' END AS t FROM pa), l AS (SELECT *, lag(t) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM t) SELECT doc_id || '-' || (pos - 1) AS src, doc_id || '-' || pos AS dst, CASE WHEN t = 'Paragraph' AND b = 'Paragraph' THEN 'NEXT_PARA' ELSE 'ADJACENT_TO' END AS relation FROM l WHERE b IS NOT NULL AND NOT (t = 'Table' AND b = 'Table')",
    "belongs_edges": "SELECT o_orderkey AS src, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE o_custkey::VARCHAR END AS dst, 'BELONGS_TO' AS relation FROM orders",
    "dedup_edges": "SELECT l_partkey AS src, l_suppkey AS dst, l_returnflag AS relation, min(l_orderkey * 10 + l_linenumber) AS at FROM lineitem GROUP BY 1, 2, 3",
    "doc_cross_edges": """WITH r AS (SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1), e AS (SELECT n_nationkey AS a, (n_nationkey + 1) % 25 AS b FROM nation),
t AS (SELECT a AS k, 'SIMILAR_TO' AS relation, b::VARCHAR AS other FROM e UNION SELECT b, 'SIMILAR_TO', a::VARCHAR FROM e UNION SELECT c_nationkey, 'MENTIONS', c_mktsegment FROM customer) SELECT k::VARCHAR AS document_id, relation, other, n_name AS title FROM t LEFT JOIN nation ON n_nationkey::VARCHAR = other WHERE k IN (SELECT k FROM r)""",
    "category_tree": f"WITH {_brands} SELECT name, parent FROM t UNION ALL SELECT 'Thing', NULL",
    "category_angles": f"""WITH {_brands}, w AS (SELECT name, parent, own + coalesce((SELECT sum(c.own) FROM t c WHERE c.parent = t.name), 0) AS w FROM t),
{_arcs.format(k=1, rows="SELECT name, parent, w, 0.0::DOUBLE AS a0, 360.0::DOUBLE AS arc FROM w WHERE parent = 'Thing'")}, {_arcs.format(k=2, rows="SELECT w.name, w.parent, w.w, a AS a0, e - a AS arc FROM w JOIN a1 ON a1.name = w.parent")}
SELECT name, round(a, 4) AS start, round(e, 4) AS "end" FROM (SELECT * FROM a1 UNION ALL SELECT * FROM a2) UNION ALL SELECT 'Thing', 0, 360""",
    "section_pages": f"""WITH b AS (SELECT c_nationkey AS k, string_agg(c_name || chr(10) || chr(10), '' ORDER BY c_custkey) AS t FROM customer GROUP BY 1), r AS (SELECT r_regionkey, upper(left(r_name, 1)) || lower(substr(r_name, 2)) AS x FROM region), s AS (SELECT n_nationkey, n_name, {_slug.format(x='r_name')} AS d, {_slug.format(x='n_name')} AS s FROM nation JOIN region ON r_regionkey = n_regionkey)
SELECT n_nationkey AS node_id, 'documents/' || d || '/' || s || '.md' AS path, md5({_front.format(x='n_name', k='section')} || '[[documents/' || d || '/index|Back to the document]]' || {_nl} || {_nl} || '# ' || n_name || {_nl} || {_nl} || coalesce(t, '')) AS digest FROM s LEFT JOIN b ON k = n_nationkey""",
    "entity_pages": f"""WITH m AS (SELECT l_suppkey AS k, o_custkey AS d, count(DISTINCT o_orderkey) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2), l AS (SELECT k, string_agg('- [[' || coalesce(c_name, d::VARCHAR) || ']] (' || n || ')' || {_nl}, '' ORDER BY d) AS t FROM m LEFT JOIN customer ON c_custkey = d GROUP BY 1)
SELECT s_suppkey AS slug, 'entities/' || {_slug.format(x='s_name')} || '.md' AS path, md5({_front.format(x='s_name', k='entity')} || '# ' || s_name || {_nl} || {_nl} || coalesce(t, '')) AS digest FROM supplier LEFT JOIN l ON k = s_suppkey""",
    "json_export": "SELECT to_json({'n_nationkey': n_nationkey, 'n_name': n_name, 'n_regionkey': n_regionkey})::VARCHAR AS json FROM nation",
    "content_coverage": f"""WITH {PARA}, h AS (SELECT doc_id, sum(length(content)) AS c FROM pa WHERE length(content) > 40 GROUP BY 1), r AS (SELECT d.doc_id::VARCHAR AS node_id, CASE WHEN lang <> 'fr' THEN length(text) END AS s, coalesce(c, 0) / nullif(CASE WHEN lang <> 'fr' THEN length(text) END, 0)::DOUBLE AS q FROM documents d LEFT JOIN h USING (doc_id))
SELECT CASE WHEN s IS NULL THEN 'ORIGINAL_FILE_NOT_FOUND' WHEN q < 0.3::DOUBLE THEN 'LOW_CONTENT_COVERAGE' ELSE 'PARTIAL_CONTENT_COVERAGE' END AS code, CASE WHEN s IS NOT NULL AND q < 0.3::DOUBLE THEN 'error' ELSE 'warning' END AS severity, node_id FROM r WHERE s IS NULL OR q < 0.5::DOUBLE""",
    "missing_edges": "SELECT n_regionkey::VARCHAR AS src, n_name AS dst, 'HAS_CHILD' AS relation FROM nation WHERE n_regionkey >= 3 UNION ALL SELECT o_orderkey::VARCHAR, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE o_custkey::VARCHAR END, 'BELONGS_TO' FROM orders WHERE NOT o_totalprice > 100000",
    "layout_roundtrip": "SELECT o_custkey AS doc, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS pos, 'Paragraph' AS node_type, NULL::INT AS level, 3 AS page, o_orderstatus AS title, o_orderpriority AS content FROM orders",
}
