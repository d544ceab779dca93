"""Graph queries: traversal, construction, similarity, analytics, integrity and upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import patterns as P
from quillgraph.functions import text as T
from quillgraph.operators import docproc, graph, louvain, mutate, search, verify
from quillgraph.sources import adapters as A
from quillgraph.state import written

def _supplies(spark, d):
    return A.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("set_id"), F.col("l_partkey").alias("item"))


def traversal_hier(spark, d):
    start = A.table(spark, d, "region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("node_id"))
    found = graph.traverse(A.hierarchy(spark, d), start, 3, ["HAS_CHILD"])
    return found.groupBy("start", "hops").agg(F.count("*").alias("n"), F.countDistinct("node_id").alias("n_nodes"))


def traversal_any(spark, d):
    edges = A.hierarchy(spark, d)
    start = A.table(spark, d, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("node_id"))
    return graph.traverse(edges, start, 2, any_direction=True).groupBy("start", "hops").agg(F.count("*").alias("n"))


def ancestor_closure(spark, d):
    return graph.ancestors(A.type_ontology(spark, d).where("child <> parent"), 3)


def tag_distance(spark, d):
    brands = A.table(spark, d, "part").select(F.col("p_brand").alias("a")).distinct()
    pairs = A.table(spark, d, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("a"), F.lit("Brand#12").alias("b")).unionByName(brands.withColumn("b", F.lit("Brand#3")))
    return graph.tag_distance(A.type_ontology(spark, d).where("child <> parent"), pairs.distinct())


def dice_similar(spark, d):
    return graph.set_similarity(_supplies(spark, d)).select("src", "dst", "shared", F.round("dice", 6).alias("dice"), F.round("jaccard", 6).alias("jaccard"))


def jaccard_similar(spark, d):
    return graph.set_similarity(_supplies(spark, d), "jaccard", 0.12).select("src", "dst", F.round("jaccard", 6).alias("jaccard"))


def adamic_adar(spark, d):
    pairs = graph.adamic_adar(A.part_neighbours(spark, d))
    return pairs.select("src", "dst", F.round("weight", 4).alias("weight"), "common")


def co_mention_edges(spark, d):
    basket = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("node_id"), F.col("l_suppkey").alias("slug"))
    return graph.co_mentions(basket).groupBy("src", "dst").agg(F.count("*").alias("n"))


def precedes_edges(spark, d):
    similar = graph.set_similarity(_supplies(spark, d), "dice", 0.2)
    first = A.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("node_id")).agg(F.max("l_shipdate").alias("published"))
    return graph.precedes(similar, first)


def isolation_flags(spark, d):
    return graph.isolation(A.table(spark, d, "part").select(F.col("p_partkey").alias("node_id")), A.part_neighbours(spark, d), 40)


def evergreen_promotion(spark, d):
    nodes = A.table(spark, d, "part").select(F.col("p_partkey").alias("node_id"), F.lit("SCHOLARLY").alias("decay_class"))
    return graph.evergreen(A.part_neighbours(spark, d), nodes, 25)


def next_para(spark, d):
    return graph.next_edges(A.paragraphs(spark, d), ["doc_id"], "pos", "NEXT_PARA")


def section_edges(spark, d):
    rows = docproc.nest_sections(A.sections(spark, d), "page_id", "pos")
    key = lambda c: F.concat_ws("-", "page_id", c)
    rows = rows.select(key("pos").alias("node_id"), F.col("page_id").cast("string").alias("document_id"), F.when(F.col("parent_position").isNotNull(), key("parent_position")).alias("parent_id"), F.col("pos").alias("doc_position"))
    return graph.structure_edges(rows)


def label_propagation(spark, d):
    return graph.label_propagation(A.part_neighbours(spark, d), turn=F.col("node_id") % 2)


def louvain_communities(spark, d):
    """Communities of suppliers that deliver the same parts, by modularity."""
    pairs = graph.set_similarity(_supplies(spark, d), "dice", 0.2).select("src", "dst", F.col("dice").alias("weight"))
    return louvain.louvain(pairs)


def community_members(spark, d):
    labels = A.table(spark, d, "customer").select(F.col("c_custkey").alias("node_id"), F.col("c_nationkey").alias("label"))
    return graph.communities(labels, 2, 30).select("label", "member_count", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


def surprising_edges(spark, d):
    labels = A.table(spark, d, "part").select(F.col("p_partkey").alias("node_id"), F.col("p_type").alias("label"))
    return graph.surprising(A.part_neighbours(spark, d), labels).groupBy("is_surprising").agg(F.count("*").alias("n"))


def community_pivot(spark, d):
    """From a query's few suppliers by their nations to the other suppliers there, and the orders that mention those."""
    mentions = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("node_id"), F.col("l_suppkey").alias("slug"))
    members = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("slug"), F.col("s_nationkey").alias("label"))
    wanted = A.table(spark, d, "supplier").orderBy("s_suppkey").limit(3).select(F.col("s_suppkey").alias("slug"))
    return search.community_pivot(mentions, members, wanted, mentions.select("node_id").where("node_id < 100"), 60).select("node_id", "score")


def cascade_delete(spark, d):
    nodes = A.table(spark, d, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("node_id"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("document_id"))
    return graph.cascade_delete(nodes, A.hierarchy(spark, d), "R2")[1]


def orphan_edges(spark, d):
    customers = A.table(spark, d, "customer").where("c_acctbal > 0").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("node_id"))
    orders = A.table(spark, d, "orders").select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("node_id"))
    return graph.dangling(A.hierarchy(spark, d).where("src LIKE 'C%'"), customers.unionByName(orders))


def dup_edges(spark, d):
    return graph.duplicate_edges(A.part_neighbours(spark, d)).select("src", "dst", "n")


def neighbour_expand(spark, d):
    ids = A.table(spark, d, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("node_id"))
    return graph.neighbours(A.hierarchy(spark, d), ids)


def integrity_issues(spark, d):
    """The verifier over the graph built from pages (sections) and documents (paragraphs)."""
    docs = A.texts(spark, d, "documents").select(F.col("doc_id").cast("string").alias("node_id"))
    paras = A.paragraphs(spark, d).select("node_id", F.col("doc_id").cast("string").alias("document_id"), F.lit(None).cast("string").alias("section_id"), "content", F.when(F.col("pos") == 0, F.array(F.lit("t"))).alias("tags"))
    nested = docproc.nest_sections(A.sections(spark, d), "page_id", "pos")
    key = lambda c: F.concat(F.lit("s"), F.concat_ws("-", "page_id", c))
    sections = nested.select(key("pos").alias("node_id"), F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("document_id"), F.when(F.col("parent_position").isNotNull(), key("parent_position")).alias("parent_id"), "level")
    sections, paras = written(sections, "sections"), written(paras, "paragraphs")  # a dozen rules read them
    edges = sections.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("src"), F.col("node_id").alias("dst"), F.lit("HAS_CHILD").alias("relation"))
    edges = edges.unionByName(paras.where("length(content) > 40").select(F.col("node_id").alias("src"), F.col("document_id").alias("dst"), F.lit("BELONGS_TO").alias("relation")))
    return verify.verify(docs, sections, paras, edges).groupBy("code", "severity").agg(F.count("*").alias("n"))


def dedup_merge(spark, d):
    """Parts of one normalised name are one entity: survivors, and the edges moved to them."""
    part = A.table(spark, d, "part")
    entities = part.select(F.col("p_partkey").alias("slug"), T.norm_key(F.concat_ws(" ", "p_name", "p_brand")).alias("norm_key"), F.col("p_size").alias("mention_count"), F.col("p_retailprice").alias("first_seen"))
    moved = mutate.repoint(A.part_neighbours(spark, d), mutate.survivors(entities))
    return moved.select("src", "dst")


def upsert_entities(spark, d):
    row = lambda df, slug, kind, docs: df.select(slug.alias("slug"), F.col("c_name").alias("name"), F.lit(kind).alias("type"), F.array("c_mktsegment").alias("aliases"), docs.alias("document_ids"), F.lit(1).cast("long").alias("mention_count"), F.col("c_acctbal").alias("first_seen"))
    c = A.table(spark, d, "customer")
    slug = (F.col("c_custkey") % 100).cast("string")
    old = row(c.where("c_custkey % 2 = 0"), slug, "ORG", F.array(F.col("c_nationkey")))
    new = row(c.where("c_custkey % 2 = 1"), slug, "PERSON", F.array(F.col("c_nationkey")))
    merged = mutate.upsert_entities(old, new)
    join = lambda x: F.array_join(F.transform(x, lambda v: v.cast("string")), ",")
    return merged.select("slug", "name", "type", join("aliases").alias("aliases"), join(F.col("document_ids")).alias("document_ids"), "mention_count", "first_seen")


QUERIES = {f.__name__: f for f in (traversal_hier, traversal_any, ancestor_closure, tag_distance, dice_similar, jaccard_similar, adamic_adar, co_mention_edges, precedes_edges, isolation_flags, evergreen_promotion, next_para, section_edges, label_propagation, louvain_communities, community_members, surprising_edges, community_pivot, cascade_delete, orphan_edges, dup_edges, neighbour_expand, integrity_issues, dedup_merge, upsert_entities)}

HIER = """h AS (SELECT 'R' || n_regionkey AS src, 'N' || n_nationkey AS dst, 'HAS_CHILD' AS relation FROM nation UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey, 'HAS_CHILD' FROM customer UNION ALL SELECT 'C' || o_custkey, 'O' || o_orderkey, 'HAS_CHILD' FROM orders)"""
PARTS = """pn AS (SELECT least(a.l_partkey, b.l_partkey) AS src, greatest(a.l_partkey, b.l_partkey) AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber - 1 WHERE a.l_partkey <> b.l_partkey)"""
SIM = """m AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS i FROM lineitem), z AS (SELECT s, count(*) AS n FROM m GROUP BY s),
sim AS (SELECT a.s AS src, b.s AS dst, count(*) AS shared, 2.0::DOUBLE * count(*) / (any_value(x.n) + any_value(y.n)) AS dice, count(*) / (any_value(x.n) + any_value(y.n) - count(*))::DOUBLE AS jaccard FROM m a JOIN m b ON a.i = b.i AND a.s < b.s JOIN z x ON x.s = a.s JOIN z y ON y.s = b.s GROUP BY a.s, b.s)"""
ONTO = """o AS (SELECT DISTINCT * FROM (SELECT 'P' || p_partkey AS child, p_brand AS parent FROM part UNION ALL SELECT p_brand, left(p_brand, 7) FROM part UNION ALL SELECT left(p_brand, 7), 'Thing' FROM part) WHERE child <> parent)"""
CLOSE = f"""{ONTO}, up(tag, ancestor, distance) AS (SELECT child, parent, 1 FROM o UNION SELECT u.tag, o.parent, u.distance + 1 FROM up u JOIN o ON u.ancestor = o.child WHERE u.distance < {{depth}}), cl AS (SELECT tag, ancestor, min(distance) AS distance FROM up GROUP BY ALL)"""
_furniture = "|".join(f"<{t}.*?</{t}>" for t in P.FURNITURE)
_inner = r"trim(regexp_replace(regexp_replace(x, '<[^>]+>', '', 'g'), '\s+', ' ', 'g'))"
_code = "(CASE WHEN e[3] IN ('x', 'X') THEN ('0x' || e[4:-2])::INT ELSE e[3:-2]::INT END)"
_char = f"chr(CASE WHEN {_code} = 0 OR {_code} BETWEEN 55296 AND 57343 OR {_code} > 1114111 THEN 65533 ELSE {_code} END)"
_names = "MAP {" + ", ".join(f"'{k}': '{v if v != chr(39) else chr(39) * 2}'" for k, v in P.ENTITIES.items()) + "}"
MD = rf"""md0 AS (SELECT page_id, array_to_string(list_transform(regexp_extract_all(regexp_replace(html, '(?is){_furniture}', '', 'g'), '{T.PIECES}'), lambda x:
 CASE WHEN regexp_matches(x, '(?is)^<h[1-6].*</h[1-6]>$') THEN chr(10) || repeat('#', substr(x, 3, 1)::INT) || ' ' || {_inner} || chr(10) WHEN regexp_matches(x, '(?is)^<li.*</li>$') THEN '- ' || {_inner} || chr(10)
 WHEN regexp_matches(x, '(?is)^</?({"|".join(P.BLOCK_TAGS)})[^>]*>$') THEN chr(10) WHEN regexp_matches(x, '(?s)^<.+>$') THEN '' ELSE x END), '') AS t FROM pages),
md1 AS (SELECT page_id, array_to_string(list_transform(regexp_extract_all(t, '&[a-zA-Z]+;|{T.NUMBERED}|[^&]+|&'), lambda e: CASE WHEN regexp_matches(e, '^{T.NUMBERED}$') THEN {_char} WHEN regexp_matches(e, '^&[a-zA-Z]+;$') THEN coalesce({_names}[lower(regexp_extract(e, '&([a-zA-Z]+);', 1))], ' ') ELSE e END), '') AS t FROM md0),
md AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS markdown FROM md1)"""
SECT = MD + r""", ml AS (SELECT page_id, unnest(string_split(markdown, chr(10))) AS line, unnest(range(len(string_split(markdown, chr(10)))))::INT AS pos FROM md),
sec AS (SELECT page_id, pos, length(regexp_extract(line, '^(#+)', 1)) AS level, trim(regexp_replace(line, '^#+ ', '')) AS title FROM ml WHERE regexp_matches(line, '^#{1,6} \S')),
nest AS (SELECT s.page_id, s.pos, s.level, s.title, (SELECT max(b.pos) FROM sec b WHERE b.page_id = s.page_id AND b.pos < s.pos AND b.level < s.level) AS parent FROM sec s)"""
PARA = "pa AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, unnest(range(len(string_split(text, chr(10)))))::INT AS pos FROM documents)"

ORACLE = {
    "traversal_hier": f"WITH {HIER}, e1 AS (SELECT src AS start, dst FROM h WHERE src LIKE 'R%'), e2 AS (SELECT start, h.dst FROM e1 JOIN h ON e1.dst = h.src), e3 AS (SELECT start, h.dst FROM e2 JOIN h ON e2.dst = h.src) SELECT start, hops, count(*) AS n, count(DISTINCT dst) AS n_nodes FROM (SELECT start, dst, 1 AS hops FROM e1 UNION ALL SELECT start, dst, 2 FROM e2 UNION ALL SELECT start, dst, 3 FROM e3) GROUP BY start, hops",
    "traversal_any": f"WITH {HIER}, g AS (SELECT * FROM h), b AS (SELECT src, dst, src || dst AS id FROM g UNION ALL SELECT dst, src, src || dst FROM g), e1 AS (SELECT src AS start, dst, id FROM b WHERE src LIKE 'N%'), e2 AS (SELECT start, b.dst FROM e1 JOIN b ON e1.dst = b.src AND e1.id <> b.id) SELECT start, hops, count(*) AS n FROM (SELECT start, 1 AS hops FROM e1 UNION ALL SELECT start, 2 FROM e2) GROUP BY ALL",
    "ancestor_closure": f"WITH RECURSIVE {CLOSE.format(depth=3)} SELECT * FROM cl",
    "tag_distance": f"WITH RECURSIVE {CLOSE.format(depth=6)}, pr AS (SELECT DISTINCT 'P' || p_partkey AS a, 'Brand#12' AS b FROM part UNION SELECT DISTINCT p_brand, 'Brand#3' FROM part), al AS (SELECT * FROM cl UNION ALL SELECT DISTINCT t, t, 0 FROM (SELECT a AS t FROM pr UNION SELECT b FROM pr)) SELECT a, b, coalesce((SELECT min(x.distance + y.distance) FROM al x JOIN al y ON x.ancestor = y.ancestor WHERE x.tag = a AND y.tag = b), -1) AS distance FROM pr",
    "dice_similar": f"WITH {SIM} SELECT src, dst, shared, round(dice, 6) AS dice, round(jaccard, 6) AS jaccard FROM sim WHERE dice >= 0.1::DOUBLE",
    "jaccard_similar": f"WITH {SIM} SELECT src, dst, round(jaccard, 6) AS jaccard FROM sim WHERE jaccard >= 0.12::DOUBLE",
    "adamic_adar": f"WITH {PARTS}, nb AS (SELECT DISTINCT src AS a, dst AS b FROM (SELECT src, dst FROM pn UNION ALL SELECT dst, src FROM pn)), dg AS (SELECT b AS w, 1.0::DOUBLE / ln(greatest(count(*), 2)) AS share FROM nb GROUP BY b) SELECT x.a AS src, y.a AS dst, round(sum(share), 4) AS weight, count(*) AS common FROM nb x JOIN nb y ON x.b = y.b AND x.a < y.a JOIN dg ON dg.w = x.b GROUP BY 1, 2 HAVING count(*) >= 2 AND sum(share) >= 0.3::DOUBLE",
    "co_mention_edges": "WITH b AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem) SELECT x.s AS src, y.s AS dst, count(*) AS n FROM b x JOIN b y ON x.o = y.o AND x.s < y.s GROUP BY 1, 2",
    "precedes_edges": f"WITH {SIM}, f AS (SELECT l_suppkey AS s, max(l_shipdate) AS p FROM lineitem GROUP BY 1) SELECT DISTINCT CASE WHEN a.p < b.p THEN src ELSE dst END AS src, CASE WHEN a.p < b.p THEN dst ELSE src END AS dst FROM sim JOIN f a ON a.s = src JOIN f b ON b.s = dst WHERE a.p <> b.p AND dice >= 0.2::DOUBLE",
    "isolation_flags": f"WITH {PARTS}, e AS (SELECT src AS k FROM pn UNION ALL SELECT dst FROM pn), n AS (SELECT k, count(*) AS c FROM e GROUP BY k) SELECT p_partkey AS node_id, coalesce(c, 0) AS degree, coalesce(c, 0) < 40 AS isolated FROM part LEFT JOIN n ON k = p_partkey",
    "evergreen_promotion": f"WITH {PARTS}, n AS (SELECT dst AS k, count(*) AS c FROM pn GROUP BY dst) SELECT p_partkey AS node_id, coalesce(c, 0) AS indegree, CASE WHEN coalesce(c, 0) >= 25 THEN 'EVERGREEN' ELSE 'SCHOLARLY' END AS decay_class FROM part LEFT JOIN n ON k = p_partkey",
    "next_para": f"WITH {PARA} SELECT doc_id || '-' || (pos - 1) AS src, doc_id || '-' || pos AS dst, 'NEXT_PARA' AS relation FROM pa WHERE pos > 0",
    "section_edges": f"WITH {SECT}, q AS (SELECT page_id || '-' || pos AS id, coalesce(page_id || '-' || parent, page_id::VARCHAR) AS up, page_id, pos FROM nest) SELECT up AS src, id AS dst, 'HAS_CHILD' AS relation FROM q UNION ALL SELECT * FROM (SELECT lag(id) OVER (PARTITION BY page_id, up ORDER BY pos) AS src, id, 'NEXT_SIBLING' FROM q) WHERE src IS NOT NULL",
    "label_propagation": f"""WITH RECURSIVE {PARTS}, n0 AS (SELECT src AS a, dst AS b FROM pn UNION SELECT dst, src FROM pn), nb AS (SELECT a, b, 1 AS w FROM n0 UNION ALL SELECT DISTINCT a, a, 0 FROM n0),
l(k, node_id, label) AS (SELECT 0, a, a FROM nb WHERE w = 0 UNION ALL SELECT k + 1, a, label FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, label) AS r FROM (SELECT k, a, label, sum(w) AS c FROM l JOIN nb ON b = node_id WHERE k < 60 AND (w = 0 OR a % 2 = k % 2) GROUP BY 1, 2, 3)) WHERE r = 1) SELECT node_id, label FROM l WHERE k = 60""",
    "community_members": "SELECT label, n AS member_count, string_agg(k::VARCHAR, ',' ORDER BY k) AS members FROM (SELECT c_nationkey AS label, c_custkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) WHERE r <= 30 AND n >= 2 GROUP BY label, n",
    "surprising_edges": f"WITH {PARTS} SELECT coalesce(a.p_type <> b.p_type, false) AS is_surprising, count(*) AS n FROM pn LEFT JOIN part a ON a.p_partkey = src LEFT JOIN part b ON b.p_partkey = dst GROUP BY 1",
    "community_pivot": "WITH q AS (SELECT s_suppkey, s_nationkey FROM supplier ORDER BY s_suppkey LIMIT 3) SELECT DISTINCT l_orderkey AS node_id, 0.35::DOUBLE AS score FROM lineitem WHERE l_orderkey >= 100 AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT s_nationkey FROM q) AND s_suppkey NOT IN (SELECT s_suppkey FROM q)) ORDER BY 1 LIMIT 60",
    "cascade_delete": f"WITH {HIER}, g AS (SELECT 'N' || n_nationkey AS k FROM nation WHERE n_regionkey = 2) SELECT src, dst, relation FROM h WHERE src NOT IN (SELECT k FROM g) AND dst NOT IN (SELECT k FROM g)",
    "orphan_edges": f"WITH {HIER} SELECT h.src, h.dst, h.relation FROM h LEFT JOIN customer c ON h.src = 'C' || c_custkey AND c_acctbal > 0 WHERE h.src LIKE 'C%' AND c_custkey IS NULL",
    "dup_edges": f"WITH {PARTS} SELECT src, dst, count(*) AS n FROM pn GROUP BY 1, 2 HAVING count(*) > 1",
    "neighbour_expand": f"WITH {HIER} SELECT src AS node_id, dst AS other, relation, true AS outgoing FROM h WHERE src LIKE 'N%' UNION ALL SELECT dst, src, relation, false FROM h WHERE dst LIKE 'N%'",
    "integrity_issues": f"""WITH {SECT}, {PARA}, s AS (SELECT 's' || page_id || '-' || pos AS id, 'p' || page_id AS doc, 's' || page_id || '-' || parent AS up, level FROM nest),
p AS (SELECT doc_id || '-' || pos AS id, doc_id::VARCHAR AS doc, content, pos FROM pa), he AS (SELECT up AS src, id AS dst FROM s WHERE up IS NOT NULL), be AS (SELECT id AS src, doc AS dst FROM p WHERE length(content) > 40),
t AS (SELECT src AS k FROM he UNION SELECT dst FROM he UNION SELECT src FROM be UNION SELECT dst FROM be), n AS (SELECT doc_id::VARCHAR AS k FROM documents UNION ALL SELECT id FROM s UNION ALL SELECT id FROM p),
i AS (SELECT 'MISSING_SECTION_HAS_CHILD' AS code, 'error' AS severity FROM s WHERE id NOT IN (SELECT dst FROM he)
 UNION ALL SELECT 'LEVEL_GAP', 'warning' FROM s JOIN s u ON s.up = u.id WHERE s.level > u.level + 1
 UNION ALL SELECT 'ALL_SECTIONS_LEAF', 'warning' FROM (SELECT doc FROM s GROUP BY doc HAVING count(*) > 1 AND count(up) = 0)
 UNION ALL SELECT 'MISSING_BELONGS_TO', 'error' FROM p WHERE id NOT IN (SELECT src FROM be)
 UNION ALL SELECT 'ORPHANED_NODES', 'error' FROM n WHERE k NOT IN (SELECT k FROM t)
 UNION ALL SELECT 'EMPTY_PARAGRAPHS', 'warning' FROM p WHERE trim(content) = ''
 UNION ALL SELECT 'NO_TAGS', 'info' FROM p WHERE pos > 0
 UNION ALL SELECT 'NO_NODES', 'error' FROM documents WHERE text IS NULL) SELECT code, severity, count(*) AS n FROM i GROUP BY ALL""",
    "dedup_merge": f"""WITH {PARTS}, e AS (SELECT p_partkey AS k, regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]', '', 'g') AS nk, p_size, p_retailprice FROM part), v AS (SELECT k, first_value(k) OVER (PARTITION BY nk ORDER BY p_size DESC, p_retailprice, k) AS s FROM e)
SELECT DISTINCT a.s AS src, b.s AS dst FROM pn JOIN v a ON a.k = src JOIN v b ON b.k = dst WHERE a.s <> b.s""",
    "upsert_entities": """WITH c AS (SELECT (c_custkey % 100)::VARCHAR AS slug, * FROM customer), f AS (SELECT slug, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'ORG' ELSE 'PERSON' END AS type, row_number() OVER (PARTITION BY slug ORDER BY c_custkey % 2, c_name) AS k FROM c)
SELECT c.slug, any_value(f.name) AS name, any_value(f.type) AS type, array_to_string(list_sort(list_distinct(list(c_mktsegment))), ',') AS aliases, array_to_string(list_sort(list_distinct(list(c_nationkey))), ',') AS document_ids, count(*) AS mention_count, min(c_acctbal) AS first_seen FROM c JOIN f ON f.slug = c.slug AND f.k = 1 GROUP BY c.slug""",
}
