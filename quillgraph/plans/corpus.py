"""Document queries: parsing, cleaning, paging, crawling, export."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import patterns as P
from quillgraph.functions import text as T
from quillgraph.operators import docproc, mutate
from quillgraph.plans.graphs import MD, PARA, SECT
from quillgraph.plans.retrieval import STOP_SQL
from quillgraph.sources import adapters as A


def html_title(spark, d):
    title = T.html_title(F.col("html"))
    return A.texts(spark, d, "pages").select("page_id", title["text"].alias("title"), title["level"].alias("level"))


def html_markdown(spark, d):
    return A.texts(spark, d, "pages").select("page_id", F.md5(T.html_markdown(F.col("html"))).alias("digest"))


def markdown_headings(spark, d):
    return docproc.nest_sections(A.sections(spark, d), "page_id", "pos").select("page_id", "pos", "level", "title", "parent_position")


def bundle_hosts(spark, d):
    bundles = docproc.bundle_by_host(A.texts(spark, d, "pages"), content="html", key="page_id")
    return bundles.select("host", "n_pages", F.md5("content").alias("digest"))


def crawl_links(spark, d):
    return docproc.crawl_links(A.texts(spark, d, "pages")).groupBy("link").agg(F.countDistinct("url").alias("n_pages"))


def crawl_frontier(spark, d):
    pages = A.texts(spark, d, "pages")
    start = pages.groupBy(T.hostname(F.col("url")).alias("host")).agg(F.min("url").alias("url")).select("url")
    return docproc.crawl_frontier(pages, start, 2)


def bot_blocks(spark, d):
    return A.texts(spark, d, "pages").select("page_id", docproc.is_blocked(F.col("html")).alias("blocked"), T.url_key(F.col("url")).alias("key"))


def artifact_filter(spark, d):
    return A.paragraphs(spark, d).where(~T.is_artifact(F.col("content"))).select("doc_id", "pos")


def fragment_reattach(spark, d):
    rows = docproc.reattach_fragments(A.paragraphs(spark, d), ["doc_id"], "pos")
    return rows.select("doc_id", "start", F.md5("content").alias("digest"))


def running_page(spark, d):
    rows = docproc.running_page(A.paragraphs(spark, d), "doc_id", "pos", F.length("content") < 5)
    return rows.select("doc_id", "pos", "page")


def virtual_pages(spark, d):
    return docproc.virtual_pages(A.paragraphs(spark, d), "doc_id", "pos", "content").select("doc_id", "pos", "page")


def chunk_markdown(spark, d):
    chunks = docproc.chunk_markdown(A.texts(spark, d, "documents"), "doc_id", "text", most=4000, least=300)
    return chunks.select("key", "chunk", "start_page", "end_page", F.length("text").alias("n_chars"))


def toc_detect(spark, d):
    """Lines of documents written as numbered contents lines that lead to a page."""
    rows = A.paragraphs(spark, d).withColumn("content", F.concat(F.lit("1."), F.col("pos").cast("string"), F.lit(" "), F.col("content"), F.lit(" .... "), F.col("pos").cast("string")))
    found = docproc.table_of_contents(rows, "doc_id", "pos")
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("page").alias("last_page"))


def glossary_terms(spark, d):
    """Each document as a glossary: its lines below a heading, as terms with a colon."""
    rows = A.paragraphs(spark, d).withColumn("content", F.when(F.col("pos") == 0, "## Glossary").otherwise(F.concat(F.lit("term "), F.col("pos").cast("string"), F.lit(": "), F.col("content"))))
    return docproc.glossary(rows, "doc_id", "pos").groupBy("doc_id").agg(F.count("*").alias("n"), F.md5(F.min("definition")).alias("digest"))


def section_noise(spark, d):
    """Names of nations and market segments with a page number or a publisher's word, as section titles."""
    n = A.table(spark, d, "customer").select("c_custkey", F.concat(F.when(F.col("c_custkey") % 4 == 0, F.concat(F.col("c_custkey").cast("string"), F.lit(" "))).otherwise(F.lit("")), F.initcap("c_mktsegment"), F.when(F.col("c_custkey") % 4 == 1, " Review").when(F.col("c_custkey") % 4 == 2, " of Press").otherwise("")).alias("title"))
    return n.where(T.is_artifact_section(F.col("title"))).select("c_custkey")


def opaque_tokens(spark, d):
    words = A.texts(spark, d, "documents").select("doc_id", F.explode(F.split("text", r"\s+")).alias("token")).where(F.length("token") >= 20)
    return words.where(T.is_opaque(F.col("token"))).groupBy("doc_id").agg(F.count("*").alias("n"))


def slug_norm(spark, d):
    rows = A.table(spark, d, "part")
    name = F.concat_ws(" ", "p_name", "p_brand", F.lit("(x)"))
    return rows.select("p_partkey", T.slug(name).alias("slug"), T.norm_key(name).alias("norm_key"), T.repair_name(T.slug(name)).alias("repaired"))


def hash_dedup(spark, d):
    docs = A.documents(spark, d)
    stored = docs.where("lang = 'en'").select("file_hash").withColumn("ingestion_status", F.lit("complete"))
    return mutate.new_files(docs, stored).select("file_hash")


def wiki_export(spark, d):
    docs = A.texts(spark, d, "pages").select("page_id", T.html_title(F.col("html"))["text"].alias("title"))
    sections = A.sections(spark, d).select(F.col("page_id").alias("document_id"), F.col("pos").alias("doc_position"), "title")
    pages = docproc.wiki_pages(docs.select(F.col("page_id").alias("document_id"), "title"), sections)
    return pages.select("document_id", F.md5("body").alias("digest"))


def json_fields(spark, d):
    rows = A.table(spark, d, "events")
    broken = F.concat(F.lit("```json\n"), F.regexp_replace("props", r"\}$", ",}"), F.lit("\n```"))
    return rows.select("event_id", T.repaired_json(broken, "k int")["k"].alias("k"))


def rollup_entities(spark, d):
    rows = A.mentions(spark, d).groupBy("node_id").agg(F.array_join(F.array_sort(F.collect_set("slug")), ",").alias("slugs"), F.count("*").alias("n"))
    return rows.select("node_id", F.md5("slugs").alias("digest"), "n")


def tag_rollup(spark, d):
    """Tags of each document, the most frequent first."""
    # A line holds no part of a word of another, so texts are split once; they move once, and both counts follow where they lie.
    docs = A.table(spark, d, "documents").select("doc_id", "text").repartition("doc_id")
    tags = docs.select("doc_id", F.explode(T.long_words(F.col("text"))).alias("tag")).where(~F.col("tag").isin(T.STOPWORDS))
    counts = tags.groupBy("doc_id", "tag").agg(F.count("*").alias("n"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "tag"))), lambda x: x["tag"])
    return counts.groupBy("doc_id").agg(F.md5(F.array_join(listed, ",")).alias("digest"), F.sum("n").alias("n"))


QUERIES = {f.__name__: f for f in (html_title, html_markdown, markdown_headings, bundle_hosts, crawl_links, crawl_frontier, bot_blocks, artifact_filter, fragment_reattach, running_page, virtual_pages, chunk_markdown, toc_detect, glossary_terms, section_noise, opaque_tokens, slug_norm, hash_dedup, wiki_export, json_fields, rollup_entities, tag_rollup)}

_inner = r"trim(regexp_replace(regexp_replace({x}, '<[^>]+>', '', 'g'), '\s+', ' ', 'g'))"
_h1 = _inner.format(x="regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")
_host = r"coalesce(nullif(regexp_extract(url, '^https?://([^/:?#]+)', 1), ''), 'unknown')"
LINKS = r"""lk AS (SELECT DISTINCT url, unnest(list_distinct(regexp_extract_all(html, '(?i)<a\s[^>]*?href=["'']([^"''#]+)', 1))) AS href FROM pages),
ln AS (SELECT url, CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN href LIKE '/%' THEN regexp_extract(url, '^(https?://[^/]+)', 1) || href WHEN regexp_matches(href, '^[a-z]+:') THEN NULL ELSE regexp_extract(url, '^(https?://[^/]+(?:/[^?#]*/|/)?)', 1) || href END AS link FROM lk)"""
_like = lambda p: "regexp_matches(t, '" + p.replace("'", "''") + "')"
_ART = f"""({_like(P.SEPARATOR)} OR {_like(P.PLACEHOLDER)} OR {_like(P.TOC_ANCHOR)} AND {_like(P.TOC_RULE)} OR {_like(P.HEADING_FENCE)} OR length(regexp_replace(t, '[^a-zA-Z]', '', 'g')) < {P.LEAST_LETTERS}
 OR {_like(P.FOOTNOTE_MARK)} AND (contains(t, '@') OR {_like(P.AFFILIATION)}) OR {_like(P.TIMELINE)} OR {_like(P.SOURCE_NOTE)} AND length(t) < {P.SOURCE_NOTE_CHARS} OR {_like(P.PAGE_AND_NAME)})"""

ORACLE = {
    "html_title": f"SELECT page_id, {_h1} AS title, 1 AS level FROM pages",
    "html_markdown": f"WITH {MD} SELECT page_id, md5(markdown) AS digest FROM md",
    "markdown_headings": f"WITH {SECT} SELECT page_id, pos, level, title, parent AS parent_position FROM nest",
    "bundle_hosts": f"SELECT {_host} AS host, count(*) AS n_pages, md5(string_agg(html, chr(10) || chr(10) ORDER BY url)) AS digest FROM pages GROUP BY 1",
    "crawl_links": f"WITH {LINKS} SELECT link, count(DISTINCT url) AS n_pages FROM ln WHERE link IS NOT NULL GROUP BY link",
    "crawl_frontier": f"WITH {LINKS}, s AS (SELECT min(url) AS url FROM pages GROUP BY {_host}), h AS (SELECT DISTINCT url, link FROM ln WHERE link IN (SELECT url FROM pages) AND regexp_extract(url, '^https?://([^/:?#]+)', 1) = regexp_extract(link, '^https?://([^/:?#]+)', 1)), d1 AS (SELECT DISTINCT link AS url FROM h WHERE url IN (SELECT url FROM s) AND link NOT IN (SELECT url FROM s)), d2 AS (SELECT DISTINCT link AS url FROM h WHERE url IN (SELECT url FROM d1) AND link NOT IN (SELECT url FROM s) AND link NOT IN (SELECT url FROM d1)) SELECT url, 0 AS depth FROM s UNION ALL SELECT url, 1 FROM d1 UNION ALL SELECT url, 2 FROM d2",
    "bot_blocks": "SELECT page_id, length(html) < 20000 AND regexp_matches(html, '(?i)captcha|access denied|verify you are (a )?human|just a moment|enable javascript and cookies') AS blocked, replace(translate(base64(encode(url)), '+/', '-_'), '=', '') AS key FROM pages",
    "artifact_filter": f"WITH {PARA} SELECT doc_id, pos FROM (SELECT *, trim(content) AS t FROM pa) WHERE NOT {_ART}",
    "fragment_reattach": f"WITH {PARA}, f AS (SELECT *, trim(content) AS t, length(trim(content)) < 120 AND (regexp_matches(trim(content), '^[a-z]') OR length(trim(content)) < 60) AND pos > 0 AS frag FROM pa), i AS (SELECT *, sum((NOT frag)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM f) SELECT doc_id, min(pos) AS start, md5(string_agg(t, ' ' ORDER BY pos)) AS digest FROM i GROUP BY doc_id, island",
    "running_page": f"WITH {PARA} SELECT doc_id, pos, 1 + sum((length(content) < 5)::INT) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS page FROM pa",
    "virtual_pages": f"WITH {PARA} SELECT doc_id, pos, coalesce(sum(length(content)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // 3000 + 1 AS page FROM pa",
    "chunk_markdown": r"""WITH RECURSIVE li AS (SELECT doc_id, len(l) AS n, unnest(l) AS x, unnest(range(len(l)))::INT AS i FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '\r?\n') AS l FROM documents)),
z AS (SELECT doc_id, i, length(x) + 1 AS n, regexp_matches(x, '^\s{0,3}#{1,3}\s') AS h, regexp_matches(x, '^-{5,}\s*$')::INT AS b FROM li),
f(doc_id, i, size, c) AS (SELECT doc_id, 0, n, 0 FROM z WHERE i = 0 UNION ALL SELECT z.doc_id, z.i, CASE WHEN f.size >= 4000 OR (z.h AND f.size > 1000) THEN 0 ELSE f.size END + z.n, f.c + (f.size >= 4000 OR (z.h AND f.size > 1000))::INT FROM f JOIN z ON z.doc_id = f.doc_id AND z.i = f.i + 1),
g AS (SELECT f.doc_id, f.c, string_agg(x, chr(10) ORDER BY f.i) || chr(10) AS t, min(f.i) AS i0, max(f.i) AS i1 FROM f JOIN li ON li.doc_id = f.doc_id AND li.i = f.i GROUP BY 1, 2),
pg AS (SELECT doc_id, i, 1 + sum(b) OVER (PARTITION BY doc_id ORDER BY i) - b AS p0, 1 + sum(b) OVER (PARTITION BY doc_id ORDER BY i) AS p1, 1 + sum(b) OVER (PARTITION BY doc_id) AS pages FROM z),
k AS (SELECT g.doc_id, row_number() OVER (PARTITION BY g.doc_id ORDER BY c) - 1 AS k, length(t) AS n, a.p0, b.p1, a.pages, sum(length(t)) OVER (PARTITION BY g.doc_id ORDER BY c) AS upto FROM g JOIN pg a ON a.doc_id = g.doc_id AND a.i = i0 JOIN pg b ON b.doc_id = g.doc_id AND b.i = i1 WHERE regexp_matches(t, '\S')),
m(doc_id, k, size, c) AS (SELECT doc_id, k, n, 0 FROM k WHERE k = 0 UNION ALL SELECT k.doc_id, k.k, CASE WHEN k.n < 300 AND m.size + k.n <= 4000 THEN m.size + 1 ELSE 0 END + k.n, m.c + (NOT (k.n < 300 AND m.size + k.n <= 4000))::INT FROM m JOIN k ON k.doc_id = m.doc_id AND k.k = m.k + 1),
s AS (SELECT m.doc_id, m.c, sum(n + 1) - 1 AS n, arg_min(p0, k.k) AS p0, arg_max(p1, k.k) AS p1, any_value(pages) AS pages, min(upto - n) AS a, max(upto) AS e FROM m JOIN k ON k.doc_id = m.doc_id AND k.k = m.k GROUP BY 1, 2),
w AS (SELECT *, CASE WHEN c = 1 AND lag(n) OVER o < 300 AND lag(n) OVER o + n <= 4000 THEN 0 ELSE c END AS d FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY c)),
r AS (SELECT doc_id, sum(n + 1) - 1 AS n, arg_min(p0, c) AS p0, arg_max(p1, c) AS p1, any_value(pages) AS pages, min(a) AS a, max(e) AS e, d FROM w GROUP BY doc_id, d)
SELECT doc_id AS key, row_number() OVER (PARTITION BY doc_id ORDER BY d)::INT - 1 AS chunk, (CASE WHEN pages > 1 THEN p0 ELSE a // 3000 + 1 END)::INT AS start_page, (CASE WHEN pages > 1 THEN p1 ELSE e // 3000 + 1 END)::INT AS end_page, n::INT AS n_chars FROM r""",
    "toc_detect": f"""WITH {PARA}, c AS (SELECT doc_id, pos, '1.' || pos || ' ' || content || ' .... ' || pos AS c FROM pa), e AS (SELECT *, regexp_matches(c, '{P.TOC_LINE}') AS e FROM c), r AS (SELECT *, sum((NOT e)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM e), k AS (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM r WHERE e), f AS (SELECT *, min(g) OVER (PARTITION BY doc_id) AS g0 FROM k WHERE n >= 5)
SELECT doc_id, count(*) AS n, max(CASE WHEN regexp_matches(c, '\\[.+?\\]') THEN NULL ELSE pos END) AS last_page FROM f WHERE g = g0 AND trim(CASE WHEN regexp_matches(c, '\\[.+?\\]') THEN regexp_extract(c, '\\[(.+?)\\]', 1) ELSE regexp_extract(c, '{P.TOC_NUMBERED}', 1) END) <> '' GROUP BY doc_id""",
    "glossary_terms": f"WITH {PARA} SELECT doc_id, count(*) AS n, md5(min(trim(regexp_extract('term ' || pos || ': ' || content, '{P.GLOSSARY_COLON}', 2)))) AS digest FROM pa WHERE pos > 0 AND regexp_matches('term ' || pos || ': ' || content, '{P.GLOSSARY_COLON}') GROUP BY 1",
    "section_noise": f"WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_custkey || ' ' ELSE '' END || upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) || CASE c_custkey % 4 WHEN 1 THEN ' Review' WHEN 2 THEN ' of Press' ELSE '' END AS t FROM customer) SELECT c_custkey FROM n WHERE length(t) < {P.LEAST_TITLE} OR {_like(P.PAGE_AND_NAME)} OR (length(t) <= {P.TITLE_CHARS} AND {_like(P.TITLE_SHAPE)} AND NOT {_like(P.TITLE_CONNECTIVES)} AND {_like(P.PUBLISHING)})",
    "opaque_tokens": r"""WITH w AS (SELECT doc_id, unnest(string_split_regex(text, '\s+')) AS t FROM documents), f AS (SELECT * FROM w WHERE length(t) >= 20)
SELECT doc_id, count(*) AS n FROM f WHERE regexp_matches(t, '(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$') OR regexp_matches(t, '(?i)^[0-9a-f]{16,}$') OR (regexp_matches(t, '^[A-Za-z0-9]+$') AND (length(t) - length(regexp_replace(t, '(?i)[aeiou]', '', 'g'))) / length(t)::DOUBLE < 0.15::DOUBLE) GROUP BY doc_id""",
    "slug_norm": r"""WITH n AS (SELECT p_partkey, p_name || ' ' || p_brand || ' (x)' AS s FROM part), g AS (SELECT *, regexp_replace(regexp_replace(lower(s), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM n)
SELECT p_partkey, slug, regexp_replace(lower(s), '[^a-z0-9]', '', 'g') AS norm_key, array_to_string(list_transform(string_split(slug, '-'), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') AS repaired FROM g""",
    "hash_dedup": "SELECT DISTINCT sha256(text) AS file_hash FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en')",
    "wiki_export": rf"""WITH {SECT}, l AS (SELECT page_id, string_agg('- [' || title || '](' || regexp_replace(regexp_replace(regexp_replace(trim(lower(title)), '\s+', '-', 'g'), '[^\w-]', '', 'g'), '-{{2,}}', '-', 'g') || '.md)', chr(10) ORDER BY pos) AS links FROM sec GROUP BY page_id)
SELECT p.page_id AS document_id, md5('# ' || {_h1} || chr(10) || chr(10) || coalesce(links, '')) AS digest FROM pages p LEFT JOIN l USING (page_id)""",
    "json_fields": "SELECT event_id, (props->>'k')::INT AS k FROM events",
    "rollup_entities": "WITH wd AS (SELECT doc_id AS node_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) >= 5))) AS slug FROM documents) SELECT node_id, md5(string_agg(slug, ',' ORDER BY slug)) AS digest, count(*) AS n FROM wd GROUP BY node_id",
    "tag_rollup": f"WITH {PARA}, t AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(content), '[a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ({STOP_SQL}))) AS tag FROM pa), c AS (SELECT doc_id, tag, count(*) AS n FROM t GROUP BY ALL) SELECT doc_id, md5(string_agg(tag, ',' ORDER BY n DESC, tag)) AS digest, sum(n)::BIGINT AS n FROM c GROUP BY doc_id",
}
