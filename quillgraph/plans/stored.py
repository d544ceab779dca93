"""Queries over what is stored or joined at scale: the text index, set similarity, wedges, vector lists, intervals."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillgraph.config import DEFAULT
from quillgraph import ingestion, providers
from quillgraph.functions import text as T
from quillgraph.operators import batchsearch, evaluate, intervals, resolution, search, textindex, vectorlists, verify
from quillgraph.plans import retrieval
from quillgraph.plans.exports import _slug, _words
from quillgraph.plans.graphs import SECT
from quillgraph.plans.retrieval import BM25, DOCS, TERMS, VECTOR
from quillgraph.sources import adapters as A
from quillgraph.sources import pages
from quillgraph.state import shared_folder, written


def _score():
    return F.round("score", 6).alias("score")


def postings_topk(spark, d):
    """BM25 from the stored index, which is written on first use."""
    index = textindex.stored(A.documents(spark, d).select("node_id", "content"), f"documents of {d}")
    return textindex.topk(spark, index, TERMS, DEFAULT.limit).select("node_id", _score())


def index_updates(spark, d):
    """An index that got French documents later, lost those of a source, and was merged: equal to a scan of what is left."""
    docs = A.documents(spark, d).select("node_id", "content", "lang", "source")
    french = F.coalesce(F.col("lang") == "fr", F.lit(False))
    index = textindex.build(docs.where(~french), f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    index = textindex.append(index, docs.where(french))
    index = textindex.delete(index, docs.where("source = 'src3'").select("node_id"), docs)
    found = [textindex.topk(spark, at, TERMS, DEFAULT.limit).select(F.lit(kind).alias("state"), "node_id", _score()) for kind, at in (("segments", index), ("merged", textindex.compact(spark, index)))]
    return found[0].unionByName(found[1])


def vector_lists(spark, d):
    """Nearest vectors from stored lists, exactly."""
    nodes = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("node_id"), "embedding")
    index = vectorlists.build(nodes, f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}")
    return vectorlists.search(spark, index, VECTOR, DEFAULT.vector_limit).select("node_id", F.round("score", 5).alias("score"))


def interval_overlaps(spark, d):
    """Documents that cover windows of time (parts give them, some open at one end): how many, and how much in all."""
    docs = A.documents(spark, d).join(A.table(spark, d, "documents").select(F.col("doc_id").alias("node_id"), "n_chars"), "node_id")
    docs = docs.select(F.col("node_id").alias("document_id"), "published", F.lit(None).cast("date").alias("coverage_start"), F.when(F.col("n_chars") % 3 > 0, F.date_add("published", (F.col("n_chars") % 400).cast("int"))).alias("coverage_end"))
    start = F.date_add(F.to_date(F.lit("1994-06-01")), (F.col("p_partkey") * 13 % 10000).cast("int"))
    windows = A.table(spark, d, "part").select(F.col("p_partkey").alias("window_id"), F.when(F.col("p_partkey") % 97 > 0, start).alias("date_from"), F.when(F.col("p_partkey") % 89 > 0, F.date_add(start, F.col("p_size") * 3)).alias("date_to"))
    return intervals.coverage_totals(docs, windows).select("document_id", "n", F.round("covered", 6).alias("covered"))


def _names(spark, d):
    p = A.table(spark, d, "part")
    words = F.split("p_name", " ")
    name = F.when(F.col("p_partkey") % 3 == 0, words[0]).when(F.col("p_partkey") % 7 == 0, F.array_join(F.reverse(words), " ")).otherwise(F.concat_ws(" ", "p_name", "p_type"))
    return p.select(F.col("p_partkey").alias("slug"), F.col("p_brand").alias("type"), name.alias("canonical"))


def type_variants(spark, d):
    """Forms of names over whole types: how many children each has."""
    return resolution.variant_counts(_names(spark, d))


def merge_chains(spark, d):
    """Parts merged by name and by price within a brand: chains of both end at one part."""
    p = A.table(spark, d, "part").select("p_partkey", "p_brand", F.floor(F.col("p_retailprice") / 5).alias("k"))
    least = p.groupBy("p_brand", "k").agg(F.min("p_partkey").alias("survivor"))
    priced = p.join(least, ["p_brand", "k"]).select(F.col("p_partkey").alias("slug"), "survivor")
    return resolution.final_survivors([resolution.same_words(_names(spark, d)), priced])


def provider_chain(spark, d):
    """Descriptions of documents by two models, the second for what the first leaves: calls and tokens of each."""
    docs = A.table(spark, d, "documents").select(F.sha2(F.concat_ws("-", "doc_id", "text"), 256).alias("key"), F.coalesce("text", F.lit("")).alias("prompt"))

    class Whole:
        def answer(self, requests):
            return requests.select("key", F.left("prompt", F.lit(100)).alias("payload"), F.lit(7).alias("output_tokens"))

    chain = providers.Chain([("sentences", providers.FirstSentence()), ("whole", Whole())], accept=lambda p: F.length(p) <= 60)
    return providers.usage(chain.calls(docs))


#: Settings of the ablation: all phases, one alone, one left out, and equal weights.
SETTINGS = {
    "all": {"fulltext": 1.0, "entity_pivot": 0.6, "structural": 0.3},
    "fulltext": {"fulltext": 1.0}, "entity_pivot": {"entity_pivot": 1.0}, "structural": {"structural": 1.0},
    "no_fulltext": {"entity_pivot": 0.6, "structural": 0.3}, "no_entity_pivot": {"fulltext": 1.0, "structural": 0.3}, "no_structural": {"fulltext": 1.0, "entity_pivot": 0.6},
    "equal": {"fulltext": 1.0, "entity_pivot": 1.0, "structural": 1.0},
}


def ablation_matrix(spark, d):
    """Every hundredth document asks for the documents of its text, by its long words: metrics under eight settings."""
    docs = A.documents(spark, d).select("node_id", "content", "file_hash")
    words = textindex.counted_words(docs, "content").select("node_id", "dl", F.filter("words", lambda w: F.length(w) >= 9).alias("words"))
    words = written(words, "words")  # texts are split once
    size = words.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("dl") > 0, F.col("dl"))), F.lit(0)).alias("length")).first()
    tf = written(words.select("node_id", "dl", F.explode("words").alias("word")).groupBy("node_id", "dl", "word").agg(F.count("*").alias("tf")), "tf")
    asked = tf.where(F.col("node_id") % 100 == 0).select(F.col("node_id").alias("query_id"), "word")
    near = docs.where("node_id % 100 = 0").select(F.col("node_id").alias("query_id"), F.explode(F.array(F.col("node_id") - 1, F.col("node_id") + 1)).alias("node_id"))
    near = near.join(docs.select("node_id"), "node_id", "left_semi")
    postings, asked = (written(x, name) for x, name in zip(batchsearch.weighted_words(tf, size["n"], size["length"], asked), ("postings", "asked")))
    weights = [(w.get("fulltext", 0.0), w.get("entity_pivot", 0.0)) for w in SETTINGS.values()]
    pairs = batchsearch.best_pairs(postings, asked, size["n"], weights, 10)
    # A neighbour counts with whatever words it shares.
    shared = near.join(asked, "query_id").join(postings, ["node_id", "word"]).groupBy("query_id", "node_id").agg(F.sum("s").alias("fulltext"), F.count("*").alias("c"))
    shared = shared.join(asked.groupBy("query_id").agg(F.count("*").alias("_n")), "query_id").join(pairs, ["query_id", "node_id"], "left_anti")
    pairs = pairs.unionByName(shared.select("query_id", "node_id", "fulltext", (F.col("c") / F.col("_n")).alias("words")))
    phases = {
        "fulltext": pairs.select("query_id", "node_id", F.col("fulltext").alias("score")), "entity_pivot": pairs.select("query_id", "node_id", F.col("words").alias("score")),
        "structural": near.withColumn("score", F.lit(1.0)),
    }
    gold = docs.where("node_id % 100 = 0").select(F.col("node_id").alias("query_id"), "file_hash").join(docs.select("node_id", "file_hash"), "file_hash").select("query_id", "node_id")
    rows = evaluate.matrix(phases, gold, SETTINGS)
    return rows.select("config", "n_queries", *[F.round(c, 6).alias(c) for c in ("hits_1", "hits_4", "hits_10", "mrr", "map", "gold_recall", "ndcg")])


def ingest_graph(spark, d):
    """Pages taken in as two batches: how many edges of each structural kind the graph has, and issues of the verifier."""
    crawled = A.texts(spark, d, "pages").select(F.col("page_id").cast("string").alias("document_id"), T.html_markdown(F.col("html")).alias("text"), F.sha2(F.concat_ws("-", "page_id", "html"), 256).alias("file_hash"))
    crawled = written(crawled, "pages")
    store = ingestion.Store(f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}")
    for k in range(2):
        ingestion.add_batch(spark, store, crawled.where(F.col("document_id").cast("long") % 2 == k), f"b{k}")
    edges = store.read(spark, "edges")
    issues = verify.verify(store.read(spark, "documents").select(F.col("document_id").alias("node_id")), store.read(spark, "sections"), store.read(spark, "paragraphs"), edges)
    broken = issues.where("severity = 'error'").agg(F.lit("errors").alias("relation"), F.count("*").alias("n"))
    return edges.groupBy("relation").agg(F.count("*").alias("n")).unionByName(broken)


def page_files(spark, d):
    """A page for each part under its name: written as files, read back. Parts of one name keep a page each."""
    p = A.table(spark, d, "part").select("p_partkey", F.concat(F.lit("entities/"), T.wiki_slug(F.col("p_name")), F.lit(".md")).alias("path"), F.concat(F.lit("# "), F.col("p_name"), F.lit("\n"), F.col("p_brand")).alias("body"))
    uri = f"{shared_folder(spark)}/wiki-{uuid.uuid4().hex}"
    uri = uri if "://" in uri else "file://" + uri.removeprefix("file:")
    kept = written(pages.unique_paths(p, "p_partkey"), "pages")
    pages.write_pages(kept, uri)
    return pages.read_pages(spark, uri, kept).select("path", F.md5("body").alias("digest"))


QUERIES = {f.__name__: f for f in (postings_topk, index_updates, vector_lists, interval_overlaps, type_variants, merge_chains, provider_chain, ablation_matrix, ingest_graph, page_files)}

_top = "SELECT node_id, round(score, 6) AS score FROM (SELECT * FROM bm WHERE score > 0 ORDER BY score DESC, node_id LIMIT 20)"
_left = BM25.replace(DOCS, DOCS.replace("FROM documents", "FROM documents WHERE coalesce(source, '') <> 'src3'"))

_named = f"""nm AS (SELECT p_partkey AS slug, p_brand AS type, CASE WHEN p_partkey % 3 = 0 THEN string_split(p_name, ' ')[1] WHEN p_partkey % 7 = 0 THEN string_split(p_name, ' ')[2] || ' ' || string_split(p_name, ' ')[1] ELSE p_name || ' ' || p_type END AS canonical FROM part),
wn AS (SELECT slug, type, {_words.format(x="canonical")} AS w FROM nm)"""
_early, _late = "DATE '1000-01-01'", "DATE '3000-01-01'"

_sent = r"left(regexp_extract(p, '(?s)^\s*(.*?[.!?])(?:\s|$)', 1), 300)"
_w = "CASE config " + " ".join(f"WHEN '{c}' THEN CASE phase " + " ".join(f"WHEN '{p}' THEN {w!r}::DOUBLE" for p, w in s.items()) + " ELSE 0.0 END" for c, s in SETTINGS.items()) + " END"

ORACLE = {
    "page_files": "WITH s AS (SELECT p_partkey, p_name, p_brand, " + _slug.format(x="p_name") + " AS slug FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) AS k FROM s) SELECT 'entities/' || slug || CASE WHEN k > 1 THEN '~' || k ELSE '' END || '.md' AS path, md5('# ' || p_name || chr(10) || p_brand) AS digest FROM k",
    "ingest_graph": f"""WITH {SECT}, ln AS (SELECT page_id, pos, regexp_matches(line, '^#{{1,6}} \\S') AS head, trim(line) = '' AS blank FROM ml),
ru AS (SELECT *, sum((head OR blank)::INT) OVER w AS run, max(CASE WHEN head THEN pos END) OVER w AS sec_at FROM ln WINDOW w AS (PARTITION BY page_id ORDER BY pos)),
bl AS (SELECT DISTINCT page_id, run, sec_at FROM ru WHERE NOT head AND NOT blank)
SELECT 'HAS_CHILD' AS relation, count(*) AS n FROM nest HAVING count(*) > 0 UNION ALL SELECT 'NEXT_SIBLING', count(*) - count(DISTINCT (page_id, coalesce(parent, -1))) FROM nest HAVING count(*) > count(DISTINCT (page_id, coalesce(parent, -1)))
UNION ALL SELECT 'BELONGS_TO', count(*) FROM bl HAVING count(*) > 0 UNION ALL SELECT 'NEXT_PARA', count(*) - count(DISTINCT (page_id, coalesce(sec_at, -1))) FROM bl HAVING count(*) > count(DISTINCT (page_id, coalesce(sec_at, -1))) UNION ALL SELECT 'errors', 0""",
    "provider_chain": f"""WITH r AS (SELECT coalesce(text, '') AS p FROM documents GROUP BY doc_id, text), s AS (SELECT p, {_sent} AS a FROM r), o AS (SELECT p, a, trim(a) <> '' AND length(a) <= 60 AS ok FROM s),
c AS (SELECT 'sentences' AS model, ok, ceil(length(p) / 4.0) AS pt, ceil(length(a) / 4.0) AS ot FROM o UNION ALL SELECT 'whole', trim(left(p, 100)) <> '' AND length(left(p, 100)) <= 60, ceil(length(p) / 4.0), 7 FROM o WHERE NOT ok)
SELECT model, count(*) AS n_calls, count(*) FILTER (WHERE ok) AS n_answered, sum(pt)::BIGINT AS prompt_tokens, sum(ot)::BIGINT AS output_tokens FROM c GROUP BY model""",
    "ablation_matrix": f"""WITH {BM25.split("tok AS")[0]} tok AS{BM25.split("tok AS")[1].split("stat AS")[0]} tf AS (SELECT node_id, dl, t, count(*) AS tf FROM (SELECT node_id, len(w) AS dl, unnest(w) AS t FROM tok) GROUP BY ALL),
stat AS (SELECT count(*) AS n, sum(len(w)) / count(*)::DOUBLE AS avgdl FROM tok), asked AS (SELECT node_id AS query_id, t FROM tf WHERE node_id % 100 = 0 AND length(t) >= 9), df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
ph AS (SELECT 'fulltext' AS phase, query_id, node_id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score FROM asked JOIN tf USING (t) JOIN df USING (t), stat GROUP BY query_id, node_id
 UNION ALL SELECT 'entity_pivot', query_id, node_id, count(*) / any_value(c)::DOUBLE FROM asked JOIN tf USING (t) JOIN (SELECT query_id, count(*) AS c FROM asked GROUP BY 1) USING (query_id) GROUP BY query_id, node_id
 UNION ALL SELECT 'structural', a.node_id, b.node_id, 1.0 FROM docs a JOIN docs b ON abs(a.node_id - b.node_id) = 1 WHERE a.node_id % 100 = 0),
sc AS (SELECT *, score / max(score) OVER (PARTITION BY query_id, phase) AS scaled FROM ph), cf AS (SELECT unnest([{", ".join(repr(c) for c in SETTINGS)}]) AS config),
fu AS (SELECT config, query_id, node_id, sum({_w} * scaled) AS s FROM sc, cf GROUP BY ALL HAVING max({_w}) > 0), rk AS (SELECT *, row_number() OVER (PARTITION BY config, query_id ORDER BY s DESC, node_id) AS rank FROM fu QUALIFY rank <= 10),
gold AS (SELECT a.node_id AS query_id, b.node_id FROM docs a JOIN docs b ON a.content = b.content WHERE a.node_id % 100 = 0), ng AS (SELECT query_id, count(*) AS g FROM gold GROUP BY 1),
hit AS (SELECT config, query_id, rank, row_number() OVER (PARTITION BY config, query_id ORDER BY rank) AS k FROM rk JOIN gold USING (query_id, node_id)),
h AS (SELECT cf.config, ng.query_id, g, min(rank) AS first, count(rank) AS hits, coalesce(sum(k / rank::DOUBLE), 0) / least(g, 10) AS ap FROM ng CROSS JOIN cf LEFT JOIN hit ON hit.query_id = ng.query_id AND hit.config = cf.config GROUP BY cf.config, ng.query_id, g)
SELECT config, count(*) AS n_queries, round(avg((coalesce(first, 99) <= 1)::INT), 6) AS hits_1, round(avg((coalesce(first, 99) <= 4)::INT), 6) AS hits_4, round(avg((coalesce(first, 99) <= 10)::INT), 6) AS hits_10, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr, round(avg(ap), 6) AS map, round(avg(hits / g::DOUBLE), 6) AS gold_recall, round(avg(coalesce(1.0 / log2(first + 1.0), 0)), 6) AS ndcg FROM h GROUP BY config""",
    "vector_lists": retrieval.ORACLE["vector_topk"],
    "interval_overlaps": f"""WITH {DOCS}, c AS (SELECT node_id AS document_id, published AS a, coalesce(CASE WHEN n_chars % 3 > 0 THEN published + (n_chars % 400)::INT END, published) AS b FROM docs JOIN (SELECT doc_id, n_chars FROM documents) n ON n.doc_id = node_id),
w0 AS (SELECT p_partkey AS window_id, DATE '1994-06-01' + (p_partkey * 13 % 10000)::INT AS s, * FROM part), w AS (SELECT window_id, CASE WHEN p_partkey % 97 > 0 THEN s END AS f, CASE WHEN p_partkey % 89 > 0 THEN s + p_size * 3 END AS t FROM w0),
wd AS (SELECT window_id, coalesce(f, {_early}) AS f, coalesce(t, {_late}) AS t FROM w WHERE f IS NOT NULL OR t IS NOT NULL)
SELECT document_id, count(*) AS n, round(sum(least((least(b, t) - greatest(a, f)) / greatest(t - f, 1)::DOUBLE, 1.0)), 6) AS covered FROM c JOIN wd ON b >= f AND a <= t GROUP BY document_id""",
    "type_variants": f"WITH {_named} SELECT p.type, p.slug AS parent, count(*) AS n, min(c.slug) AS first FROM wn p JOIN wn c ON p.type = c.type AND len(p.w) > 0 AND len(p.w) < len(c.w) AND list_has_all(c.w, p.w) GROUP BY 1, 2",
    "merge_chains": f"""WITH RECURSIVE {_named}, g AS (SELECT slug AS a, min(slug) OVER (PARTITION BY type, w) AS b FROM wn WHERE len(w) > 0 UNION ALL SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand, floor(p_retailprice / 5)) FROM part),
e AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM g UNION ALL SELECT b, a FROM g) WHERE a <> b), r(slug, m) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.a, r.m FROM r JOIN e ON e.b = r.slug)
SELECT slug, min(m) AS survivor FROM r GROUP BY slug HAVING min(m) <> slug""",
    "postings_topk": f"WITH {BM25} {_top}",
    "index_updates": f"WITH {_left}, t AS ({_top}) SELECT a.state, t.* FROM t, (VALUES ('segments'), ('merged')) a(state)",
}
