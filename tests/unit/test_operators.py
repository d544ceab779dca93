"""Operators on small frames, computed by hand."""

import collections
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillgraph import api, engine
from quillgraph.functions import vector as V
from quillgraph.operators import answer, docproc, evaluate, exports, fusion, graph, ingest, louvain, mutate, report, search, verify
from quillgraph.sources import layouts
from quillgraph.streaming import feeds


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def edges(spark, pairs, relation="E"):
    return spark.createDataFrame([(a, b, relation) for a, b in pairs], "src string, dst string, relation string")


def test_fusion_adds_contributions(spark):
    make = lambda data: spark.createDataFrame(data, "node_id string, score double")
    parts = fusion.contributions({"fulltext": make([("a", 10.0), ("b", 5.0)]), "sumo": make([("b", 0.5)])}, {"fulltext": 1.0, "sumo": 0.32})
    fused = {r["node_id"]: r for r in fusion.fuse(parts).collect()}
    assert fused["a"]["score"] == pytest.approx(1.0) and fused["b"]["score"] == pytest.approx(0.82)
    assert fused["b"]["n_contributions"] == 2 and fused["b"]["sources"] == ["fulltext", "sumo"]
    # Scaling a phase doesn't change the result.
    scaled = fusion.contributions({"fulltext": make([("a", 100.0), ("b", 50.0)]), "sumo": make([("b", 7.0)])}, {"fulltext": 1.0, "sumo": 0.32})
    assert {r["node_id"]: round(r["score"], 9) for r in fusion.fuse(scaled).collect()} == {k: round(v["score"], 9) for k, v in fused.items()}


def test_percentile_floor_is_a_rank(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 4.0)], "s double")
    assert fusion.percentile_floor(df, "s", 0.75).first()["floor"] == 4.0


def test_bm25_prefers_rare_terms_and_prefixes_agree(spark):
    docs = spark.createDataFrame([(1, "apple banana"), (2, "apple apple"), (3, "cherry banana"), (4, None)], "node_id long, content string")
    found = [r["node_id"] for r in search.bm25_topk(docs, ["apple", "cherry"], 3).collect()]
    assert set(found) == {1, 2, 3} and found[0] == 3
    assert [r["node_id"] for r in search.bm25_topk(docs, ["apple", "cherry"], 1).collect()] == found[:1]


def test_dice_and_jaccard(spark):
    members = spark.createDataFrame([(1, x) for x in "abc"] + [(2, x) for x in "ab"], "set_id long, item string")
    r = graph.set_similarity(members).first()
    assert (r["shared"], r["dice"]) == (2, 0.8) and r["jaccard"] == pytest.approx(2 / 3)


def test_adamic_adar(spark):
    # x and y share u (degree 2) and v (degree 3)
    found = graph.adamic_adar(edges(spark, [("u", "x"), ("u", "y"), ("v", "x"), ("v", "y"), ("v", "z")]))
    assert {(r["src"], r["dst"]): round(r["weight"], 4) for r in found.collect()}[("x", "y")] == 2.3529


def test_traverse_filters_the_last_edge_only(spark):
    e = edges(spark, [("a", "b")], "X").unionByName(edges(spark, [("b", "c")], "Y"))
    start = spark.createDataFrame([("a",)], "node_id string")
    assert rows(graph.traverse(e, start, 2, ["Y"]), "node_id", "hops") == [("c", 2)]
    assert rows(graph.traverse(e, start, 2, ["Y"], prune=True), "node_id") == []
    assert rows(graph.traverse(e, start, 2, any_direction=True), "node_id", "hops") == [("b", 1), ("c", 2)]


def test_labels_ties_go_to_the_smaller(spark):
    found = graph.label_propagation(edges(spark, [("c", "a"), ("c", "b")]), 1)
    assert dict(rows(found, "node_id", "label"))["c"] == "a"


def test_precedes_orders_by_date(spark):
    dates = spark.createDataFrame([("a", "2001-01-01"), ("b", "1999-01-01"), ("c", None)], "node_id string, published string")
    assert rows(graph.precedes(edges(spark, [("a", "b"), ("a", "c")]), dates), "src", "dst") == [("b", "a")]


def test_upkeep(spark):
    nodes = spark.createDataFrame([("d", None), ("p", "d"), ("q", "e")], "node_id string, document_id string")
    left, kept = graph.cascade_delete(nodes, edges(spark, [("d", "p"), ("q", "p"), ("q", "q")]), "d")
    assert rows(left, "node_id") == [("q",)] and rows(kept, "src", "dst") == [("q", "q")]
    assert rows(graph.dangling(edges(spark, [("d", "x"), ("d", "p")]), nodes), "dst") == [("x",)]


def test_merges(spark):
    e = spark.createDataFrame([("A-b", "ab", 2, 5), ("ab", "ab", 9, 7), ("c", "c", 1, 1)], "slug string, norm_key string, mention_count int, first_seen int")
    moved = mutate.repoint(edges(spark, [("A-b", "c"), ("ab", "c"), ("ab", "A-b")]), mutate.survivors(e))
    assert rows(moved, "src", "dst") == [("ab", "c")]
    base = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert rows(mutate.patch(base, spark.createDataFrame([(1, "z")], "k int, v string"), "k"), "k", "v") == [(1, "z"), (2, "y")]


def test_fragments_join_their_paragraph(spark):
    long = "A paragraph that is certainly long enough to stand by itself here."
    lines = spark.createDataFrame([(1, 0, long), (1, 1, "and more"), (1, 2, long), (2, 0, "tiny")], "doc_id int, pos int, content string")
    found = rows(docproc.reattach_fragments(lines, ["doc_id"], "pos"), "doc_id", "start", "content")
    assert found == [(1, 0, long + " and more"), (1, 2, long), (2, 0, "tiny")]


def test_sections_nest(spark):
    s = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 3), (1, 3, 2), (1, 4, 1)], "doc int, pos int, level int")
    assert rows(docproc.nest_sections(s, "doc", "pos"), "pos", "parent_position") == [(0, None), (1, 0), (2, 1), (3, 0), (4, None)]


def test_chunks(spark):
    text = "".join(f"# Chapter {k}\n" + "word " * 100 + "\n" for k in range(3))
    docs = spark.createDataFrame([(1, text), (2, None), (3, "# Heading\n\nSome content here."), (4, "a\n-----\nb\n-----\n"), (5, "")], "id long, t string")
    found = docproc.chunk_markdown(docs, "id", "t", most=500, least=100).collect()
    by = lambda k: sorted((r["chunk"], r["heading"], r["heading_level"], r["start_page"], r["end_page"], r["page_source"]) for r in found if r["key"] == k)
    assert by(1) == [(0, "Chapter 0", 1, 1, 1, "virtual"), (1, "Chapter 1", 1, 1, 1, "virtual"), (2, "Chapter 2", 1, 1, 1, "virtual")]
    assert by(2) == [] and by(5) == []
    assert by(3) == [(0, "Heading", 1, 1, 1, "virtual")]
    assert by(4) == [(0, None, None, 1, 3, "physical")]
    assert "".join(r["text"] for r in sorted(found, key=lambda r: r["chunk"]) if r["key"] == 1) == text


def test_short_chunks_join(spark):
    """A short chunk goes to the one before it, a short first one takes the second in."""
    text = "# A\n" + "x" * 20 + "\n# B\n" + "y" * 200 + "\n# C\n" + "z" * 30
    found = docproc.chunk_markdown(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t", most=400, least=60).collect()
    assert [(r["heading"], r["text"].count("\n# ")) for r in found] == [("A", 2)] or len(found) == 1
    cut = docproc.chunk_markdown(spark.createDataFrame([(1, "# A\n" + "x" * 120 + "\n# B\n" + "y" * 380)], "id long, t string"), "id", "t", most=400, least=60).collect()
    assert [r["heading"] for r in sorted(cut, key=lambda r: r["chunk"])] == ["A", "B"]


def _lines(spark, text):
    return spark.createDataFrame([(1, k, x) for k, x in enumerate(text.split("\n"))], "doc int, pos int, content string")


def test_contents_in_all_formats(spark):
    text = "intro\n## Table of Contents\n1. **First chapter . . .**\n[Second](#second)\nA dotted entry ........ 12\n**3**\n**ix 9**\n# Next\n1.1 Not here ..... 4"
    assert rows(docproc.table_of_contents(_lines(spark, text), "doc", "pos"), "title", "level", "page") == [("A dotted entry", 2, 12), ("First chapter", 1, 12), ("Second", 1, 3)]
    run = "\n".join(["x", *[f"1.{k} Heading {k} ..... {k + 3}" for k in range(3)], "", "- [Link](#link)", "2. Last one ...... 40", "y"])
    found = rows(docproc.table_of_contents(_lines(spark, run), "doc", "pos"), "entry", "title", "page")
    assert found == [(1, "Heading 0", 3), (2, "Heading 1", 4), (3, "Heading 2", 5), (5, "Link", None), (6, "Last one", 40)]
    assert docproc.table_of_contents(_lines(spark, "1.1 Only ..... 4\n1.2 Two ..... 5"), "doc", "pos").count() == 0


def test_glossary(spark):
    text = "**no**: not below a heading\n## Glossary\n**Hash** - a digest\nNonce: a number used once\n| Term | What it is |\n|---|---|\n# After\nOther: not a term"
    assert rows(docproc.glossary(_lines(spark, text), "doc", "pos"), "term", "definition") == [("Hash", "a digest"), ("Nonce", "a number used once"), ("Term", "What it is")]


def test_label_propagation_against_a_loop(spark):
    r = random.Random(4)
    pairs = sorted({tuple(sorted(r.sample(range(40), 2))) for _ in range(70)})
    near = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    label, still, half = {k: k for k in near}, 0, 0
    while still < 2 and half < 60:
        new = dict(label)
        for k in near:
            if k % 2 == half % 2:
                votes = collections.Counter(label[x] for x in near[k])
                new[k] = min(votes, key=lambda y: (-votes[y], y))
        still, label, half = (still + 1 if new == label else 0), new, half + 1
    got = graph.label_propagation(spark.createDataFrame(pairs, "src int, dst int"), turn=F.col("node_id") % 2)
    assert {r["node_id"]: r["label"] for r in got.collect()} == label


def test_louvain_finds_planted_groups(spark):
    r = random.Random(1)
    pairs = [(a, b) for a in range(60) for b in range(a) if r.random() < (0.5 if a // 20 == b // 20 else 0.02)]
    found = louvain.louvain(spark.createDataFrame(pairs, "src int, dst int"))
    label = {x["node_id"]: x["label"] for x in found.collect()}
    assert len(label) == 60 and [len({label[k] for k in range(g, g + 20)}) for g in (0, 20, 40)] == [1, 1, 1] and len(set(label.values())) == 3
    assert all(v == min(k for k in label if label[k] == v) for v in set(label.values()))
    edges_ = spark.createDataFrame(pairs, "src int, dst int")
    degree = collections.Counter(x for p in pairs for x in p)
    plain = sum(label[a] == label[b] for a, b in pairs) / len(pairs) - sum((sum(degree[k] for k in label if label[k] == v) / (2 * len(pairs))) ** 2 for v in set(label.values()))
    assert louvain.modularity(edges_, found) == pytest.approx(plain)
    assert louvain.louvain(edges_.limit(0)).count() == 0


def test_periodic_upkeep(spark, tmp_path):
    runs = []
    query = feeds.periodic(spark, lambda: runs.append(1), str(tmp_path / "cp"), "1 second")
    for _ in range(60):
        if len(runs) > 1:
            break
        time.sleep(0.5)
    query.stop()
    assert len(runs) > 1


def test_percentile_floor(spark):
    df = spark.createDataFrame([(float(x),) for x in (4, 2, 1, 3)] + [(None,)], "s double")
    assert fusion.percentile_floor(df, "s", 0.75).first()["floor"] == 4.0
    many = spark.createDataFrame([(float(k % 3),) for k in range(1000)], "s double")
    assert fusion.percentile_floor(many, "s", 0.5).first()["floor"] == 1.0
    assert fusion.percentile_floor(df.limit(0), "s", 0.5).count() == 0


def test_verified_and_checked(spark):
    entries = spark.createDataFrame([(1, "principal", False), (2, "structural", False), (3, "structural", True), (4, "structural", False)], "node_id int, provenance string, ok boolean")
    documents = spark.createDataFrame([(1, 7), (1, 8), (2, 7), (2, 8), (3, 7), (3, 8), (4, 7)], "node_id int, document_id int")
    assert rows(answer.verified(entries, documents, F.col("ok")), "node_id") == [(1,), (3,), (4,)]
    assert rows(answer.self_checked(entries, F.col("ok")), "node_id") == [(3,)]
    assert answer.self_checked(entries, F.lit(None).cast("boolean")).count() == 4


def test_agent_uses_each_tool_once(spark):
    tools = {name: (lambda q, k=k: spark.createDataFrame([("a", float(k)), (f"n{k}", 1.0)], "node_id string, score double")) for k, name in enumerate("wxyz")}
    found, trace = answer.agent(spark, "q", tools, lambda q, left, trace: left[-1] if len(trace) < 3 else None)
    assert trace == ["z", "y", "x"] and rows(found, "node_id", "score") == [("a", 3.0), ("n1", 1.0), ("n2", 1.0), ("n3", 1.0)]
    assert answer.agent(spark, "q", tools, lambda *_: "none")[0].count() == 0


class Canned:
    """Answers that a model may give: good JSON, broken JSON, none."""

    def answer(self, requests):
        good = F.concat(F.lit('```json {"nodes":[{"type":"Section","title":"T"},{"type":"Paragraph","content":"'), F.col("prompt"), F.lit('"},]}```'))
        return requests.select("key", F.when(F.col("prompt") == "fine", good).otherwise("no json").alias("payload"))


def test_structured_chunks(spark):
    chunks = spark.createDataFrame([(1, 0, "fine"), (1, 1, "broken"), (2, 0, "fine")], "document_id int, chunk int, text string")
    empty = spark.createDataFrame([], "key string, payload string")
    nodes, new = ingest.structured_chunks(chunks, empty, Canned())
    assert rows(nodes, "document_id", "chunk", "pos", "node_type", "status") == [(1, 0, 0, "Section", "structured"), (1, 0, 1, "Paragraph", "structured"), (1, 1, 0, "Paragraph", "llm_pending"), (2, 0, 0, "Section", "structured"), (2, 0, 1, "Paragraph", "structured")]
    assert nodes.where("status = 'llm_pending'").first()["content"] == "broken" and new.count() == 2
    assert ingest.structured_chunks(chunks, new, Canned())[1].count() == 0


def test_tags_of_a_service(spark):
    answers = spark.createDataFrame([("a", '{"sumo_tags": ["Dog"]}'), ("b", 'tags: "Dog", "Cat" and "Unknown"'), ("c", "none")], "key string, payload string")
    terms = spark.createDataFrame([("Dog",), ("Cat",)], "term string")
    assert rows(ingest.read_tags(answers, terms), "key", "tags") == [("a", ["Dog"]), ("b", ["Dog", "Cat"]), ("c", [])]


def test_sections_of_pages(spark):
    """Five pages a window; the short last part goes to the more similar side."""
    vector = lambda k: [1.0, 0.0] if k < 10 else [0.0, 1.0] if k < 20 else [0.9, 0.1]
    pages = spark.createDataFrame([(1, k, vector(k)) for k in range(22)] + [(2, 0, [1.0, 0.0])], "document_id int, page int, vector array<double>")
    found = ingest.page_sections(pages, V.cosine(F.col("vector"), F.col("before")) < 0.5)
    assert rows(found, "document_id", "first_page", "last_page") == [(1, 0, 9), (1, 10, 21), (2, 0, 0)]


def test_evidence(spark):
    lead = "the quick brown fox jumps over the lazy dog and runs away"
    results = spark.createDataFrame([(1, 10, "It says: The quick  brown fox jumps over the lazy dog and runs away."), (1, 11, "other"), (2, 10, lead)], "query_id int, node_id int, content string")
    evidence = spark.createDataFrame([(1, 5, lead), (1, 6, "short"), (2, 7, lead + " into the woods")], "query_id int, evidence_id int, evidence string")
    assert rows(report.evidence_matches(results, evidence), "query_id", "node_id", "evidence_id") == [(1, 10, 5), (2, 10, 7)]


def test_exports(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 2, "b"), (1, 1, None)], "document_id int, doc_position int, title string").withColumns({"level": F.lit(1), "node_id": F.col("doc_position")})
    assert [r["node_id"] for r in report.in_tree_order(nodes).collect()] == [1, 2]
    exports.write_json({"sections": nodes}, str(tmp_path))
    assert spark.read.json(f"{tmp_path}/sections").count() == 2
    listed = exports.entity_listing(spark.createDataFrame([("ORG", "beta"), ("ORG", "Alpha")], "type string, name string")).first()
    assert listed["path"] == "entities/org.md" and listed["body"].endswith("- [[Alpha]]\n- [[beta]]")


def test_metrics(spark):
    results = spark.createDataFrame([(q, k + 1, k) for q in (1, 2, 3) for k in range(10)], "query_id int, rank int, node_id int")
    gold = spark.createDataFrame([(1, 0), (2, 2), (3, 99)], "query_id int, node_id int")
    m = evaluate.metrics(evaluate.hit_ranks(results, gold)).first()
    assert round(m["mrr"], 4) == 0.4444 and round(m["hits_4"], 4) == 0.6667 and m["ndcg"] == pytest.approx(0.5)
    two = spark.createDataFrame([(1, 0), (1, 2)], "query_id int, node_id int")
    assert evaluate.hit_ranks(results, two).first()["average_precision"] == pytest.approx((1 + 2 / 3) / 2)


def test_verifier_finds_planted_faults(spark):
    docs = spark.createDataFrame([("d",)], "node_id string")
    sections = spark.createDataFrame([("s", "d", None, 1), ("t", "d", "s", 3)], "node_id string, document_id string, parent_id string, level int")
    paras = spark.createDataFrame([("p", "d", "s", " ", ["x"])], "node_id string, document_id string, section_id string, content string, tags array<string>")
    e = edges(spark, [("d", "s"), ("s", "t"), ("s", "t")], "HAS_CHILD").unionByName(edges(spark, [("p", "gone")], "BELONGS_TO"))
    codes = {r["code"] for r in verify.verify(docs, sections, paras, e).collect()}
    assert codes == {"DUPLICATE_EDGES", "LEVEL_GAP", "EMPTY_PARAGRAPHS", "DEAD_EDGES"}


def test_spot_checks_and_legacy_parents(spark):
    text = "\n\n".join(f"Paragraph number {k} says that the {k} things are as they have been before {'x' * k}." for k in range(10))
    sources = spark.createDataFrame([("a", text), ("b", text), ("c", text), ("d", "short")], "document_id string, text string")
    parts = text.split("\n\n")
    paras = spark.createDataFrame([*(("a", p.upper()) for p in parts), *(("b", p) for p in parts[:5]), ("c", parts[0])], "document_id string, content string")
    assert rows(verify.spot_checks(sources, paras), "code", "node_id") == [("SPOT_CHECK_FAILED", "c"), ("SPOT_CHECK_PARTIAL", "b")]
    sections = spark.createDataFrame([("s", "d", None, 1), ("t", "d", "sections/s", 2), ("u", "d", "gone", 2)], "node_id string, document_id string, parent_id string, level int")
    docs = spark.createDataFrame([("d",)], "node_id string")
    none = spark.createDataFrame([], "node_id string, document_id string, section_id string, content string, tags array<string>")
    found = {(r["code"], r["node_id"]) for r in verify.verify(docs, sections, none, edges(spark, [("d", "s"), ("s", "t")], "HAS_CHILD")).collect()}
    assert {("LEGACY_PARENT_SECTION_ID", "t"), ("MISSING_SECTION_PARENT_EDGE", "u"), ("DANGLING_PARENT_SECTION_ID", "u")} <= found
    assert ("DANGLING_PARENT_SECTION_ID", "t") not in found


def test_layouts(spark):
    okf = '{"nodes":[{"type":"Section","title":"A","metadata":{"page":2,"level":1}},{"type":"Table","table":{"content_data":[["h"],["v"]]}},]}'
    mineru = '{"pdf_body":[{"type":"title","text":"T","level":1},{"type":"text","text":"x"},{"type":"table","table_cells":[["h"],["v"]]}]}'
    docling = '{"document":{"name":"n","texts":[{"label":"heading_2","text":"H"},{"label":"list_item","text":"i"}],"tables":[{"markdown":"| t |"}]}}'
    df = spark.createDataFrame([(1, okf, mineru, docling)], "id int, a string, b string, c string")
    assert rows(layouts.okf_nodes(df, "id", "a"), "pos", "node_type", "content") == [(0, "Section", None), (1, "Table", "| h |\n| --- |\n| v |")]
    assert rows(layouts.mineru_nodes(df, "id", "b"), "pos", "node_type", "level") == [(0, "Section", 1), (1, "Paragraph", None), (2, "Table", None)]
    assert rows(layouts.docling_nodes(df, "id", "c"), "pos", "node_type", "level") == [(0, "Section", 2), (1, "ListItem", None), (2, "Table", None)]


def test_streams(spark, tmp_path):
    data = spark.createDataFrame([(1, "positive"), (1, "negative"), (2, "positive")], "result_rank int, signal string")
    data.write.parquet(str(tmp_path / "in"))
    stream = feeds.source(spark, str(tmp_path / "in"), data.schema)
    feeds.run_available(feeds.rank_counts(stream), "ranks", str(tmp_path / "cp"))
    assert rows(spark.table("ranks"), "result_rank", "positive", "negative") == [(1, 1, 1), (2, 1, 0)]
    out = str(tmp_path / "out")
    files = spark.createDataFrame([("h1",), ("h1",), ("h2",)], "file_hash string")
    files.write.parquet(str(tmp_path / "files"))
    stored = lambda: spark.createDataFrame([("h2", "complete")], "file_hash string, ingestion_status string")
    feeds.ingest(feeds.source(spark, str(tmp_path / "files"), files.schema), stored, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/{n}"), str(tmp_path / "cp2"))
    assert rows(spark.read.parquet(f"{out}/0"), "file_hash") == [("h1",)]


def small_graph(spark):
    paras = spark.createDataFrame(
        [(1, 10, "bitcoin proof work", ["T"], [], ["btc"], [1.0, 0.0]), (2, 10, "other words", [], [], [], [0.0, 1.0]), (3, 20, "bitcoin network", [], [], ["btc", "net"], [1.0, 1.0])],
        "node_id long, document_id long, content string, tags array<string>, types array<string>, entity_slugs array<string>, embedding array<double>",
    )
    return engine.Graph(
        paras,
        spark.createDataFrame([(10, "2020-01-01", "CURRENT"), (20, "2024-01-01", "CURRENT")], "document_id long, published string, decay_class string").withColumn("published", F.to_date("published")),
        spark.createDataFrame([(1, "btc"), (3, "btc"), (3, "net")], "node_id long, slug string"),
        spark.createDataFrame([(10, 20, 0.9)], "src long, dst long, weight double"),
        spark.createDataFrame([(1, 2, "NEXT_PARA")], "src long, dst long, relation string"),
    )


def test_engine_answers(spark):
    g = small_graph(spark)
    found = engine.run(g, engine.understand(spark, "bitcoin proof", vector=(1.0, 0.0)), "2024-06-01")
    scores = {r["node_id"]: r["score"] for r in found["results"].collect()}
    assert max(scores, key=scores.get) == 1 and set(scores) == {1, 2, 3}
    principal = {r["node_id"] for r in found["principal"].collect()}
    assert principal <= set(scores)
    integrity = found["integrity"].collect()
    assert {r["node_id"] for r in integrity if r["provenance"] == "principal"} == principal
    best, rounds = engine.reason(g, engine.understand(spark, "bitcoin proof"), "2024-06-01")
    assert best.count() == 3 and rounds in (1, 2)


def test_engine_with_all_parts(spark):
    g = small_graph(spark)
    df = spark.createDataFrame
    g.questions = df([(1, 1), (3, 1), (2, 2)], "node_id long, class_id long")
    g.ties = df([("btc", "net", 0.8)], "slug string, other string, weight double")
    g.members = df([("btc", 1), ("net", 1)], "slug string, label long")
    g.communities = df([(1, "coins", 2)], "label long, summary string, member_count long")
    g.sections = df([(2, 10, "proof of work", None)], "node_id long, document_id long, title string, summary string")
    g.entities = df([("btc", "Bitcoin", False, None), ("net", "Network", True, None)], "slug string, name string, isolated boolean, isolation_reason string")
    g.related = df([("btc", "net", True)], "src string, dst string, is_surprising boolean")
    g.clusters = df([(3, "bitcoin proof network")], "node_id long, summary string")
    query = engine.understand(spark, "compare bitcoin proof work networks before 2023", tags=("T",), strict_dates=True)
    assert (query.mode, query.date_to, query.kind) == ("synthesis", "2023", "phrase")
    found = engine.run(g, query, "2024-06-01", subqueries=True)
    results = {r["node_id"]: r for r in found["results"].collect()}
    assert results[1]["raw_bm25"] > 0 and results[3]["raw_bm25"] is None  # document 20 is of 2024
    assert "answers_same" in results[3]["sources"] and "cluster_summary" in results[3]["sources"]
    assert all(r["temporal"] == 0 for r in results.values())  # no intent
    for name in ("integrity", "explorer", "context", "gaps", "connections"):
        found[name].collect()
    assert found["gaps"].first()["entity_slug"] == "net"
    past = engine.run(g, engine.understand(spark, "bitcoin 1994"), "2024-06-01")["results"].collect()
    assert any(r["temporal"] > 0 for r in past)


def test_answers_have_sources(spark):
    found = api.answer(spark, small_graph(spark), "bitcoin proof", "2024-06-01")
    assert [r["citation"] for r in found["sources"].orderBy("n").collect()][:1] == ["[1]"]
    assert found["answer"].first()["key"] == "bitcoin proof"
    assert api.graph_context(small_graph(spark), spark.createDataFrame([(1,)], "node_id long")).count() == 1
    files = spark.createDataFrame([(1, "fine", "h1"), (2, "fine", "h2")], "doc_id long, text string, file_hash string")
    stored = spark.createDataFrame([("h2", "complete")], "file_hash string, ingestion_status string")
    out = api.ingest_documents(files, stored, spark.createDataFrame([], "key string, payload string"), Canned())
    assert out["nodes"].select("document_id").distinct().count() == 1 and out["metadata"].first()["title"] == "fine"


def test_bundles_of_hosts_with_missing_parts(spark):
    """As string_agg: no address is last, no contents are left out, and a host of such pages only has none."""
    rows = [(None, "last"), ("http://b/1", "x"), ("http://b/1", "w"), ("http://b/0", None), ("http://c/", None), ("nohost", "first")]
    got = {r["host"]: (r["n_pages"], r["content"]) for r in docproc.bundle_by_host(spark.createDataFrame(rows, "url string, content string")).collect()}
    assert got == {"b": (3, "w\n\nx"), "c": (1, None), "unknown": (2, "first\n\nlast")}


def test_neighbours_that_vote_are_listed(spark):
    """Edges are read once for both directions; a hub's neighbours come in lists of bounded size, copies and loops count once or not at all."""
    n = 3000
    hub = spark.range(1, n + 1).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    both = hub.unionByName(hub.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).unionByName(spark.createDataFrame([(0, 0), (None, 1)], "src long, dst long"))
    rows = graph.voter_lists(both, F.col("node_id") % 2).collect()
    of_hub = [r for r in rows if r["node_id"] == 0]
    assert max(len(r["voters"]) for r in rows) <= graph.BLOCK_NEIGHBOURS and len(of_hub) >= 3
    assert sorted((r["turn"], v) for r in of_hub for v in r["voters"]) == sorted((k % 2, k) for k in range(1, n + 1))
    assert sorted((r["node_id"], v) for r in rows if r["node_id"] for v in r["voters"]) == [(k, 0) for k in range(1, n + 1)]
    joined = both.join(hub.select("dst").distinct().hint("merge"), "dst").select("src", "dst")
    plan = graph.voter_lists(joined, F.col("node_id") % 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1


def test_rules_of_presence_against_sets(spark):
    """Copies count each, missing ids are like no other, a dead edge with two strays counts once; nodes and edges meet in one sum, not in joins."""
    docs = ["d1", "d2", "d2", None]
    secs = [("s1", "d1", None), ("s2", "d1", "s1"), ("s2", "d1", "s1"), (None, "d1", "s1")]
    paras = [("p1", "d1"), ("p2", "d2"), ("p2", "d2"), ("p3", "d9")]
    edge = [("s1", "s2", "HAS_CHILD"), ("p1", "d1", "BELONGS_TO"), ("x", "y", "BELONGS_TO"), ("x", "s1", "NEXT_PARA"), ("p2", "z", "NEXT_PARA"), (None, "d1", "NEXT_PARA"), ("p1", None, "HAS_CHILD")]
    frames = [
        spark.createDataFrame([(x,) for x in docs], "node_id string"), spark.createDataFrame([(*x, 1) for x in secs], "node_id string, document_id string, parent_id string, level int"),
        spark.createDataFrame([(*x, None, "text", ["t"]) for x in paras], "node_id string, document_id string, section_id string, content string, tags array<string>"), spark.createDataFrame(edge, "src string, dst string, relation string"),
    ]
    nodes = [*docs, *(x[0] for x in secs), *(x[0] for x in paras)]
    into, out, ends = {b for _, b, r in edge if r == "HAS_CHILD"} - {None}, {a for a, _, r in edge if r == "BELONGS_TO"}, {x for e in edge for x in e[:2]} - {None}
    want = [("MISSING_SECTION_HAS_CHILD", x[0]) for x in secs if x[0] not in into] + [("MISSING_SECTION_PARENT_EDGE", x[0]) for x in secs if x[2] and x[0] not in into]
    want += [("MISSING_BELONGS_TO", x[0]) for x in paras if x[0] not in out] + [("ORPHANED_NODES", x) for x in nodes if x not in ends]
    want += [("DEAD_EDGES", a) for a, b, _ in edge if None in (a, b) or not {a, b} <= set(nodes)]
    found = verify.verify(*frames)
    codes = {c for c, _ in want}
    assert sorted(((r["code"], r["node_id"] or "") for r in found.collect() if r["code"] in codes)) == sorted((c, x or "") for c, x in want)
    assert "Join" not in verify.presence(*frames)._jdf.queryExecution().executedPlan().toString()


def test_bundles_equal_their_sql(spark, tmp_path):
    """Pages of one address lie in the order of the table, as in DuckDB on tables this small; hosts are what the SQL takes for them."""
    odd = ["http://a_b.example/1", "https://h.example/a b|c", "HTTP://h.example/", "ftp://h.example/", "http://u@h.example/", "http://h.example:8080?q", "http://é.example/", "http:///x", "https://h.example", "", None, "http://%zz/"]
    rows = [(k, f"http://t.example/{k // 3}", f"{9 - k % 3} of {k}") for k in range(9)] + [(10 + k, u, f"odd {k}") for k, u in enumerate(odd)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = duck.sql(entry.oracle_sql()["bundle_hosts"]).fetchall()
    got = entry.queries()["bundle_hosts"](spark, str(tmp_path))
    assert sorted((r["host"], r["n_pages"], r["digest"]) for r in got.collect()) == sorted(want)
