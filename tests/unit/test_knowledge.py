"""Ontology, entities, clusters, providers and reports on small frames."""

from pyspark.sql import functions as F

from quillgraph import providers
from quillgraph.operators import clusters, docproc, entities, evaluate, ontology


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


NAMES = ["Agent", "Method", "HumanBody"]


def resolved(spark, tags):
    names = spark.createDataFrame([(n,) for n in NAMES], "name string")
    aliases = spark.createDataFrame([("person", 0, "Nothing"), ("person", 1, "Agent")], "alias_key string, place int, name string")
    return ontology.resolve_tags(spark.createDataFrame([(t,) for t in tags], "tag string"), names, aliases)


def test_tag_resolution_order(spark):
    got = dict(rows(resolved(spark, ["Agent", "agent", "human_body", "person", "ResearchMethod", "DefinitelyNotATag12", None, ""]), "tag", "canonical"))
    assert got == {"Agent": "Agent", "agent": "Agent", "human_body": "HumanBody", "person": "Agent", "ResearchMethod": "Method", "DefinitelyNotATag12": None, "": None}


def test_tag_validation(spark):
    nodes = spark.createDataFrame([(1, ["agent", "x", "Agent", "Method"]), (2, None), (3, [])], "node_id int, tags array<string>")
    got = {r["node_id"]: (r["valid"], r["invalid"], r["resolved_map"]) for r in ontology.validate_tags(nodes, resolved(spark, ["agent", "x", "Agent", "Method"])).collect()}
    assert got[1] == (["Agent", "Method"], ["x"], {"agent": "Agent"})
    assert got[2][:2] == ([], []) and got[3][:2] == ([], [])


def test_class_files(spark, tmp_path):
    text = '<rdf:RDF><owl:Class rdf:about="http://x#A"><rdfs:subClassOf rdf:resource="http://x#B"/></owl:Class>\n<owl:Class rdf:ID="B"></owl:Class></rdf:RDF>'
    (tmp_path / "o.owl").write_text(text)
    names, edges = ontology.read_classes(spark, str(tmp_path / "o.owl"))
    assert rows(names, "name") == [("A",), ("B",)] and rows(edges, "child", "parent") == [("A", "B")]
    depth = ontology.primary_depth(edges.unionByName(spark.createDataFrame([("C", "A")], "child string, parent string")), "B")
    assert rows(depth, "name", "depth", "lane") == [("A", 1, "A"), ("C", 2, "A")]


def test_entities(spark):
    raw = [(1, 0, "alice-s-cafe", None, "org", 2.0, "c" * 200), (1, 1, "Alice's Cafe", None, "ORG", None, None), (1, 2, "d41d8cd98f00b204e9800998ecf8427e", None, "ORG", 0.5, ""), (1, 3, "x", None, "THING", 0.5, ""), (1, 4, "", "", "ORG", 0.5, "")]
    df = spark.createDataFrame(raw, "node_id int, at int, name string, canonical string, type string, confidence double, context string")
    found = entities.validate(df)
    assert rows(found, "at", "canonical", "confidence") == [(0, "Alice's Cafe", 1.0), (1, "Alice's Cafe", 0.5)]
    merged = entities.merge(found, ["node_id"]).first()
    assert (merged["slug"], merged["aliases"], merged["mentions"]) == ("alice-s-cafe", ["alice-s-cafe"], 2)


def test_answers(spark):
    rule = lambda g, a: spark.range(1).select(entities.correct_answer(F.lit(g), F.lit(a).cast("string"))).first()[0]
    assert rule("Paris", "It is paris!") and rule("New York City", "york") and not rule("Paris", "Rome") and not rule("Paris", None)


def test_clusters_part_directions(spark):
    data = [(k, [1.0, 0.01 * k]) for k in range(5)] + [(10 + k, [0.01 * k, 1.0]) for k in range(5)] + [(99, None), (98, [0.0, 0.0])]
    found = dict(rows(clusters.kmeans(spark.createDataFrame(data, "node_id int, embedding array<double>"), k=2), "node_id", "cluster"))
    assert len(found) == 10 and len({found[k] for k in range(5)}) == 1 and found[0] != found[10]
    assert clusters.cluster_count(500) == 16


def test_levels_and_markdown(spark):
    s = spark.createDataFrame([(1, 0, 1), (1, 1, 3), (1, 2, 6), (2, 0, 2)], "doc int, pos int, level int")
    assert rows(docproc.normalise_levels(docproc.nest_sections(s, "doc", "pos"), "doc", "pos"), "doc", "pos", "level") == [(1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 2)]
    r = spark.createDataFrame([("d", "D", "S", 1, "b", 2), ("d", "D", "S", 1, "a", 1), ("d", "D", None, None, "c", 3)], "document_id string, document_title string, section_title string, section_level int, content string, rank int")
    assert docproc.as_markdown(r).first()["body"] == "# D\n\n## S\n\na\n\nb\n\nc"


def test_contents_link_to_sections(spark):
    entries = spark.createDataFrame([("d", 0, "Intro", None), ("d", 1, "other", 7)], "document_id string, entry int, title string, page int")
    sections = spark.createDataFrame([("d", "s1", "intro ", 1, 0), ("d", "s2", "X", 7, 1)], "document_id string, node_id string, title string, page int, doc_position int")
    assert rows(docproc.link_contents(entries, sections), "entry", "section_id") == [(0, "s1"), (1, "s2")]


def test_ablation(spark):
    gold = spark.createDataFrame([(1, 5)], "query_id int, node_id int")
    run = lambda node: spark.createDataFrame([(1, 1, node)], "query_id int, rank int, node_id int")
    assert rows(evaluate.ablation(run, gold, {"good": 5, "bad": 6}), "config", "mrr") == [("bad", 0.0), ("good", 1.0)]


def test_providers(spark):
    df = spark.createDataFrame([("k", "One sentence. Another.")], "key string, prompt string")
    assert providers.FirstSentence().answer(df).first()["payload"] == "One sentence."
    v = spark.range(1).select(providers.HashedTerms(8).embed(F.lit("proof proof work")).alias("v")).first()["v"]
    assert len(v) == 8 and sum(v) == 3


def test_stratified_is_deterministic(spark):
    df = spark.range(100).withColumn("s", F.col("id") % 4)
    a, b = (rows(entities.stratified(df, "s", "id", 3), "id") for _ in range(2))
    assert a == b and len(a) == 12
