"""Ingestion end to end: whole graphs without issues, and increments equal to one run."""

import hashlib
import random

from quillgraph import ingestion
from quillgraph.config import EngineConfig
from quillgraph.operators import verify

CONFIG = EngineConfig(similarity_threshold=0.2, evergreen_indegree=3)


def files(n, seed=1):
    r = random.Random(seed)
    people = [f"{a} {b}" for a in ("Ada", "Alan", "Grace", "Kurt") for b in ("Lovelace", "Turing", "Hopper", "Goedel")]
    out = []
    for k in range(n):
        text = f"# Title {k}\n\nOf 1994-03-0{k % 9 + 1} and {r.choice(people)}.\nSecond line about {r.choice(people)}.\n\n### Deep {k}\n\nThe work of {r.choice(people)} goes on.\n\nMore words here.\n## Next\nAnd {r.choice(people)} again.\n"
        out.append((f"d{k:02}", text, hashlib.sha256(text.encode()).hexdigest()))
    return out


SCHEMA = "document_id string, text string, file_hash string"


def content(spark, store):
    edges = sorted(map(tuple, ingestion.all_edges(spark, store).collect()))
    docs = sorted((r["document_id"], r["decay_class"], r["indegree"]) for r in store.documents(spark, CONFIG).collect())
    entities = sorted(map(tuple, store.entities(spark).collect()))
    weights = sorted((r["src"], r["dst"], round(r["weight"], 9)) for r in store.read(spark, "similar").collect())
    return edges, docs, entities, weights


def test_a_whole_graph_has_no_issues(spark, tmp_path):
    store = ingestion.Store(str(tmp_path / "one"))
    assert ingestion.add_batch(spark, store, spark.createDataFrame(files(6), SCHEMA), "b0", config=CONFIG) == 6
    structural = store.read(spark, "edges")
    docs = store.read(spark, "documents").selectExpr("document_id AS node_id")
    issues = verify.verify(docs, store.read(spark, "sections"), store.read(spark, "paragraphs"), structural)
    assert issues.collect() == []
    row = store.read(spark, "documents").where("document_id = 'd00'").first()
    assert row["title"] == "Title 0" and str(row["published"]) == "1994-03-01"
    levels = {(r["title"], r["level"]) for r in store.read(spark, "sections").where("document_id = 'd00'").collect()}
    assert levels == {("Title 0", 1), ("Deep 0", 2), ("Next", 2)}


def test_increments_equal_one_run(spark, tmp_path):
    rows = files(15)
    one, many = ingestion.Store(str(tmp_path / "one")), ingestion.Store(str(tmp_path / "many"))
    ingestion.add_batch(spark, one, spark.createDataFrame(rows, SCHEMA), "all", config=CONFIG)
    for k in range(3):
        part = rows[k * 5 : (k + 1) * 5] + rows[:2]  # known files come again
        assert ingestion.add_batch(spark, many, spark.createDataFrame(part, SCHEMA), f"b{k}", config=CONFIG) == 5
    assert ingestion.add_batch(spark, many, spark.createDataFrame(files(3, 9), SCHEMA), "b1", config=CONFIG) == 0  # that batch is there
    assert content(spark, one) == content(spark, many)
    assert any(d[1] == "EVERGREEN" for d in content(spark, one)[1])


def test_stream_of_files(spark, tmp_path):
    rows = files(6)
    for k in range(3):
        spark.createDataFrame(rows[k * 2 : k * 2 + 2], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = ingestion.Store(str(tmp_path / "store"))
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingestion.ingest_stream(stream(), store, str(tmp_path / "check"), config=CONFIG)
    ingestion.ingest_stream(stream(), store, str(tmp_path / "check"), config=CONFIG)  # nothing new
    assert store.read(spark, "documents").count() == 6
    ingestion.ingest_stream(stream(), store, str(tmp_path / "other"), config=CONFIG)  # all again: known
    assert store.read(spark, "documents").count() == 6


def test_empty_and_odd_files(spark, tmp_path):
    store = ingestion.Store(str(tmp_path / "odd"))
    odd = [("a", None, "h1"), ("b", "", "h2"), (None, "x", "h3"), ("c", "no heading", "h4"), ("c2", "no heading", "h4"), ("c", "other", "h5")]
    assert ingestion.add_batch(spark, store, spark.createDataFrame(odd, SCHEMA), "b0") == 3
    assert [(r["document_id"], r["content"], r["section_id"]) for r in store.read(spark, "paragraphs").collect()] == [("c", "no heading", None)]
    assert ingestion.add_batch(spark, store, spark.createDataFrame([], SCHEMA), "b1") == 0


def test_lines_become_blocks_where_they_lie(spark):
    """No lines are written between the split and the blocks, which move with their document, once."""
    files = spark.createDataFrame([("a", "x\ny\n\n# T\r\nz\n  \nw"), ("b", None), ("c", "")], "document_id string, text string")
    nested, blocks = ingestion.structure(files)
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "parquet" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert sorted((r["document_id"], r["position"], r["section_at"], r["content"]) for r in blocks.collect()) == [("a", 0, None, "x\ny"), ("a", 4, 3, "z"), ("a", 6, 3, "w")]
    assert [(r["document_id"], r["position"], r["title"]) for r in nested.collect()] == [("a", 3, "T")]
