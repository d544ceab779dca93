"""Vector lists, interval joins and resolution against brute force."""

import datetime
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph import providers
from quillgraph.operators import evaluate, intervals, resolution, vectorlists
from quillgraph.sources import layouts, pages


def cosines(rows, query):
    q = np.array(query)
    return {i: float(np.dot(v, q) / np.linalg.norm(v) / np.linalg.norm(q)) for i, v in rows}


def test_vector_lists(spark, tmp_path):
    r = np.random.default_rng(3)
    centres = r.normal(size=(12, 16)) * 4
    rows = [(k, (centres[k % 12] + r.normal(size=16)).tolist()) for k in range(900)]
    odd = [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] * 16)]
    index = vectorlists.build(spark.createDataFrame(rows + odd, "node_id long, embedding array<double>"), str(tmp_path / "lists"), 12)
    stored = spark.read.parquet(f"{index.path}/vectors")
    assert stored.count() == 900
    met = []
    for k in range(8):
        query = (rows[k * 7][1] if k % 2 else r.normal(size=16)) * np.array(1.0)
        scores = cosines(rows, query)
        want = sorted((i for i in scores if scores[i] > 0), key=lambda i: (-scores[i], i))[:10]
        assert [x["node_id"] for x in vectorlists.search(spark, index, query.tolist(), 10).collect()] == want
        if k % 2:
            near = {x["node_id"] for x in vectorlists.search(spark, index, query.tolist(), 10, probes=3).collect()}
            met.append(len(near & set(want)) / 10)
    assert np.mean(met) >= 0.95
    # A search reads the partitions of its lists only.
    plan = vectorlists.search(spark, index, rows[0][1], 10, probes=2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [list" in plan
    files = spark.read.parquet(f"{index.path}/vectors").where("list IN (0, 1)")
    assert {x["list"] for x in files.select("list").distinct().collect()} <= {0, 1}
    assert vectorlists.search(spark, index, [0.0] * 16, 5).count() == 0
    assert vectorlists.search(spark, vectorlists.build(stored.limit(0), str(tmp_path / "none")), [1.0] * 16, 5).count() == 0


def test_coverage_totals(spark):
    """Totals of a document equal its pairs summed, and no pair is formed: 4e8 of them in the second part."""
    r = random.Random(11)
    day = lambda n: datetime.date(1990, 1, 1) + datetime.timedelta(days=n)
    maybe = lambda n: None if r.random() < 0.2 else day(n)
    docs = [(k % 70, maybe(a := r.randrange(4000)), maybe(a + r.choice([-3, 0, 1, 500])), maybe(a + r.choice([0, 2, 90]))) for k in range(80)] + [(None, day(5), day(9), None)]
    windows = [(k, maybe(a := r.randrange(4000)), maybe(a + r.choice([-2, 0, 1, 30, 900]))) for k in range(90)] + [(k, day(7), day(7)) for k in range(3)]
    docs = spark.createDataFrame(docs, "document_id long, published date, coverage_start date, coverage_end date")
    windows = spark.createDataFrame(windows, "window_id long, date_from date, date_to date")
    want = {x[0]: (x[1], x[2]) for x in intervals.covered_windows(docs, windows).groupBy("document_id").agg(F.count("*"), F.sum("covered")).collect()}
    got = {x["document_id"]: (x["n"], x["covered"]) for x in intervals.coverage_totals(docs, windows).collect()}
    assert got.keys() == want.keys() and all(got[k] == (want[k][0], pytest.approx(want[k][1], abs=1e-12)) for k in want)
    docs = spark.range(20000).select(F.col("id").alias("document_id"), *[F.lit(day(n)).alias(c) for c, n in (("published", 4), ("coverage_start", 3), ("coverage_end", 6))])
    windows = spark.range(20000).select(F.col("id").alias("window_id"), F.lit(day(4)).alias("date_from"), F.lit(day(10)).alias("date_to"))
    row = intervals.coverage_totals(docs, windows).agg(F.count("*"), F.min("n"), F.max("covered")).first()
    assert row[:2] == (20000, 20000) and row[2] == pytest.approx(20000 / 3)


def test_overlap_join(spark):
    r = random.Random(4)
    day = lambda n: datetime.date(1990, 1, 1) + datetime.timedelta(days=n)

    def some(n, longest):
        rows = []
        for k in range(n):
            a = r.randrange(4000)
            rows.append((k, day(a), day(a + r.choice([0, 1, 6, 7, 8, 63, 64, 400, longest]))))
        return [*rows, (n, None, day(3)), (n + 1, day(5), None), (n + 2, day(9), day(8)), (n + 3, datetime.date(1000, 1, 1), datetime.date(3000, 1, 1)), (n, day(0), day(0)), (n, day(0), day(0))]

    a, b = some(80, 3000), some(60, 5000)
    frames = [spark.createDataFrame(x, f"{c} long, s date, e date") for x, c in ((a, "i"), (b, "j"))]
    got = sorted((x["left"]["i"], x["right"]["j"]) for x in intervals.overlap_join(*frames, ("s", "e"), ("s", "e")).collect())
    good = lambda row: row[1] and row[2] and row[1] <= row[2]
    assert got == sorted((x[0], y[0]) for x in a for y in b if good(x) and good(y) and x[1] <= y[2] and y[1] <= x[2])
    plan = intervals.overlap_join(*frames, ("s", "e"), ("s", "e"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_variants_beyond_neighbours(spark):
    """A name's forms are found however many slugs lie between them."""
    rows = [(f"a{k:04}", "T", f"filler{k} thing{k}") for k in range(300)] + [("zz", "T", "thing7"), ("zy", "T", "thing8 filler8 more"), ("zx", "U", "thing7"), ("zw", "T", ""), ("a0007", "T", "filler7 thing7")]
    found = {tuple(x) for x in resolution.variants(spark.createDataFrame(rows, "slug string, type string, canonical string")).collect()}
    assert found == {("T", "zz", "a0007"), ("T", "a0008", "zy")}
    same = resolution.same_words(spark.createDataFrame([("b", "T", "one two"), ("a", "T", "Two one"), ("c", "U", "one two")], "slug string, type string, canonical string"))
    assert [tuple(x) for x in same.collect()] == [("T", "b", "a")]


def test_copies_of_a_name_are_one_class(spark):
    """Counts of children equal the pairs counted; 20,000 and 30,000 copies of two names make no pairs."""
    r = random.Random(8)
    rows = [(k, r.choice("TU"), " ".join(r.choice(["red", "bolt", "ring", "large", "old", "steel"]) for _ in range(r.randrange(5)))) for k in range(200)] + [(5, "T", "red")]
    frame = spark.createDataFrame(rows, "slug long, type string, canonical string").dropDuplicates(["type", "slug"]).cache()
    want = {tuple(x) for x in resolution.variants(frame).groupBy("type", "parent").agg(F.count("*"), F.min("child")).collect()}
    assert want and {tuple(x) for x in resolution.variant_counts(frame).collect()} == want
    copies = spark.range(50000).select(F.col("id").alias("slug"), F.lit("T").alias("type"), F.when(F.col("id") < 20000, "red bolt").otherwise("red steel bolt").alias("canonical"))
    assert resolution.variant_counts(copies).agg(F.count("*"), F.min("n"), F.max("n"), F.max("first")).first()[:] == (20000, 30000, 30000, 20000)


def test_chains_end_at_one_survivor(spark):
    frame = lambda rows: spark.createDataFrame(rows, "slug string, survivor string")
    chain = frame([("c", "b"), ("d", "c"), ("e", "d"), ("x", "x"), ("q", "p")])
    more = frame([("b", "a"), ("p", "q"), ("r", "q"), ("r", "e2")] + [(f"h{k}", "hub") for k in range(50)])
    got = {r["slug"]: r["survivor"] for r in resolution.final_survivors([chain, more]).collect()}
    assert got == {"b": "a", "c": "a", "d": "a", "e": "a", "p": "e2", "q": "e2", "r": "e2", **{"hub": "h0"}, **{f"h{k}": "h0" for k in range(1, 50)}}
    assert resolution.final_survivors([frame([])]).count() == 0


def test_a_provider_is_asked_once(spark):
    """However much reads its answers, and only for what the models before it left."""
    asked = {"first": spark.sparkContext.accumulator(0), "second": spark.sparkContext.accumulator(0)}

    class Counting:
        def __init__(self, name, answers):
            self.name, self.answers = name, answers

        def answer(self, requests):
            counter, answers = asked[self.name], self.answers

            def run(batches):
                for batch in batches:
                    counter.add(len(batch))
                    yield batch.assign(payload=[answers(p) for p in batch["prompt"]])[["key", "payload"]]

            return requests.select("key", "prompt").mapInPandas(run, "key string, payload string")

    requests = spark.createDataFrame([(f"k{k}", f"prompt {k}") for k in range(30)] + [("k1", "prompt 1")], "key string, prompt string")
    chain = providers.Chain([("first", Counting("first", lambda p: "  " if p.endswith("7") else p.upper() if "1" in p else None)), ("second", Counting("second", lambda p: "known" if "2" in p else None))], attempts=2)
    cache = spark.createDataFrame([("k0", "old"), ("zz", "other")], "key string, payload string")
    answers, new = layouts.cached(requests, cache, chain.answer)
    for _ in range(2):
        assert answers.where("payload = 'old'").count() == 1 and new.count() == answers.count() - 1
    told = {r["key"]: (r["payload"], r["model"], r["attempt"]) for r in new.collect()}
    first = {k for k in range(1, 30) if "1" in str(k) and k % 10 != 7}
    second = {k for k in range(1, 30) if "2" in str(k)} - first
    assert told == {f"k{k}": (f"PROMPT {k}", "first", 1) for k in first} | {f"k{k}": ("known", "second", 1) for k in second}
    assert asked["first"].value == 29 + (29 - len(first))
    assert asked["second"].value == (29 - len(first)) + (29 - len(first) - len(second))
    usage = {r["model"]: (r["n_calls"], r["n_answered"]) for r in providers.usage(chain.calls(requests)).collect()}
    assert usage["first"][0] == 30 + 30 - len(first) and usage["first"][1] == len(first)


def test_ablation_runs_phases_once(spark):
    runs = spark.sparkContext.accumulator(0)
    rows = [(q, n, float((q * 7 + n * 3) % 11)) for q in range(4) for n in range(12)]
    frame = spark.createDataFrame(rows, "query_id long, node_id long, score double")

    def counted(batches):
        for batch in batches:
            runs.add(len(batch))
            yield batch

    phases = {"a": frame.mapInPandas(counted, frame.schema), "b": frame.selectExpr("query_id", "node_id", "11 - score AS score")}
    gold = spark.createDataFrame([(q, (q * 5) % 12) for q in range(4)] + [(9, 1)], "query_id long, node_id long")
    settings = {"a": {"a": 1.0}, "b": {"b": 1.0}, "both": {"a": 0.5, "b": 1.0}, "off": {"a": 0.0}}
    got = {r["config"]: r for r in evaluate.matrix(phases, gold, settings).collect()}
    assert runs.value == len(rows)
    for name, weights in settings.items():
        ranked = []
        for q in range(4):
            best = {n: weights.get("a", 0) * s / max(x[2] for x in rows if x[0] == q) + weights.get("b", 0) * (11 - s) / max(11 - x[2] for x in rows if x[0] == q) for p, n, s in rows if p == q}
            ranked += [(q, rank + 1, n) for rank, n in enumerate(sorted(best, key=lambda n: (-best[n], n))[:10])] if any(weights.values()) else []
        one = evaluate.metrics(evaluate.hit_ranks(spark.createDataFrame(ranked, "query_id long, rank int, node_id long"), gold)).first()
        assert {k: got[name][k] for k in one.asDict()} == one.asDict()


def test_one_file_a_page(spark, tmp_path):
    uri = f"file://{tmp_path}/wiki"
    rows = [(1, "entities/ada.md", "one"), (2, "entities/ada.md", "two\nlines\n"), (3, "entities/ada.md", ""), (4, "documents/d d/index.md", "é+%"), (5, "top", "x"), (6, "entities/a+b%20c.md", "y")]
    kept = pages.unique_paths(spark.createDataFrame(rows, "k int, path string, body string").repartition(3), "k")
    pages.write_pages(kept, uri)
    want = {"entities/ada.md": "one", "entities/ada~2.md": "two\nlines\n", "entities/ada~3.md": "", "documents/d d/index.md": "é+%", "top": "x", "entities/a+b%20c.md": "y"}
    assert {str(f.relative_to(tmp_path / "wiki")): f.read_text() for f in (tmp_path / "wiki").rglob("*") if f.is_file()} == want
    pages.write_pages(kept, uri)  # again: the same
    read = {r["path"]: r["body"] for r in pages.read_pages(spark, uri).collect()}
    assert {k: v for k, v in want.items() if v} == {k: v for k, v in read.items() if v}
    with pytest.raises(Exception, match="stays in its folder"):
        pages.write_pages(spark.createDataFrame([("../x", "b")], "path string, body string"), uri)


def test_many_pages_are_read_by_few_tasks(spark, tmp_path):
    (tmp_path / "wiki").mkdir()
    for k in range(150):
        (tmp_path / "wiki" / f"p{k}.md").write_text(f"body {k}")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        found = pages.read_pages(spark, f"file://{tmp_path}/wiki")
        assert found.rdd.getNumPartitions() <= pages.READ_TASKS * spark.sparkContext.defaultParallelism
        assert sorted((r["path"], r["body"]) for r in found.collect()) == sorted((f"p{k}.md", f"body {k}") for k in range(150))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_tags_of_documents_move_texts_once(spark, tmp_path):
    from quillgraph.plans import corpus

    texts = ["Alpha beta alpha\nthe beta gamma", "x1\n\nzz9 ZZ9 alpha", None, "", "the of"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = corpus.tag_rollup(spark, str(tmp_path))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 1
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    assert sorted(map(tuple, found.collect())) == [(0, md5("alpha,beta,gamma"), 5), (1, md5("zz9,alpha"), 3)]


def test_no_list_of_pages_passes_the_driver(spark, tmp_path):
    """Tasks find and open the files; the driver knew each of them before, and left out empty pages and names that begin with _."""
    uri = f"file://{tmp_path}/wiki"
    want = {f"e/{k % 3}/p{k}.md": f"body {k}" for k in range(120)} | {"e/_x.md": "y", "e/empty.md": "", "top": "z"} | {f"long/{k}.md": chr(97 + k) * 7_000_000 for k in range(4)}
    rows = spark.createDataFrame(list(want.items()), "path string, body string")
    pages.write_pages(rows, uri)
    assert not list((tmp_path / "wiki").rglob(".*"))
    (tmp_path / "wiki" / "e" / ".left").mkdir()
    (tmp_path / "wiki" / "e" / ".left" / "page").write_text("of a task that was killed")
    for known in ((), (rows,)):
        found = pages.read_pages(spark, uri, *known)
        assert not [f for f in found.inputFiles() if "/wiki/" in f]
        assert sorted(tuple(r) for r in found.collect()) == sorted(want.items())
    with pytest.raises(Exception, match="gone.md"):
        pages.read_pages(spark, uri, spark.createDataFrame([("gone.md",)], "path string")).collect()
