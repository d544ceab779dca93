"""Set similarity and common neighbours against brute force, with hubs."""

import collections
import math
import random
from dataclasses import replace
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from quillgraph.config import DEFAULT
from quillgraph.operators import graph, report, setjoin


def some_sets(r, n):
    out = {}
    for k in range(n):
        items = {"hot"} if r.random() < 0.4 else set()
        items |= {f"i{int(r.expovariate(0.08))}" for _ in range(r.choice([1, 2, 5, 12, 40]))}
        out[k] = items
        if k and r.random() < 0.3:
            out[k] = set(out[r.randrange(k)]) | ({"extra"} if r.random() < 0.5 else set())
    return out


def measures(a, b):
    s = len(a & b)
    return s, 2 * s / (len(a) + len(b)), s / len(a | b)


@pytest.mark.parametrize("threshold", [0.1, 0.5, 0.8])
def test_similar_sets(spark, threshold):
    sets = some_sets(random.Random(int(threshold * 100)), 90)
    rows = [(k, i) for k, items in sets.items() for i in items] + [(None, "hot"), (3, None), (0, "hot"), (0, "hot")]
    sets[0].add("hot")
    frame = spark.createDataFrame(rows, "set_id long, item string").cache()
    for at, measure in ((1, "dice"), (2, "jaccard")):
        want = {(a, b): measures(sets[a], sets[b]) for a, b in combinations(sorted(sets), 2) if measures(sets[a], sets[b])[at] >= threshold}
        got = {(r["src"], r["dst"]): (r["shared"], r["dice"], r["jaccard"]) for r in graph.set_similarity(frame, measure, threshold).collect()}
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k]) for k in want)
    new = spark.createDataFrame([(k,) for k in range(60, 90)], "set_id long")
    added = {(r["src"], r["dst"]) for r in graph.set_similarity(frame, "jaccard", threshold, new).collect()}
    assert added == {(a, b) for a, b in want if b >= 60}


def test_a_hot_item_makes_no_pairs(spark):
    """An item of every set, and one set that holds a third of all rows."""
    rows = [(k, f"own{k}-{j}") for k in range(2000) for j in range(4)] + [(k, "hot") for k in range(2000)] + [(9000, f"big{j}") for j in range(5000)] + [(2000, i) for i in ("hot", "own7-0", "own7-1", "own7-2", "own7-3")]
    frame = spark.createDataFrame(rows, "set_id long, item string")
    placed = setjoin.with_positions(frame, "jaccard", 0.5).cache()
    assert placed.where("set_id = 9000").count() == 0
    joined, pairs = setjoin.candidates(placed, "jaccard", 0.5)
    assert joined.count() < 10 and pairs.count() == 1
    assert [(r["src"], r["dst"]) for r in graph.set_similarity(frame, "jaccard", 0.5).collect()] == [(7, 2000)]


def test_a_join_is_dealt_by_the_rows_it_makes(spark):
    """Few rows that make many: an item of 400 sets is dealt over several tasks, and none makes much more than it may."""
    rows = spark.createDataFrame([(k, "hot") for k in range(400)] + [(k, f"i{k % 50}") for k in range(400)], "set_id long, item string")
    often = rows.groupBy("item").count().withColumnRenamed("count", "d")
    a, b = rows.withColumnRenamed("set_id", "a"), rows.withColumnRenamed("set_id", "b")
    met = setjoin.met_on(a, b, "item", often, task_rows=10_000).cache()
    assert met.columns == ["item", "a", "b"] and met.count() == 400 * 400 + 50 * 8 * 8
    assert met.exceptAll(a.join(b, "item")).isEmpty()
    sizes = [r[0] for r in met.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) > 8 and max(sizes) < 60_000


def test_back_references_count_paragraphs_once(spark, monkeypatch):
    """Repeated rows count once, and tasks grow in number with the mentions, not in size."""
    monkeypatch.setattr(report, "TASK_MENTIONS", 50)
    r = random.Random(2)
    said = [(r.choice([None, *range(60)]), r.randrange(6)) for _ in range(1000)]
    held = [(k, k % 7 if k % 5 else None) for k in range(50)] + [(3, 3), (3, 4)]
    want = collections.defaultdict(set)
    for node, slug in said:
        for other, document in held:
            if node is not None and node == other:
                want[slug, document].add(node)
    frames = spark.createDataFrame(said, "node_id long, slug long"), spark.createDataFrame(held, "node_id long, document_id long"), spark.createDataFrame([(2, "two")], "document_id long, title string")
    found = report.back_references(*frames)
    assert {(x["slug"], x["document_id"]): (x["title"], x["n_paragraphs"]) for x in found.collect()} == {k: ("two" if k[1] == 2 else None, len(v)) for k, v in want.items()}
    assert "hashpartitioning(node_id" in (plan := found._jdf.queryExecution().executedPlan().toString()) and ", 20), REPARTITION_BY_NUM" in plan


def test_threshold_above_zero(spark):
    with pytest.raises(ValueError):
        graph.set_similarity(spark.createDataFrame([], "set_id long, item string"), "dice", 0.0)


def brute_ties(pairs, least, threshold):
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    found = {}
    for w, nodes in near.items():
        for a, b in combinations(sorted(nodes), 2):
            s, c = found.get((a, b), (0.0, 0))
            found[a, b] = (s + 1 / math.log(max(2, len(nodes))), c + 1)
    return {k: v for k, v in found.items() if v[1] >= least and v[0] >= threshold}


@pytest.mark.parametrize("least, threshold, block", [(2, 0.3, 3), (1, 0.3, 1024), (3, 1.2, 5)])
def test_adamic_adar(spark, least, threshold, block):
    r = random.Random(least * 10 + block)
    pairs = [(r.randrange(60), int(r.expovariate(0.1))) for _ in range(400)] + [(1000, k) for k in range(60)] + [(1001, k) for k in range(0, 60, 2)] + [(5, 5)]
    config = replace(DEFAULT, aa_least_common=least, aa_threshold=threshold)
    got = {(x["src"], x["dst"]): (x["weight"], x["common"]) for x in graph.adamic_adar(spark.createDataFrame(pairs, "src long, dst long"), config, block).collect()}
    want = brute_ties(pairs, least, threshold)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_a_hub_makes_no_pairs_of_its_own(spark):
    """A hub of 100,000 neighbours: its five billion pairs are never made."""
    hub = spark.range(100_000).selectExpr("-1L AS src", "id AS dst")
    few = spark.createDataFrame([(1, 200_001), (2, 200_001), (1, 200_002), (2, 200_002), (3, 200_002)], "src long, dst long")
    got = {(r["src"], r["dst"]): (round(r["weight"], 6), r["common"]) for r in graph.adamic_adar(hub.unionByName(few)).collect()}
    share = lambda d: 1 / math.log(d)
    assert got == {
        (1, 2): (round(share(100_000) + share(2) + share(3), 6), 3), (1, 3): (round(share(100_000) + share(3), 6), 2), (2, 3): (round(share(100_000) + share(3), 6), 2),
        (200_001, 200_002): (round(2 * share(3), 6), 2), (-1, 200_001): (round(2 * share(3), 6), 2), (-1, 200_002): (round(2 * share(3) + share(2), 6), 3),
    }
