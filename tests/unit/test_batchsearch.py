import random

from pyspark.sql import functions as F

from quillgraph.operators import batchsearch, search


def test_best_pairs_over_blocks(spark):
    draw = random.Random(5)
    bags = {n: [f"w{min(int(draw.expovariate(0.2)), 30)}" for _ in range(draw.randint(1, 12))] for n in range(300)}
    bags |= {n: bags[7] for n in range(300, 340)}  # copies tie
    counts = spark.createDataFrame([(n, len(w), x, w.count(x)) for n, w in bags.items() for x in sorted(set(w))], "node_id long, dl long, word string, tf long")
    asked = counts.where("node_id % 10 = 7").select(F.col("node_id").alias("query_id"), "word")
    scores = {(r["query_id"], r["node_id"]): r["score"] for r in search.bm25_batch(counts, counts.agg(F.countDistinct("node_id").alias("n")), asked).collect()}
    postings, words = batchsearch.weighted_words(counts, len(bags), sum(map(len, bags.values())), asked)
    weights = [(1.0, 0.6), (0.5, 0.0), (0.0, 0.0)]
    found = batchsearch.best_pairs(postings, words, len(bags), weights, 10, nodes=64, queries=9)
    got = {(r["query_id"], r["node_id"]): (r["fulltext"], r["words"]) for r in found.collect()}
    assert len(got) == found.count() < len(scores) / 2  # not a row for each pair that meets
    for q in {q for q, _ in scores}:
        share = {n: len(set(bags[q]) & set(bags[n])) / len(set(bags[q])) for k, n in scores if k == q}
        for n, s in ((n, x) for (k, n), x in got.items() if k == q):
            assert abs(s[0] - scores[q, n]) < 1e-9 and s[1] == share[n]
        most = max(scores[q, n] for n in share)
        for a, b in [(1.0, 0.0), (0.0, 1.0), (1.0, 0.6)]:
            best = sorted(share, key=lambda n: (-round(a * scores[q, n] / most + b * share[n], 9), n))[:10]
            assert all((q, n) in got for n in best)
