"""Connected components as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import materialise

#: Rounds after which the search ends with an error; each round at least halves the depth of a tree, so this is never met.
MOST_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reached) for every node of the edges ``a``, ``b``.

    Alternates large-star and small-star steps (Kiveris et al., 2014): each is one shuffle, a node's neighbours are
    only reduced to their minimum and never gathered, and the number of rounds grows with the logarithm of the
    size. State between rounds lies in the shared folder. An edge with a null end, or from a node to itself, is none.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = materialise(pairs, "edges")
    before = None
    for _ in range(MOST_ROUNDS):
        # Large star: every neighbour above a node goes to the smallest of its neighbours and itself.
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        pairs = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: a node and its smaller neighbours go to the smallest of them.
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        pairs = pairs.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        pairs = materialise(pairs.select("e.u", "e.v").where("u <> v").distinct(), "stars")
        now = pairs.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before or not now[0]:
            break
        before = now
    else:
        raise RuntimeError(f"components still change after {MOST_ROUNDS} rounds")
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()
