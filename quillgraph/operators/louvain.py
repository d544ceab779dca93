"""Communities by modularity (Blondel et al., 2008), as joins and groupings over an edge frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.graph import undirected
from quillgraph.state import written

#: What a move must gain, in units of edge weight.
LEAST_GAIN = 1e-9


def _links(graph: DataFrame, state: DataFrame) -> DataFrame:
    """a, com, w: the weight of each node's edges into each neighbouring community."""
    return graph.where("a <> b").join(state.select(F.col("node").alias("b"), "com"), "b").groupBy("a", "com").agg(F.sum("w").alias("w"))


def _moved(graph: DataFrame, state: DataFrame, total: float, turn: int) -> DataFrame:
    """The state after the nodes of a turn have moved to the community of the greatest gain, ties to the smaller one."""
    tot = state.groupBy("com").agg(F.sum("k").alias("tot"))
    own = state.select(F.col("node").alias("a"), "com", F.lit(0.0).alias("w"))
    choices = _links(graph, state).unionByName(own).groupBy("a", "com").agg(F.sum("w").alias("w")).join(tot, "com")
    choices = choices.join(state.select(F.col("node").alias("a"), F.col("com").alias("now"), "k", "turn"), "a")
    rest = F.col("tot") - F.when(F.col("com") == F.col("now"), F.col("k")).otherwise(0.0)
    choices = choices.withColumn("gain", F.col("w") - F.col("k") * rest / total)
    best = choices.groupBy("a").agg(F.max_by(F.struct("now", "k", "turn"), "turn").alias("s"), F.min(F.struct((-F.col("gain")).alias("m"), "com")).alias("b"), F.max(F.when(F.col("com") == F.col("now"), F.col("gain"))).alias("stay"))
    goes = (F.col("s.turn") == turn) & (-F.col("b.m") > F.col("stay") + LEAST_GAIN)
    com = F.when(goes, F.col("b.com")).otherwise(F.col("s.now"))
    return best.select(F.col("a").alias("node"), com.alias("com"), F.col("s.k").alias("k"), F.col("s.turn").alias("turn"), goes.alias("moved"))


def louvain(edges: DataFrame, levels: int = 100, sweeps: int = 1000) -> DataFrame:
    """node_id, label: communities of an undirected graph (src, dst and perhaps weight), named after their smallest node.

    On each level nodes move to the community of the greatest gain, half of them at a time (by a hash), until a sweep
    moves none; communities then become the nodes of the next level. It ends when a level merges nothing. State lies in
    the shared folder between halves. Loops and repeated edges add up; a node without edges has no community.
    More than so many levels, or sweeps of a level, are an error: there is no unfinished result.
    """
    w = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    graph = undirected(edges.where("src <> dst").select("src", "dst", w.alias("w"))).groupBy(F.col("src").alias("a"), F.col("dst").alias("b")).agg(F.sum("w").alias("w"))
    graph = written(graph, "graph")
    members = graph.select(F.col("a").alias("node_id"), F.col("a").alias("label")).distinct()
    total = graph.agg(F.sum("w")).first()[0]
    for _ in range(levels if total else 0):
        degree = graph.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k"))
        state = written(degree.select("node", F.col("node").alias("com"), "k", F.pmod(F.xxhash64("node"), F.lit(2)).cast("int").alias("turn"), F.lit(False).alias("moved")), "state")
        still = 0
        for half in range(2 * sweeps):
            state = written(_moved(graph, state, total, half % 2), "state")
            still = still + 1 if state.where("moved").isEmpty() else 0
            if still == 2:
                break
        else:
            raise RuntimeError(f"nodes still move after {sweeps} sweeps")
        least = state.groupBy("com").agg(F.min("node").alias("label"))
        named = written(state.join(least, "com").select("node", "label"), "named")
        if named.where("node <> label").isEmpty():
            break
        end = lambda c: named.select(F.col("node").alias(c), F.col("label").alias(f"_{c}"))
        graph = written(graph.join(end("a"), "a").join(end("b"), "b").groupBy(F.col("_a").alias("a"), F.col("_b").alias("b")).agg(F.sum("w").alias("w")), "graph")
        members = written(members.join(named.withColumnRenamed("label", "up"), members["label"] == named["node"]).select("node_id", F.col("up").alias("label")), "members")
    else:
        if total:
            raise RuntimeError(f"communities still merge after {levels} levels")
    # The smallest node of a community names it on every level.
    first = members.groupBy("label").agg(F.min("node_id").alias("name"))
    return members.join(first, "label").select("node_id", F.col("name").alias("label"))


def modularity(edges: DataFrame, labels: DataFrame) -> float:
    """Of a partition (node_id, label): the share of weight within communities less that of a random graph of the same degrees."""
    w = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    both = undirected(edges.where("src <> dst").select("src", "dst", w.alias("w")))
    end = lambda c: labels.select(F.col("node_id").alias(c), F.col("label").alias(f"_{c}"))
    rows = both.join(end("src"), "src").join(end("dst"), "dst")
    inside, total = rows.agg(F.sum(F.when(F.col("_src") == F.col("_dst"), F.col("w")).otherwise(0.0)), F.sum("w")).first()
    degrees = rows.groupBy("_src").agg(F.sum("w").alias("k")).agg(F.sum(F.col("k") * F.col("k"))).first()[0]
    return inside / total - degrees / total**2 if total else 0.0
