"""Clusters of paragraph vectors, and summaries of their members."""

from __future__ import annotations

from math import sqrt

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cluster_count(n: int) -> int:
    return min(50, max(3, round(sqrt(n / 2))))


def kmeans(nodes: DataFrame, k: int | None = None, iterations: int = 50, seed: int = 7, least_size: int = 3) -> DataFrame:
    """node_id, cluster by cosine k-means over embeddings (null and zero ones take no part); small clusters are dropped."""
    length = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = nodes.where(F.col("embedding").isNotNull() & (length > 0)).select("node_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    n = rows.count()
    if not n:
        return nodes.select("node_id", F.lit(0).alias("cluster")).limit(0)
    model = KMeans(k=min(k or cluster_count(n), n), maxIter=iterations, seed=seed, distanceMeasure="cosine", initSteps=2).fit(rows)
    found = model.transform(rows).select("node_id", F.col("prediction").alias("cluster"))
    large = found.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") >= least_size).select("cluster")
    return found.join(F.broadcast(large), "cluster").select("node_id", "cluster")  # at most 50 rows


def summaries(members: DataFrame, words: DataFrame, most: int = 8) -> DataFrame:
    """cluster, summary: its most frequent words, the offline stand-in for a written one. members: node_id, cluster; words: node_id, word."""
    counts = words.join(members, "node_id").groupBy("cluster", "word").agg(F.count("*").alias("n"))
    ordered = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "word"))), 1, most)
    return counts.groupBy("cluster").agg(F.array_join(F.transform(ordered, lambda x: x["word"]), " ").alias("summary"))
