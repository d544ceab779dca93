"""Stored vector lists: vectors of about the same direction in one partition, with a bound for each list.

``build`` clusters a bounded sample by cosine, puts every vector into the list of its nearest centre, and writes the lists
as partitions. A list keeps its centre and the largest angle of its vectors to it, so that no vector of it is nearer to a
query than the query's angle to the centre less that one. A search reads the lists of the best bounds, and then only
those whose bound its k-th score doesn't beat: the result is exact. With ``probes`` it reads so many lists of the nearest
centres and no more, which is quicker and may miss some. Scores are those of the stored vectors, in double precision.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import acos, cos, sqrt

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import vector as V
from quillgraph.operators.search import top
from quillgraph.state import written

#: Vectors that the centres are fitted on, about; and lists at most: the driver and each plan hold their centres.
SAMPLE, MOST_LISTS = 50_000, 1024
#: Lists that the first step of an exact search reads.
FIRST_LISTS = 4
#: For angles computed in double precision.
SLACK = 1e-6


@dataclass(frozen=True)
class VectorLists:
    path: str
    #: (list, centre of length 1, largest angle to it)
    lists: tuple[tuple[int, tuple[float, ...], float], ...]


def _usable(nodes: DataFrame, embedding: str) -> DataFrame:
    e = F.col(embedding).cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return nodes.select("node_id", e.alias("embedding")).where(e.isNotNull() & finite).withColumn("_l", F.sqrt(V.dot(F.col("embedding"), F.col("embedding")))).where("_l > 0")


def build(nodes: DataFrame, path: str, lists: int | None = None, embedding: str = "embedding", seed: int = 7) -> VectorLists:
    """Writes the lists of nodes (node_id, embedding); null and zero vectors, and those with parts that aren't finite, take no part."""
    spark = nodes.sparkSession
    rows = _usable(nodes, embedding)
    n = rows.count()
    if not n:
        return VectorLists(path, ())
    lists = min(lists or max(1, round(sqrt(n))), MOST_LISTS, n)
    unit = F.transform("embedding", lambda x: x / F.col("_l"))
    rate = min(1.0, SAMPLE / n)
    drawn = rows.where(F.pmod(F.xxhash64(F.lit("lists"), "node_id"), F.lit(1 << 30)) < int(rate * (1 << 30)) + 1)
    fitted = KMeans(k=lists, maxIter=12, seed=seed, distanceMeasure="cosine", initSteps=2).fit(drawn.select(array_to_vector(unit).alias("features")))
    centres = []
    for c in fitted.clusterCenters():
        length = sqrt(float(sum(x * x for x in c))) or 1.0
        centres.append([float(x) / length for x in c])
    placed = fitted.transform(rows.withColumn("features", array_to_vector(unit))).select("node_id", "embedding", "_l", F.col("prediction").alias("list"))
    placed.drop("_l").repartitionByRange("list", "node_id").write.partitionBy("list").parquet(f"{path}/vectors")
    known = spark.createDataFrame(list(enumerate(centres)), "list int, centre array<double>")
    near = V.dot(F.col("embedding"), F.col("centre")) / F.sqrt(V.dot(F.col("embedding"), F.col("embedding")))
    least = spark.read.parquet(f"{path}/vectors").join(F.broadcast(known), "list").groupBy("list").agg(F.min(near).alias("least"))  # MOST_LISTS rows
    found = {r["list"]: acos(max(-1.0, min(1.0, r["least"]))) + SLACK for r in least.collect()}
    return VectorLists(path, tuple((k, tuple(centres[k]), angle) for k, angle in sorted(found.items())))


def search(spark: SparkSession, index: VectorLists, query: list[float], k: int, probes: int | None = None) -> DataFrame:
    """node_id, score of the k nodes of largest positive cosine, ties to the smaller id."""
    length = sqrt(sum(float(x) ** 2 for x in query))
    if not index.lists or not length or k < 1:
        return spark.createDataFrame([], "node_id long, score double")
    angles = [(acos(max(-1.0, min(1.0, sum(x * y for x, y in zip(query, centre, strict=True)) / length))), k, radius) for k, centre, radius in index.lists]
    stored = spark.read.parquet(f"{index.path}/vectors")

    def best(lists: list[int]) -> DataFrame:
        score = V.cosine(F.col("embedding"), V.literal(query))
        return top(stored.where(F.col("list").isin(lists)).select("node_id", score.alias("score")).where("score > 0"), k)

    if probes is not None:
        return best([number for _, number, _ in sorted(angles)[:probes]])
    reach = sorted((max(0.0, angle - radius), number) for angle, number, radius in angles)
    first = [number for _, number in reach[:FIRST_LISTS]]
    held = written(best(first), "nearest")  # k rows
    least = held.agg(F.count("*").alias("n"), F.min("score").alias("s")).first()
    floor = least["s"] - SLACK if least["n"] == k else -SLACK
    rest = [number for angle, number in reach[FIRST_LISTS:] if cos(angle) >= floor]
    return top(held.unionByName(best(rest)), k) if rest else top(held, k)
