"""Prefix doubling over all positions, as Spark sorts rank pairs: exact, for corpora whose positions fit the shuffle.

Every position gets the rank of its first ``FIRST`` bytes, which are its rank. Then rounds at growing offsets: the pair of
a position's rank and the rank so many bytes further on is sorted, and pairs are ranked anew by their place in that
order. A position whose rank one document alone has is unique and drops out; the others go on, until ranks stand for
``LENGTH`` bytes. ``repeats.py`` does the same with far less to move; the tests hold the two against each other.

Defined cases: as in ``repeats.py``, but documents have different ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import materialise, whole_text

LENGTH = 50
#: Lengths that ranks stand for, round by round; each is at most twice the one before.
ROUNDS = (7, 14, 28, 50)


def _reranked(pairs: DataFrame) -> DataFrame:
    """doc_id, at, rank: places of the distinct pairs in their order, for positions whose pair two documents have.

    The pairs are sorted by ranges; a place is the number of pairs in the ranges before and of those before it in its own.
    The driver gets the size of each range.
    """
    shared = pairs.groupBy("a", "b").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    ranges = materialise(shared.repartitionByRange("a", "b").select("a", "b", F.spark_partition_id().alias("range")), "pairs")
    sizes = {r["range"]: r["n"] for r in ranges.groupBy("range").agg(F.count("*").alias("n")).collect()}
    before, total = {}, 0
    for k in sorted(sizes):
        before[k], total = total, total + sizes[k]
    start = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if before else F.lit(None)
    place = F.row_number().over(Window.partitionBy("range").orderBy("a", "b"))
    ranks = ranges.select("a", "b", (F.element_at(start, F.col("range")) + place).cast("long").alias("rank")) if before else ranges.select("a", "b", F.lit(0).cast("long").alias("rank"))
    return materialise(pairs.join(ranks, ["a", "b"]).select("doc_id", "at", "rank"), "ranks")


def repeated_positions(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, at: starts of LENGTH-byte strings that also start in a document with a smaller doc_id."""
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.hex(whole_text(text).cast("binary")).alias("hex"))
    first, width = ROUNDS[0], F.length("hex") / 2
    starts = F.when(width >= LENGTH, F.sequence(F.lit(0), (width - first).cast("int")))
    at = rows.select("doc_id", "hex", F.explode(starts).alias("at"))
    seed = F.conv(F.substring("hex", 2 * F.col("at") + 1, F.lit(2 * first)), 16, 10).cast("long")
    ranks = _reranked(at.select("doc_id", "at", seed.alias("a"), F.lit(0).cast("long").alias("b")))
    for before, after in zip(ROUNDS, ROUNDS[1:], strict=False):
        further = ranks.select("doc_id", (F.col("at") - (after - before)).alias("at"), F.col("rank").alias("b"))
        pairs = ranks.select("doc_id", "at", F.col("rank").alias("a")).join(further, ["doc_id", "at"])
        ranks = _reranked(materialise(pairs, "offset"))
    least = ranks.groupBy("rank").agg(F.min("doc_id").alias("least"))
    return ranks.join(least, "rank").where("doc_id > least").select("doc_id", "at").distinct()


def removed_bytes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_removed, n_spans of documents that lose bytes."""
    order = Window.partitionBy("doc_id").orderBy("at")
    rows = repeated_positions(docs, text, doc_id).withColumn("gap", F.col("at") - F.lag("at").over(order))
    fresh = F.col("gap").isNull() | (F.col("gap") > LENGTH)
    grown = F.when(fresh, LENGTH).otherwise(F.col("gap"))
    return rows.groupBy("doc_id").agg(F.sum(grown).cast("long").alias("n_removed"), F.count_if(fresh).alias("n_spans"))
