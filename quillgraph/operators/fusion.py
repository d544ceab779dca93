"""Score fusion and the tiers of an answer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.config import DEFAULT, PHASES, EngineConfig
from quillgraph.state import written


def contributions(phases: dict[str, DataFrame], weights: dict[str, float], normalise: bool = True) -> DataFrame:
    """phase, node_id, raw_score, score: raw scores over their phase's greatest, times the phase's weight."""
    parts = [df.select(F.lit(phase).alias("phase"), "node_id", F.col("score").cast("double").alias("raw_score"), F.lit(float(weights[phase])).alias("w")) for phase, df in phases.items()]
    rows = reduce(DataFrame.unionByName, parts)
    # One row a phase: the maxima are a small join, not a window over all candidates of a phase.
    most = rows.groupBy("phase").agg(F.greatest(F.max("raw_score"), F.lit(0.0)).alias("most"))
    scaled = F.when((F.col("most") > 0) & F.lit(normalise), F.col("raw_score") / F.col("most")).otherwise(F.col("raw_score"))
    return rows.join(F.broadcast(most), "phase").select("phase", "node_id", "raw_score", (F.col("w") * scaled).alias("score"))


def fuse(rows: DataFrame) -> DataFrame:
    """node_id, score, n_contributions, raw_bm25, sources (in phase order) of contributions."""
    place = F.array_position(F.array(*[F.lit(p) for p in PHASES]), F.col("phase"))
    return rows.groupBy("node_id").agg(
        F.sum("score").alias("score"),
        F.count("*").alias("n_contributions"),
        F.max(F.when(F.col("phase") == "fulltext", F.col("raw_score"))).alias("raw_bm25"),
        F.transform(F.array_sort(F.collect_list(F.struct(place.alias("at"), "phase"))), lambda x: x["phase"]).alias("sources"),
    )


def percentile_floor(rows: DataFrame, score: str, percentile: float) -> DataFrame:
    """One row, ``floor``: element floor(n * p) (from 0) of the scores in ascending order; nulls don't count, none gives no row.

    Equal scores are counted first; ranges of scores are then summed, and only the range with the element is ranked. The
    driver gets one sum for each range.
    """
    counts = rows.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("floor")).agg(F.count("*").alias("n"))
    counts = written(counts.repartitionByRange("floor").select("floor", "n", F.spark_partition_id().alias("part")), "ranges")
    sums = counts.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    total, before, part = sum(r["n"] for r in sums), 0, None
    at = min(total - 1, int(total * percentile))
    for r in sums:
        if before + r["n"] > at:
            part = r["part"]
            break
        before += r["n"]
    upto = F.sum("n").over(Window.orderBy("floor"))
    return counts.where(F.col("part") == F.lit(part)).withColumn("_upto", upto).where(F.col("_upto") > at - before).agg(F.min("floor").alias("floor")).where("floor IS NOT NULL")


def principal(fused: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """At most ``principal_limit`` entries of two contributions or more and a score at or above the percentile's.

    Fused entries are at most the phases' limits together, so their ranks are one bounded window, and the phases run once.
    """
    everything = Window.partitionBy()
    ranked = fused.withColumns({"_n": F.count("*").over(everything), "_rank": F.row_number().over(Window.orderBy("score")) - 1})
    at = F.least(F.col("_n") - 1, F.floor(F.col("_n") * F.lit(config.principal_percentile)))
    ranked = ranked.withColumn("_floor", F.max(F.when(F.col("_rank") == at, F.col("score"))).over(everything))
    chosen = ranked.where((F.col("n_contributions") >= 2) & (F.col("score") >= F.col("_floor")))
    return chosen.drop("_n", "_rank", "_floor").orderBy(F.desc("score"), "node_id").limit(config.principal_limit)


def integrity(chosen: DataFrame, structural: DataFrame, cross_document: DataFrame, contradicts: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """node_id, provenance, contradicted: principal entries, their structural neighbours, strong cross-document ones."""
    near = structural.join(chosen.select(F.col("node_id").alias("src")), "src", "left_semi").select(F.col("dst").alias("node_id"), F.lit("structural").alias("provenance"))
    near = near.join(chosen.select("node_id"), "node_id", "left_anti")
    strong = cross_document.where(F.col("score") >= config.integrity_min).select("node_id", F.lit("cross_document").alias("provenance")).join(chosen.select("node_id"), "node_id", "left_anti")
    rows = chosen.select("node_id", F.lit("principal").alias("provenance")).unionByName(near).unionByName(strong)
    flagged = contradicts.select(F.col("dst").alias("node_id")).distinct().withColumn("contradicted", F.lit(True))
    return rows.join(flagged, "node_id", "left").withColumn("contradicted", F.coalesce("contradicted", F.lit(False)))


def explorer(candidates: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """The frontier: candidates too weak for integrity, but not below the scent that stops exploration."""
    return candidates.where((F.col("score") >= config.explorer_stop) & (F.col("score") < config.integrity_min))


def best_of(rows: DataFrame, key: str = "node_id") -> DataFrame:
    """The highest score of each node over iterations."""
    return rows.groupBy(key).agg(F.max("score").alias("score"))


def corrective_filter(rows: DataFrame, hints: list[str], exempt: Column) -> DataFrame:
    """Drops structural rows that share no tag with the hints, unless exempt."""
    if not hints:
        return rows
    wanted = F.array(*[F.lit(h) for h in hints])
    return rows.where(exempt | F.coalesce(F.arrays_overlap("tags", wanted), F.lit(False)))
