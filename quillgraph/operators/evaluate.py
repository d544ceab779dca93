"""Retrieval metrics over ranked results and gold sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.state import written


def hit_ranks(results: DataFrame, gold: DataFrame, depth: int = 10) -> DataFrame:
    """query_id, n_gold, ranks, first_rank (from 1, null without a hit), n_hits, average_precision within ``depth``.

    results: query_id, rank (from 1), node_id; gold: query_id, node_id (queries without gold have none here).
    """
    gold = gold.select("query_id", "node_id").distinct()
    n = gold.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    hits = results.where(F.col("rank") <= depth).join(gold, ["query_id", "node_id"]).groupBy("query_id").agg(F.array_sort(F.collect_set("rank")).alias("ranks"))
    rows = n.join(hits, "query_id", "left").withColumn("ranks", F.coalesce("ranks", F.array().cast("array<int>")))
    precision = F.aggregate(F.transform("ranks", lambda r, k: (k + 1) / r), F.lit(0.0), lambda a, x: a + x)
    return rows.select(
        "query_id", "n_gold", "ranks", F.array_min("ranks").alias("first_rank"), F.size("ranks").alias("n_hits"),
        (precision / F.least(F.col("n_gold"), F.lit(depth))).alias("average_precision"),
    )


def metrics(ranks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Hits@1, 4, 10, MRR, MAP, gold recall and NDCG (single gold: by its first rank), over all queries or for each type."""
    at = lambda k: F.avg(F.coalesce((F.col("first_rank") <= k).cast("double"), F.lit(0.0))).alias(f"hits_{k}")
    first = F.col("first_rank")
    return ranks.groupBy(*(by or [])).agg(
        F.count("*").alias("n_queries"), at(1), at(4), at(10),
        F.avg(F.coalesce(1.0 / first, F.lit(0.0))).alias("mrr"),
        F.avg("average_precision").alias("map"),
        F.avg(F.col("n_hits") / F.col("n_gold")).alias("gold_recall"),
        F.avg(F.coalesce(1.0 / F.log2(first + 1.0), F.lit(0.0))).alias("ndcg"),
    )


def compare_reports(before: DataFrame, after: DataFrame, key: str = "config") -> DataFrame:
    """Differences of the numeric columns of two reports."""
    names = [c for c, kind in before.dtypes if c != key and kind in ("double", "float", "bigint", "int")]
    b = before.select(key, *[F.col(c).alias(f"_b_{c}") for c in names])
    return after.join(b, key).select(key, *[(F.col(c) - F.col(f"_b_{c}")).alias(c) for c in names])


def ablation(run, gold: DataFrame, configs: dict[str, object], depth: int = 10) -> DataFrame:
    """config and its metrics, for ``run(config) -> (query_id, rank, node_id)`` under each of a few named settings."""
    parts = [metrics(hit_ranks(run(config), gold, depth)).withColumn("config", F.lit(name)) for name, config in configs.items()]
    return reduce(DataFrame.unionByName, parts)


def contribution_frame(phases: dict[str, DataFrame], by: str = "query_id") -> DataFrame:
    """query_id, phase, node_id, scaled: each phase's scores over their greatest one of the query. phases: query_id, node_id, score.

    Written once: whatever is weighed afterwards reads it, and no phase runs again.
    """
    rows = reduce(DataFrame.unionByName, [df.select(by, F.lit(phase).alias("phase"), "node_id", F.col("score").cast("double").alias("score")) for phase, df in phases.items()])
    rows = written(rows.where("score IS NOT NULL"), "phases")
    most = rows.groupBy(by, "phase").agg(F.greatest(F.max("score"), F.lit(0.0)).alias("_most"))
    return rows.join(most, [by, "phase"]).select(by, "phase", "node_id", F.when(F.col("_most") > 0, F.col("score") / F.col("_most")).otherwise(F.col("score")).alias("scaled"))


def fused_by(contributions: DataFrame, settings: dict[str, dict[str, float]], depth: int, by: str = "query_id") -> DataFrame:
    """config, query_id, rank (1 to ``depth``), node_id, score under each of some settings (phase -> weight; 0 or absent: off).

    One pass: every contribution is weighed by all settings at once, and each node and query carries a score a setting.
    """
    names = list(settings)
    weight = lambda config: reduce(lambda e, phase: e.when(F.col("phase") == phase, float(settings[config][phase])), [p for p, w in settings[config].items() if w], F.when(F.lit(False), 0.0)).otherwise(0.0)
    sums = contributions.groupBy(by, "node_id").agg(*[F.sum(weight(c) * F.col("scaled")).alias(f"_s{k}") for k, c in enumerate(names)], *[F.max(weight(c) > 0).alias(f"_in{k}") for k, c in enumerate(names)])
    long = sums.select(by, "node_id", F.explode(F.array(*[F.struct(F.lit(c).alias("config"), F.col(f"_s{k}").alias("score"), F.col(f"_in{k}").alias("on")) for k, c in enumerate(names)])).alias("x"))
    long = long.where("x.on").select("x.config", by, "node_id", "x.score")
    rank = F.row_number().over(Window.partitionBy("config", by).orderBy(F.desc("score"), "node_id"))
    return long.withColumn("rank", rank).where(F.col("rank") <= depth).select("config", by, "rank", "node_id", "score")


def matrix(phases: dict[str, DataFrame], gold: DataFrame, settings: dict[str, dict[str, float]], depth: int = 10) -> DataFrame:
    """config and its metrics (``metrics``) over all queries of ``gold`` (query_id, node_id), from one run of the phases."""
    ranked = fused_by(contribution_frame(phases), settings, depth)
    each = gold.select(F.explode(F.array(*[F.lit(c) for c in settings])).alias("config"), F.struct("query_id").alias("_q"), "node_id")
    key = F.struct("config", F.col("_q.query_id").alias("query_id"))
    results = ranked.select(F.struct("config", "query_id").alias("query_id"), "rank", "node_id")
    ranks = hit_ranks(results, each.select(key.alias("query_id"), "node_id"), depth).withColumn("config", F.col("query_id.config"))
    return metrics(ranks, ["config"])


def rank_accuracy(feedback: DataFrame) -> DataFrame:
    """Positive and negative signals of each rank, and their accuracy."""
    rows = feedback.groupBy("result_rank").agg(F.count_if(F.col("signal") == "positive").alias("positive"), F.count_if(F.col("signal") == "negative").alias("negative"))
    return rows.withColumn("accuracy", F.col("positive") / F.nullif(F.col("positive") + F.col("negative"), F.lit(0)))


def recall_at(ranks: DataFrame, ks: tuple[int, ...] = (1, 5, 10, 20), by: list[str] | None = None) -> DataFrame:
    """Mean share of a query's gold nodes among its first k results, for each k; ``hit_ranks`` must reach that deep."""
    within = lambda k: F.avg(F.size(F.filter("ranks", lambda r: r <= k)) / F.col("n_gold")).alias(f"recall_{k}")
    return ranks.groupBy(*(by or [])).agg(*[within(k) for k in ks])
