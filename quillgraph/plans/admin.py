"""Counts, coverage, feedback, jobs, sessions, evaluation and generic relational operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgraph.operators import evaluate, mutate
from quillgraph.sources import adapters as A


def health_counts(spark, d):
    e = A.table(spark, d, "events")
    return e.agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("n_error"), F.countDistinct("user_id").alias("n_users"))


def queue_stats(spark, d):
    return A.table(spark, d, "events").groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"))


def claim_next(spark, d):
    e = A.table(spark, d, "events")
    jobs = e.select(F.col("event_id").alias("job_id"), F.when(F.col("event_type") == "view", "waiting").otherwise("done").alias("status"), F.col("ts").alias("created_at"))
    return mutate.claim_next(jobs).select("job_id", "status")


def retry_jobs(spark, d):
    e = A.table(spark, d, "events")
    jobs = e.select(F.col("event_id").alias("job_id"), F.when(F.col("event_type") == "error", "failed").otherwise("done").alias("status"), F.when(F.col("value") > 20, "OOM").otherwise("PARSE").alias("error"), (F.col("user_id") % 5).alias("attempts"))
    return mutate.after_failure(jobs).groupBy("status", "delay_ms").agg(F.count("*").alias("n"))


def feedback_by_rank(spark, d):
    rows = evaluate.rank_accuracy(A.feedback(spark, d))
    return rows.select("result_rank", "positive", "negative", F.round("accuracy", 6).alias("accuracy"))


def top_positive_nodes(spark, d):
    rows = A.feedback(spark, d).where("signal = 'positive'").groupBy("node_id").agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "node_id").limit(10)


def tag_frequency(spark, d):
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    return A.texts(spark, d, "documents").select(F.explode(words).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def coverage_ratio(spark, d):
    docs = A.texts(spark, d, "documents").join(A.table(spark, d, "labels"), "doc_id", "left")
    return docs.groupBy("lang").agg(F.count("*").alias("n"), F.count("quality").alias("n_labelled"), F.round(F.count("quality") / F.count("*"), 6).alias("ratio"), F.round(F.avg(F.coalesce(F.col("quality").cast("double"), F.lit(0.0))), 6).alias("mean_quality"))


def decay_distribution(spark, d):
    docs = A.documents(spark, d)
    return docs.groupBy(F.coalesce("decay_class", F.lit("(unset)")).alias("decay_class")).agg(F.count("*").alias("n"), F.min("published").alias("earliest"), F.max("published").alias("latest"))


def session_last_n(spark, d):
    turns = A.table(spark, d, "conversations")
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("k", F.row_number().over(order)).where("k <= 3").select("conv_id", "turn", "role", F.md5(F.left("text", F.lit(500))).alias("digest"))


def like_filter(spark, d):
    return A.table(spark, d, "part").where(F.col("p_name").rlike("(?i)ED.*R")).select("p_partkey", "p_name")


def limit_offset(spark, d):
    return A.table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20).select("o_orderkey", "o_totalprice")


def multi_sort(spark, d):
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderpriority", "o_orderkey")
    return A.table(spark, d, "orders").withColumn("k", F.row_number().over(order)).select("o_orderkey", "k")


def store_query(spark, d):
    """The store's filter, sort, limit and projection with bound parameters, as Spark SQL."""
    return spark.sql(
        "SELECT o_orderkey, o_orderstatus, o_totalprice FROM {orders} WHERE o_totalprice > :least AND o_orderstatus = :status ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
        args={"least": 100000.0, "status": "F"}, orders=A.table(spark, d, "orders"),
    )


def patch_rows(spark, d):
    base = A.table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    changes = A.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.when(F.count("*") > 12, "LOYAL").alias("c_mktsegment"))
    return mutate.patch(base, changes, "c_custkey")


def replace_on_conflict(spark, d):
    rows = A.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return mutate.latest(rows, "o_custkey", F.struct("o_orderdate", "o_orderkey")).select("o_custkey", "o_orderkey")


def noise_cleanup(spark, d):
    rollups = A.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("node_id")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("entity_slugs"))
    noise = A.table(spark, d, "orders").select(F.col("o_orderpriority").alias("slug")).where("slug LIKE '%N%'").distinct()
    return mutate.without_noise(rollups, noise).select("node_id", F.array_join("entity_slugs", ",").alias("slugs"))


def _gold(spark, d):
    return A.table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("query_id"), (F.col("o_orderkey") % 30).alias("node_id"), "o_orderpriority", "o_orderstatus").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'").select("query_id", "node_id").distinct()


def _ranked(spark, d):
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id")
    rows = A.table(spark, d, "orders").groupBy((F.col("o_custkey") % 50).alias("query_id"), (F.col("o_orderkey") % 30).alias("node_id")).agg(F.max("o_totalprice").alias("score"))
    return rows.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "node_id")


def eval_ranks(spark, d):
    ranks = evaluate.hit_ranks(_ranked(spark, d), _gold(spark, d))
    return ranks.select("query_id", "n_gold", "first_rank", "n_hits", F.round("average_precision", 6).alias("average_precision"))


def eval_metrics(spark, d):
    m = evaluate.metrics(evaluate.hit_ranks(_ranked(spark, d), _gold(spark, d)))
    return m.select("n_queries", *[F.round(c, 6).alias(c) for c in ("hits_1", "hits_4", "hits_10", "mrr", "map", "gold_recall", "ndcg")])


def hourly_events(spark, d):
    return A.table(spark, d, "events").groupBy(F.window("ts", "1 hour")["start"].alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))


def sessions(spark, d):
    """Sessions of a user: events less than 30 minutes apart."""
    rows = A.table(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n"))
    return rows.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))


QUERIES = {f.__name__: f for f in (health_counts, queue_stats, claim_next, retry_jobs, feedback_by_rank, top_positive_nodes, tag_frequency, coverage_ratio, decay_distribution, session_last_n, like_filter, limit_offset, multi_sort, store_query, patch_rows, replace_on_conflict, noise_cleanup, eval_ranks, eval_metrics, hourly_events, sessions)}

_FB = "fb AS (SELECT user_id AS node_id, event_id % 20 AS result_rank, CASE event_type WHEN 'purchase' THEN 'positive' ELSE 'negative' END AS signal FROM events WHERE event_type IN ('purchase', 'error'))"
_EVAL = """gold AS (SELECT DISTINCT o_custkey % 50 AS query_id, o_orderkey % 30 AS node_id FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'),
rk AS (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM (SELECT o_custkey % 50 AS query_id, o_orderkey % 30 AS node_id, max(o_totalprice) AS score FROM orders GROUP BY 1, 2)),
h AS (SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM rk JOIN gold USING (query_id, node_id) WHERE rank <= 10),
q AS (SELECT g.query_id, g.n AS n_gold, min(rank) AS first_rank, count(rank) AS n_hits, coalesce(sum(k / rank::DOUBLE), 0) / least(g.n, 10) AS ap FROM (SELECT query_id, count(*) AS n FROM gold GROUP BY 1) g LEFT JOIN h USING (query_id) GROUP BY g.query_id, g.n)"""

ORACLE = {
    "health_counts": "SELECT count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS n_error, count(DISTINCT user_id) AS n_users FROM events",
    "queue_stats": "SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1",
    "claim_next": "SELECT event_id AS job_id, 'waiting' AS status FROM events WHERE event_type = 'view' ORDER BY ts, event_id LIMIT 1",
    "retry_jobs": "SELECT CASE WHEN a THEN 'waiting' WHEN event_type = 'error' THEN 'failed' ELSE 'done' END AS status, CASE WHEN a THEN 500 * (user_id % 5) ELSE 0 END AS delay_ms, count(*) AS n FROM (SELECT *, event_type = 'error' AND value > 20 AND user_id % 5 < 3 AS a FROM events) GROUP BY 1, 2",
    "feedback_by_rank": f"WITH {_FB} SELECT result_rank, count(*) FILTER (WHERE signal = 'positive') AS positive, count(*) FILTER (WHERE signal = 'negative') AS negative, round(avg((signal = 'positive')::INT), 6) AS accuracy FROM fb GROUP BY 1",
    "top_positive_nodes": f"WITH {_FB} SELECT node_id, count(*) AS n FROM fb WHERE signal = 'positive' GROUP BY 1 ORDER BY n DESC, node_id LIMIT 10",
    "tag_frequency": "SELECT tag, count(*) AS n FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS tag FROM documents) GROUP BY tag",
    "coverage_ratio": "SELECT lang, count(*) AS n, count(quality) AS n_labelled, round(count(quality) / count(*)::DOUBLE, 6) AS ratio, round(avg(coalesce(quality, 0)::DOUBLE), 6) AS mean_quality FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang",
    "decay_distribution": "WITH d AS (SELECT ['EVERGREEN', 'SCHOLARLY', 'CURRENT', 'EPHEMERAL'][regexp_extract(source, '(\\d+)', 1)::INT % 4 + 1] AS decay_class, DATE '1995-01-01' + (doc_id * 7 % 10000)::INT AS p FROM documents) SELECT coalesce(decay_class, '(unset)') AS decay_class, count(*) AS n, min(p) AS earliest, max(p) AS latest FROM d GROUP BY 1",
    "session_last_n": "SELECT conv_id, turn, role, md5(left(text, 500)) AS digest FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3",
    "like_filter": "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%ed%r%'",
    "limit_offset": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40",
    "multi_sort": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderpriority, o_orderkey) AS k FROM orders",
    "store_query": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "patch_rows": "SELECT c_custkey, CASE WHEN n > 12 THEN 'LOYAL' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey",
    "replace_on_conflict": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "noise_cleanup": "SELECT o_custkey AS node_id, coalesce(string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) FILTER (WHERE o_orderpriority NOT LIKE '%N%'), '') AS slugs FROM orders GROUP BY 1",
    "eval_ranks": f"WITH {_EVAL} SELECT query_id, n_gold, first_rank, n_hits, round(ap, 6) AS average_precision FROM q",
    "eval_metrics": f"WITH {_EVAL} SELECT count(*) AS n_queries, round(avg(coalesce(first_rank <= 1, false)::INT), 6) AS hits_1, round(avg(coalesce(first_rank <= 4, false)::INT), 6) AS hits_4, round(avg(coalesce(first_rank <= 10, false)::INT), 6) AS hits_10, round(avg(coalesce(1.0::DOUBLE / first_rank, 0)), 6) AS mrr, round(avg(ap), 6) AS map, round(avg(n_hits / n_gold::DOUBLE), 6) AS gold_recall, round(avg(coalesce(1.0::DOUBLE / log2(first_rank + 1), 0)), 6) AS ndcg FROM q",
    "hourly_events": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2",
    "sessions": "WITH l AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE, true)::INT AS s FROM events), g AS (SELECT user_id, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM l), c AS (SELECT user_id, g, count(*) AS n FROM g GROUP BY 1, 2) SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM c GROUP BY 1",
}
