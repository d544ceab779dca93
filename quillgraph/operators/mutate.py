"""Changes to stored collections, as frames that replace the old ones. Writers overwrite or append the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert_entities(existing: DataFrame, found: DataFrame) -> DataFrame:
    """Entities merged by slug: aliases and documents united, mentions added, first name and type kept, earliest first_seen.

    Both: slug, name, type, aliases[], document_ids[], mention_count, first_seen. Existing rows come before found ones.
    """
    rows = existing.withColumn("_new", F.lit(0)).unionByName(found.withColumn("_new", F.lit(1)))
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)  # noqa: E731  equal lists count once, before the shuffle
    first = lambda c: F.min_by(c, F.struct("_new", "name")).alias(c)
    return rows.groupBy("slug").agg(first("name"), first("type"), union("aliases"), union("document_ids"), F.sum("mention_count").alias("mention_count"), F.min("first_seen").alias("first_seen"))


def patch(rows: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """Columns that a patch names replace the old ones where they aren't null."""
    named = [c for c in patches.columns if c != key]
    renamed = patches.select(key, *[F.col(c).alias(f"_p_{c}") for c in named])
    joined = rows.join(renamed, key, "left")
    return joined.select(*[F.coalesce(f"_p_{c}", c).alias(c) if c in named else c for c in rows.columns])


def latest(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """Save or replace on conflict: the last row of each key."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(order.desc()))).where("_k = 1").drop("_k")


def survivors(entities: DataFrame) -> DataFrame:
    """slug, survivor: of entities with one norm_key the one of most mentions, then the oldest, then by slug, stays."""
    best = entities.groupBy("norm_key").agg(F.min(F.struct((-F.col("mention_count")).alias("m"), "first_seen", "slug")).alias("b"))
    return entities.join(best, "norm_key").select("slug", F.col("b.slug").alias("survivor"))


def repoint(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with both ends moved to the survivors, duplicates and loops that this makes dropped."""
    out = edges
    for end in ("src", "dst"):
        out = out.join(mapping.select(F.col("slug").alias(end), F.col("survivor").alias("_to")), end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return out.where("src <> dst").dropDuplicates(["src", "dst", "relation"]).select(*edges.columns)


def without_noise(rollups: DataFrame, noise: DataFrame, column: str = "entity_slugs") -> DataFrame:
    """Noise slugs taken out of an array column (noise: slug)."""
    long = rollups.select("node_id", F.posexplode(column).alias("_k", "slug")).join(noise.select("slug"), "slug", "left_anti")
    kept = long.groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "slug"))), lambda x: x["slug"]).alias(column))
    return rollups.drop(column).join(kept, "node_id", "left").withColumn(column, F.coalesce(column, F.array().cast("array<string>")))


def new_files(incoming: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """Files to ingest: unseen hashes, and partial ones again; all with ``force``."""
    incoming = incoming.dropDuplicates(["file_hash"])
    return incoming if force else incoming.join(stored.where("ingestion_status = 'complete'").select("file_hash").distinct(), "file_hash", "left_anti")


def claim_next(jobs: DataFrame) -> DataFrame:
    """The oldest waiting job."""
    return jobs.where("status = 'waiting'").orderBy("created_at", "job_id").limit(1)


def after_failure(jobs: DataFrame, most_attempts: int = 3) -> DataFrame:
    """Failed jobs wait again after 500 ms per attempt if their error passes; else they stay failed."""
    again = (F.col("status") == "failed") & F.col("error").rlike("OOM|RATE_LIMIT") & (F.col("attempts") < most_attempts)
    return jobs.withColumns({"status": F.when(again, "waiting").otherwise(F.col("status")), "delay_ms": F.when(again, 500 * F.col("attempts")).otherwise(F.lit(0))})
