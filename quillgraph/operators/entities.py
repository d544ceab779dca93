"""Entities in nodes: validation, merging of duplicates, sections of one title, rules for answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as T

# The types that an entity may have.
TYPES = ["PERSON", "ORG", "LOCATION", "DATE", "TECH", "AMOUNT", "EVENT", "CONCEPT"]


def validate(candidates: DataFrame) -> DataFrame:
    """node_id, at, name, canonical, type, norm_key, slug, confidence, context of candidates that are entities.

    candidates: node_id, at, name, canonical, type, confidence, context. Opaque tokens, unknown types and empty names go.
    """
    name = T.repair_name(F.trim(F.coalesce(F.nullif(F.trim("canonical"), F.lit("")), F.col("name"))))
    rows = candidates.withColumns({"canonical": name, "type": F.upper(F.trim("type"))})
    rows = rows.where(F.col("type").isin(TYPES) & (F.length("canonical") > 0) & ~T.is_opaque(F.col("canonical")))
    clamp = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("confidence").cast("double"), F.lit(0.5))))
    rows = rows.withColumns({"confidence": clamp, "context": F.left(F.coalesce("context", F.lit("")), F.lit(120)), "norm_key": T.norm_key(F.col("canonical")), "slug": T.slug(F.col("canonical"))})
    return rows.where("norm_key <> ''").select("node_id", "at", "name", "canonical", "type", "norm_key", "slug", "confidence", "context")


def merge(entities: DataFrame, by: list[str]) -> DataFrame:
    """One row for each norm_key within ``by``: the first entity, all other spellings as sorted aliases, and the count."""
    first = lambda c: F.min_by(c, "at").alias(c)
    rows = entities.groupBy(*by, "norm_key").agg(first("canonical"), first("type"), first("slug"), F.max("confidence").alias("confidence"), F.array_union(F.collect_set("name"), F.collect_set("canonical")).alias("aliases"), F.count("*").alias("mentions"))
    return rows.withColumn("aliases", F.array_sort(F.array_except("aliases", F.array("canonical"))))


def first_sections(sections: DataFrame) -> DataFrame:
    """Adds section_key: sections of one document, level and title (without case) are the first of them."""
    group = Window.partitionBy("document_id", "level", F.lower(F.trim("title"))).orderBy("doc_position")
    return sections.withColumn("section_key", F.first("node_id").over(group))


def correct_answer(gold: Column, answer: Column) -> Column:
    """The string rule: equal, or one holds the other, after normalisation."""
    norm = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9 ]", " "), r"\s+", " "))
    g, a = norm(gold), norm(answer)
    return (a != "") & ((a == g) | a.contains(g) | ((F.length(g) > 3) & (F.length(a) > 2) & g.contains(a)))


def stratified(rows: DataFrame, stratum: str, key: str, n: int, seed: str = "0") -> DataFrame:
    """n rows of each stratum in an order that depends on key and seed only."""
    draw = F.xxhash64(F.col(key).cast("string"), F.lit(seed))
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(stratum).orderBy(draw, key))).where(F.col("_k") <= n).drop("_k")
