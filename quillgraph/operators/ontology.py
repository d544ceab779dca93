"""Ontology: class files, tag resolution and validation, vocabulary lookup, depth and lanes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.state import written


def read_classes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Class names, and child, parent rows, of RDF/XML files; one row is read per class element."""
    text = spark.read.option("lineSep", "</owl:Class>").text(path)
    name = F.regexp_extract("value", r'<owl:Class[^>]*?rdf:(?:about|ID)="(?:[^"]*[#/])?([^"#/]+)"', 1)
    rows = text.select(name.alias("child"), F.regexp_extract_all("value", F.lit(r'<rdfs:subClassOf[^>]*?rdf:resource="(?:[^"]*[#/])?([^"#/]+)"'), F.lit(1)).alias("up")).where("child <> ''")
    edges = rows.select("child", F.explode("up").alias("parent")).distinct()
    return rows.select(F.col("child").alias("name")).unionByName(edges.select(F.col("parent").alias("name"))).distinct(), edges


def seed(existing: DataFrame, defaults: DataFrame, key: str) -> DataFrame:
    """Defaults for keys that don't exist yet; what exists stays."""
    return existing.unionByName(defaults.join(existing.select(key), key, "left_anti").select(*existing.columns))


def tag_key(tag: Column) -> Column:
    """A tag without case and separators."""
    return F.regexp_replace(F.lower(tag), r"[_\s-]", "")


def resolve_tags(tags: DataFrame, names: DataFrame, aliases: DataFrame) -> DataFrame:
    """tag, canonical of distinct tags: exact name, same key, first alias that is a name, longest part that is one; else null.

    tags: tag; names: name; aliases: alias_key, place, name. The first name of a key in order stands for it.
    """
    tags = tags.select("tag").where("tag IS NOT NULL").distinct().withColumns({"_t": F.trim("tag"), "_k": tag_key(F.trim("tag"))})
    keyed = names.groupBy(tag_key(F.col("name")).alias("_k")).agg(F.min("name").alias("_same"))
    exact = names.select(F.col("name").alias("_t"), F.col("name").alias("_exact")).distinct()
    known = aliases.join(names.distinct(), "name").groupBy(F.col("alias_key").alias("_k")).agg(F.min_by("name", "place").alias("_alias"))
    parts = F.filter(F.split(F.trim(F.regexp_replace("_t", "([A-Z])", " $1")), r"\s+"), lambda w: F.length(w) >= 3)
    words = tags.select("tag", F.posexplode(parts).alias("_at", "_word"), F.size(parts).alias("_n")).where("_n > 1").withColumn("_k", tag_key(F.col("_word")))
    longest = words.join(keyed, "_k").groupBy("tag").agg(F.min_by("_same", F.struct((-F.length("_word")).alias("l"), "_at")).alias("_part"))
    rows = tags.join(exact, "_t", "left").join(keyed, "_k", "left").join(known, "_k", "left").join(longest, "tag", "left")
    return rows.select("tag", F.coalesce("_exact", "_same", "_alias", "_part").alias("canonical"))


def validate_tags(nodes: DataFrame, resolved: DataFrame, key: str = "node_id", tags: str = "tags") -> DataFrame:
    """Adds valid (distinct canonical names, in order), invalid (as they were) and resolved_map (changed ones)."""
    long = nodes.select(key, F.posexplode(tags).alias("_at", "tag")).join(resolved, "tag", "left")
    ordered = lambda value, keep: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("_at", value.alias("v"))))), lambda x: x["v"])
    ok = F.col("canonical").isNotNull()
    changed = ok & (F.col("canonical") != F.col("tag"))
    found = long.groupBy(key).agg(
        F.array_distinct(ordered(F.col("canonical"), ok)).alias("valid"), ordered(F.col("tag"), ~ok).alias("invalid"),
        F.map_from_entries(F.array_distinct(F.collect_list(F.when(changed, F.struct("tag", "canonical"))))).alias("resolved_map"),
    )
    none = F.array().cast("array<string>")
    rows = nodes.join(found, key, "left")
    return rows.withColumns({"valid": F.coalesce("valid", none), "invalid": F.coalesce("invalid", none)})


def known_words(texts: DataFrame, vocabulary: DataFrame, key: str, text: str) -> DataFrame:
    """key, word of the words of a text that a vocabulary (word) has."""
    words = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)))).alias("word"))
    return words.join(vocabulary.select("word").distinct(), "word", "left_semi").select(key, "word")


#: Levels of a hierarchy; a deeper one has a circle, which is an error.
DEEPEST = 1000


def _too_deep() -> RuntimeError:
    return RuntimeError(f"a hierarchy of more than {DEEPEST} levels: it has a circle")


def primary_depth(hierarchy: DataFrame, root: str) -> DataFrame:
    """name, depth, lane (ancestor right under the root) along each name's first parent.

    Every level is written, so a round reads the last one only. Names in a circle aren't under the root.
    """
    first = hierarchy.groupBy("child").agg(F.min("parent").alias("parent"))
    first = written(first.where(F.col("child") != root), "parents")
    front = written(first.where(F.col("parent") == root).select(F.col("child").alias("name"), F.lit(1).alias("depth"), F.col("child").alias("lane")), "level")
    found = front
    for k in range(2, DEEPEST + 2):
        front = written(first.join(front, F.col("parent") == F.col("name")).select(F.col("child").alias("name"), F.lit(k).alias("depth"), "lane"), "level")
        if front.isEmpty():
            return found
        found = found.unionByName(front)
    raise _too_deep()


def lane_weights(lanes: DataFrame) -> DataFrame:
    """lane, n, share: square-rooted sizes as shares of the circle, in order of size."""
    sizes = lanes.groupBy("lane").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum(F.sqrt("n")).alias("_all"))
    order = Window.orderBy(F.desc("n"), "lane")  # one row a lane
    return sizes.crossJoin(F.broadcast(total)).select("lane", "n", (F.sqrt("n") / F.col("_all")).alias("share"), F.row_number().over(order).alias("place"))


def category_tree(hierarchy: DataFrame, categories: DataFrame) -> DataFrame:
    """name, parent of categories: the nearest ancestor that is a category too, the smallest of equals; null for a root.

    hierarchy: child, parent; categories: name. A climb stops at the first category that it meets.
    """
    names = categories.select("name").distinct()
    front = names.select("name", F.col("name").alias("at"))
    found = None
    for _ in range(DEEPEST + 1):
        step = front.join(hierarchy, F.col("at") == F.col("child")).select("name", F.col("parent").alias("at")).where("name <> at").distinct()
        met = step.join(names.select(F.col("name").alias("at")), "at", "left_semi").groupBy("name").agg(F.min("at").alias("parent"))
        found = met if found is None else found.unionByName(met)
        front = written(step.join(met.select("name"), "name", "left_anti"), "climb")
        if front.isEmpty():
            return names.join(found, "name", "left").select("name", "parent")
    raise _too_deep()


def subtree_weights(tree: DataFrame, sizes: DataFrame) -> DataFrame:
    """name, parent, weight: the square root of a category's own size (1 where it has none), and of all below it.

    tree: name, parent; sizes: name, n.
    """
    own = tree.join(sizes, "name", "left").select("name", "parent", F.sqrt(F.coalesce("n", F.lit(1))).alias("own"))
    up = own.select("name", F.col("name").alias("at"), "own")
    found = up.select("at", "own")
    for _ in range(DEEPEST + 1):
        up = written(up.join(tree.select(F.col("name").alias("at"), "parent"), "at").where("parent IS NOT NULL").select("name", F.col("parent").alias("at"), "own"), "up")
        if up.isEmpty():
            break
        found = found.unionByName(up.select("at", "own"))
    else:
        raise _too_deep()
    return own.select("name", "parent").join(found.groupBy(F.col("at").alias("name")).agg(F.sum("own").alias("weight")), "name")


def angles(weights: DataFrame, floor: float = 8.0) -> DataFrame:
    """name, start, end in degrees: each category's part of its parent's arc by weight, heaviest first, ties by name.

    A part is at least ``floor`` where the arc has room for all; what that takes comes from the larger parts in proportion.
    """
    placed = weights.where("parent IS NULL").select("name", F.lit(None).cast("string").alias("parent"), "weight", F.lit(0.0).alias("a0"), F.lit(360.0).alias("a1"))
    found = None
    for _ in range(DEEPEST + 1):
        arc, total, kids = F.col("a1") - F.col("a0"), F.sum("weight").over(Window.partitionBy("parent")), F.count("*").over(Window.partitionBy("parent"))
        rows = placed.withColumns({"_slice": F.col("weight") / total * arc, "_room": arc >= kids * floor})
        low = F.col("_slice") < floor
        lack = F.sum(F.when(low, floor - F.col("_slice")).otherwise(0.0)).over(Window.partitionBy("parent"))
        rest = F.sum(F.when(low, 0.0).otherwise(F.col("_slice"))).over(Window.partitionBy("parent"))
        fitted = F.when(~F.col("_room") | (rest <= 0), F.col("_slice")).when(low, floor).when(F.col("_slice") > floor, F.col("_slice") - lack * F.col("_slice") / rest).otherwise(F.col("_slice"))
        order = Window.partitionBy("parent").orderBy(F.desc("weight"), "name")
        rows = rows.withColumn("_fit", fitted).withColumn("_upto", F.sum("_fit").over(order))
        rows = written(rows.select("name", (F.col("a0") + F.col("_upto") - F.col("_fit")).alias("start"), (F.col("a0") + F.col("_upto")).alias("end")), "arcs")
        found = rows if found is None else found.unionByName(rows)
        placed = weights.join(rows.select(F.col("name").alias("parent"), F.col("start").alias("a0"), F.col("end").alias("a1")), "parent").select("name", "parent", "weight", "a0", "a1")
        if placed.isEmpty():
            return found
    raise _too_deep()
