"""Entities of one type that are the same, or forms of one another, over whole types; and chains of merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.state import written

#: Rounds after which following merges ends with an error; each halves the way to a survivor.
MOST_ROUNDS = 60


def _worded(entities: DataFrame) -> DataFrame:
    words = F.array_sort(F.array_distinct(T.tokens(F.col("canonical"))))
    return entities.where("slug IS NOT NULL").dropDuplicates(["type", "slug"]).select("type", "slug", words.alias("words")).where(F.size("words") > 0)


def same_words(entities: DataFrame) -> DataFrame:
    """type, slug, survivor: entities of a type whose names have the same words go to the one of the smallest slug."""
    rows = _worded(entities)
    first = rows.groupBy("type", "words").agg(F.min("slug").alias("survivor"))
    return rows.join(first, ["type", "words"]).where("slug <> survivor").select("type", "slug", "survivor")


def _wider(names: DataFrame) -> DataFrame:
    """type, words, wider: of different sets of words of a type (type, words), those that hold all words of another, and more.

    A wider set has the other's rarest word too: they meet on that word, over the whole type, and the others are tested.
    """
    names = names.withColumn("n", F.size("words"))
    long = names.select("type", "words", "n", F.explode("words").alias("word"))
    frequency = long.groupBy("type", "word").agg(F.count("*").alias("f"))
    rarest = long.join(frequency, ["type", "word"]).groupBy("type", "words").agg(F.min(F.struct("f", "word")).alias("r"))
    parents = rarest.where("r.f > 1").select("type", "words", F.size("words").alias("_np"), F.col("r.word").alias("word"))
    children = long.select("type", "word", F.col("words").alias("wider"), F.col("n").alias("_nc"))
    met = parents.join(children, ["type", "word"]).where("_np < _nc")
    return met.where((F.col("_np") == 1) | (F.size(F.array_except("words", "wider")) == 0)).select("type", "words", "wider")


def variants(entities: DataFrame) -> DataFrame:
    """type, parent, child: the name of a child has all words of its parent, and more. A row for each pair: ``variant_counts`` has none."""
    rows = _worded(entities)
    own = lambda c, words: rows.select("type", F.col("words").alias(words), F.col("slug").alias(c))
    pairs = _wider(rows.select("type", "words").distinct())
    return pairs.join(own("parent", "words"), ["type", "words"]).join(own("child", "wider"), ["type", "wider"]).select("type", "parent", "child")


def variant_counts(entities: DataFrame) -> DataFrame:
    """type, parent, n, first: how many children each parent has (``variants``), and the smallest.

    Entities of the same words are one class with a count, so that copies of a name form no pairs.
    """
    rows = _worded(entities)
    classes = written(rows.groupBy("type", "words").agg(F.count("*").alias("n"), F.min("slug").alias("first")), "classes")
    sizes = classes.select("type", F.col("words").alias("wider"), "n", "first")
    found = _wider(classes.select("type", "words")).join(sizes, ["type", "wider"]).groupBy("type", "words").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    return rows.join(found, ["type", "words"]).select("type", F.col("slug").alias("parent"), "n", "first")


def final_survivors(merges: list[DataFrame]) -> DataFrame:
    """slug, survivor: the smallest slug that any chain of merges (slug, survivor) links a slug to, for every slug that goes.

    Each round takes the smallest survivor around a slug and goes on from there, until nothing changes: chains end at one
    slug, and circles and several merges of one slug do as well.
    """
    links = reduce(DataFrame.unionByName, [m.select("slug", "survivor") for m in merges]).where("slug <> survivor").select(F.greatest("slug", "survivor").alias("slug"), F.least("slug", "survivor").alias("survivor"))
    links = written(links.distinct(), "links")
    before = None
    for _ in range(MOST_ROUNDS):
        # All above a slug, and itself, go to the smallest below or beside it.
        both = links.unionByName(links.select(F.col("survivor").alias("slug"), F.col("slug").alias("survivor")))
        least = both.groupBy("slug").agg(F.min("survivor").alias("m")).select("slug", F.least("m", "slug").alias("m"))
        up = both.where("survivor > slug").join(least, "slug").select(F.col("survivor").alias("slug"), F.col("m").alias("survivor"))
        # All below a slug, and itself, go to the smallest of them.
        low = up.groupBy("slug").agg(F.min("survivor").alias("m"))
        down = up.join(low, "slug").select(F.explode(F.array(F.struct("slug", F.col("m").alias("survivor")), F.struct(F.col("survivor").alias("slug"), F.col("m").alias("survivor")))).alias("e"))
        links = written(down.select("e.slug", "e.survivor").where("slug <> survivor").distinct(), "links")
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("slug", "survivor"))).first()
        if now == before or not now[0]:
            return links
        before = now
    raise RuntimeError(f"merges still change after {MOST_ROUNDS} rounds")
