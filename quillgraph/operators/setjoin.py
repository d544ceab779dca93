"""Exact joins of similar sets by prefixes: pairs that can't reach the threshold are never formed.

Items are ordered from rare to frequent. Two sets of similarity t or more share an item among the first few of both, as the
rest alone is too short (prefix filter); their sizes differ by a factor of t at most (size filter); and at each shared
item what follows bounds what they can still share (position filter). Frequent items stand last in every set, so at all but low
thresholds they are in no prefix. What is left is counted exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.state import written

#: Against rounding: bounds are lowered by so much, and the exact check decides.
SLACK = 1e-9
#: Below this Jaccard similarity prefixes hold most items of a set, so that all shared items are counted in one join.
LEAST_PREFIX = 0.3
#: Rows that a task of a join makes at most, or about. An item of more is dealt over several keys.
TASK_ROWS = 1 << 23


def _needed(measure: str, threshold: float, total: Column) -> Column:
    """Items that two sets of so many items together have to share."""
    return total * (threshold / 2 if measure == "dice" else threshold / (1 + threshold)) - SLACK


def _jaccard(measure: str, threshold: float) -> float:
    return threshold / (2 - threshold) if measure == "dice" else threshold


def with_positions(members: DataFrame, measure: str, threshold: float) -> DataFrame:
    """set_id, item, n (size), at (position from 1, rare items first) of the sets that have another one of fitting size."""
    j = _jaccard(measure, threshold)
    members = members.where("set_id IS NOT NULL AND item IS NOT NULL").select("set_id", "item").distinct()
    sizes = members.groupBy("set_id").agg(F.count("*").alias("n"))
    # One row a size, of which there are few: a set of a size like no other's isn't sorted at all.
    many = sizes.groupBy("n").agg(F.count("*").alias("_sets"))
    order = Window.orderBy("n")
    fits = (F.col("_sets") > 1) | (F.lag("n").over(order) >= F.col("n") * j - SLACK) | (F.lead("n").over(order) * j - SLACK <= F.col("n"))
    sizes = sizes.join(many.select("n", fits.alias("_fits")).where("_fits").drop("_fits"), "n")
    frequency = members.groupBy("item").agg(F.count("*").alias("_f"))
    rows = members.join(sizes, "set_id").join(frequency, "item")
    return rows.select("set_id", "item", "n", F.row_number().over(Window.partitionBy("set_id").orderBy("_f", "item")).alias("at"))


def candidates(placed: DataFrame, measure: str, threshold: float, new: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of the join of prefixes (a, b, ...), and the pairs of sets that they leave; a is the smaller set, or equal and first."""
    j = _jaccard(measure, threshold)
    short = placed.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * (2 * j / (1 + j)) - SLACK) + 1)
    long = placed.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * j - SLACK) + 1)
    side = lambda rows, c: rows.select("item", *[F.col(x).alias(f"{c}{x}") for x in ("set_id", "n", "at")])
    a, b = side(short, "a"), side(long, "b")

    def joined(a: DataFrame, b: DataFrame) -> DataFrame:
        needed = _needed(measure, threshold, F.col("an") + F.col("bn"))
        first = (F.col("an") < F.col("bn")) | (F.col("an") == F.col("bn")) & (F.col("aset_id") < F.col("bset_id"))
        reach = F.least("aat", "bat") + F.least(F.col("an") - F.col("aat"), F.col("bn") - F.col("bat"))
        return a.join(b, "item").where(first & (F.col("an") >= F.col("bn") * j - SLACK) & (reach >= needed))

    if new is None:
        rows = joined(a, b)
    else:
        # Pairs in which one set is new: new ones against all, and old ones against new.
        ids = new.select(F.col("set_id").alias("_id")).distinct()
        mine = lambda rows, c, how: rows.join(ids, F.col(f"{c}set_id") == F.col("_id"), how)
        rows = joined(mine(a, "a", "left_semi"), b).unionByName(joined(mine(a, "a", "left_anti"), mine(b, "b", "left_semi")))
    pairs = rows.groupBy("aset_id", "bset_id").agg(F.first("an").alias("an"), F.first("bn").alias("bn"), F.count("*").alias("_c"), F.max("aat").alias("_i"), F.max("bat").alias("_j"))
    pairs = pairs.where(F.col("_c") + F.least(F.col("an") - F.col("_i"), F.col("bn") - F.col("_j")) >= _needed(measure, threshold, F.col("an") + F.col("bn")))
    return rows, pairs.select("aset_id", "bset_id", "an", "bn")


def met_on(a: DataFrame, b: DataFrame, key: str, rows: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """The equi join of a and b on a key, dealt by the rows that it makes, not by those that it reads: a task makes
    about ``task_rows``, and so the partial sums that follow fit into a fixed memory whatever the input.

    rows: key, d: the rows of a key on either side. A key of many rows is dealt by hash over several.
    """
    made = F.col("d").cast("double") * F.col("d")
    total = rows.agg(F.coalesce(F.sum(made), F.lit(0.0))).first()[0]
    parts = max(a.sparkSession.sparkContext.defaultParallelism, -(-int(total) // task_rows))
    heavy = rows.where(made > task_rows).select(key, F.ceil(made / task_rows).cast("int").alias("_parts"))
    if not heavy.isEmpty():
        a, b = (x.join(heavy, key, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1))) for x in (a, b))
        a = a.withColumn("_part", F.pmod(F.xxhash64(*a.columns), "_parts").cast("int")).drop("_parts")
        b = b.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
        on = [key, "_part"]
    else:
        on = [key]
    return a.repartition(parts, *on).join(b.repartition(parts, *on).hint("shuffle_hash"), on).drop("_part")


def _counted(members: DataFrame, measure: str, threshold: float, new: DataFrame | None) -> DataFrame:
    """Shared items of all pairs of sets of fitting sizes, counted at once."""
    j = _jaccard(measure, threshold)
    members = written(members.where("set_id IS NOT NULL AND item IS NOT NULL").select("set_id", "item").distinct(), "members")
    rows = members.join(members.groupBy("set_id").agg(F.count("*").alias("n")), "set_id")
    often = members.groupBy("item").agg(F.count("*").alias("d"))
    side = lambda c: rows.select("item", F.col("set_id").alias(f"{c}set_id"), F.col("n").alias(f"{c}n"))

    def pairs(a: DataFrame, b: DataFrame) -> DataFrame:
        first = (F.col("an") < F.col("bn")) | (F.col("an") == F.col("bn")) & (F.col("aset_id") < F.col("bset_id"))
        return met_on(a, b, "item", often).where(first & (F.col("an") >= F.col("bn") * j - SLACK))

    if new is None:
        met = pairs(side("a"), side("b"))
    else:
        ids = new.select(F.col("set_id").alias("_id")).distinct()
        mine = lambda c, how: side(c).join(ids, F.col(f"{c}set_id") == F.col("_id"), how)
        met = pairs(mine("a", "left_semi"), side("b")).unionByName(pairs(mine("a", "left_anti"), mine("b", "left_semi")))
    return met.groupBy("aset_id", "bset_id", "an", "bn").agg(F.count("*").alias("shared"))


def similar_sets(members: DataFrame, measure: str = "dice", threshold: float = 0.1, new: DataFrame | None = None) -> DataFrame:
    """src, dst (src < dst), shared, dice, jaccard of the pairs of sets (set_id, item) whose measure reaches the threshold.

    The threshold is above 0: sets that share nothing are no pair. Null ids and items are left out, repeated rows count once.
    ``new``: set_id; only pairs with one of these sets, for sets that are added to others.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is above 0 and at most 1")
    if _jaccard(measure, threshold) < LEAST_PREFIX:
        shared = _counted(members, measure, threshold, new)
    else:
        placed = with_positions(members, measure, threshold)
        _, pairs = candidates(placed, measure, threshold, new)
        own = lambda c: placed.select(F.col("set_id").alias(f"{c}set_id"), "item")
        shared = pairs.join(own("a"), "aset_id").join(own("b"), ["bset_id", "item"]).groupBy("aset_id", "bset_id", "an", "bn").agg(F.count("*").alias("shared"))
    total = F.col("an") + F.col("bn")
    scored = shared.withColumns({"dice": 2.0 * F.col("shared") / total, "jaccard": F.col("shared") / (total - F.col("shared"))})
    return scored.where(F.col(measure) >= threshold).select(F.least("aset_id", "bset_id").alias("src"), F.greatest("aset_id", "bset_id").alias("dst"), "shared", "dice", "jaccard")
