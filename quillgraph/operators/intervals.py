"""Join of overlapping date intervals as an equi join.

An interval of 2^k days or less lies in two bins of level k at most, and in two at most of each level above. Two
intervals that overlap share a bin on the level of the longer one, so each side is written out on its own level and those
above, and they meet on (level, bin) where the level is that of the longer one. Of two shared bins the first counts. Rows per
interval are bounded by the levels, however long it is; there is no comparison of all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import temporal as TT

#: Open ends reach to these days.
EARLIEST, LATEST = "1000-01-01", "3000-01-01"
#: 2^20 days are more than lie between them.
TOP_LEVEL = 20
#: Days of a block, over which running sums go first; then over the blocks, of which there are some 700 at most.
BLOCK_DAYS = 1 << 10
#: Parts of a share in which sums are whole numbers: they are exact, so that what lies before a day can be taken off again.
UNIT = 10**18


def _binned(rows: DataFrame, start: str, end: str, side: str) -> DataFrame:
    """All columns as a struct, with level, bin, the level of its own, and its first bin on the level."""
    a, b = (F.unix_date(F.greatest(F.least(F.col(c), F.to_date(F.lit(LATEST))), F.to_date(F.lit(EARLIEST)))) - F.unix_date(F.to_date(F.lit(EARLIEST))) for c in (start, end))
    rows = rows.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end)))
    rows = rows.select(F.struct(*rows.columns).alias(side), a.alias("_a"), b.alias("_b"))
    own = F.ceil(F.log2(F.col("_b") - F.col("_a") + 1)).cast("int")
    rows = rows.withColumn(f"_{side}_level", own)
    rows = rows.withColumn("level", F.explode(F.sequence(F.col(f"_{side}_level"), F.lit(TOP_LEVEL))))
    bin_of = lambda c: F.expr(f"shiftright({c}, level)")
    rows = rows.withColumns({f"_{side}_first": bin_of("_a"), "_last": bin_of("_b")})
    return rows.withColumn("bin", F.explode(F.sequence(F.col(f"_{side}_first"), F.col("_last")))).drop("_a", "_b", "_last")


def overlap_join(left: DataFrame, right: DataFrame, left_dates: tuple[str, str], right_dates: tuple[str, str]) -> DataFrame:
    """left, right (structs of all columns): pairs of rows whose intervals of dates, ends included, overlap; each pair once.

    Rows with a missing date, or an end before the start, are in no pair. Days outside the years 1000 to 3000 count as the nearest in them.
    """
    a, b = _binned(left, *left_dates, "left"), _binned(right, *right_dates, "right")
    met = a.join(b, ["level", "bin"]).where((F.col("level") == F.greatest("_left_level", "_right_level")) & (F.col("bin") == F.greatest("_left_first", "_right_first")))
    overlap = (F.col(f"left.{left_dates[0]}") <= F.col(f"right.{right_dates[1]}")) & (F.col(f"right.{right_dates[0]}") <= F.col(f"left.{left_dates[1]}"))
    return met.where(overlap).select("left", "right")


def _known_ends(documents: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and windows with any date, with both ends (_from, _to)."""
    low, high = F.to_date(F.lit(EARLIEST)), F.to_date(F.lit(LATEST))
    known = lambda *columns: F.coalesce(*columns).isNotNull()
    ends = lambda a, b: (F.coalesce(a, low).alias("_from"), F.coalesce(b, high).alias("_to"))
    docs = documents.where(known("coverage_start", "coverage_end", "published"))
    docs = docs.select("document_id", "published", "coverage_start", "coverage_end", *ends(F.coalesce("coverage_start", "published"), F.coalesce("coverage_end", "published")))
    asked = windows.where(known("date_from", "date_to")).select("window_id", "date_from", "date_to", *ends(F.col("date_from"), F.col("date_to")))
    return docs, asked


def covered_windows(documents: DataFrame, windows: DataFrame) -> DataFrame:
    """document_id, window_id, covered of the documents that cover part of a window, by the rule of ``temporal.coverage``.

    documents: document_id, published, coverage_start, coverage_end; windows: window_id, date_from, date_to; dates may be
    missing. An end that a document doesn't state is its publication; without any it is open.
    """
    docs, asked = _known_ends(documents, windows)
    pairs = overlap_join(docs, asked, ("_from", "_to"), ("_from", "_to"))
    share: Column = TT.coverage(*[F.col(c) for c in ("left.coverage_start", "left.coverage_end", "left.published", "right.date_from", "right.date_to")])
    return pairs.select("left.document_id", "right.window_id", share.alias("covered"))


def _running(days: DataFrame, sums: list[str]) -> DataFrame:
    """day, and the sums of each column over all days up to it. days: a row a day."""
    days = days.withColumn("_block", F.floor(F.col("day") / BLOCK_DAYS))
    within = Window.partitionBy("_block").orderBy("day")
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = days.groupBy("_block").agg(*[F.sum(c).alias(c) for c in sums])
    blocks = blocks.select("_block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in sums])
    rows = days.select("day", "_block", *[F.sum(c).over(within).alias(c) for c in sums]).join(F.broadcast(blocks), "_block")
    return rows.select("day", *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in sums])


def coverage_totals(documents: DataFrame, windows: DataFrame) -> DataFrame:
    """document_id, n, covered: how many windows each document covers part of, and the sum of their shares: ``covered_windows``
    summed, without its pairs.

    A window's share grows by 1 / length with each of its days. So a document's total is what all windows reach by its last
    day less what they reach by its first, and its windows are those that begin by its last day less those that end before its first: a
    running sum over days, of which there are as many as dates, whatever the rows.
    """
    docs, asked = _known_ends(documents, windows)
    docs = docs.where("_from <= _to").select("document_id", F.unix_date("_from").alias("_a"), F.unix_date("_to").alias("_b"))
    asked = asked.where("_from <= _to").select(F.unix_date("_from").alias("f"), F.unix_date("_to").alias("t"))
    asked = asked.groupBy("f", "t").agg(F.count("*").alias("_n"))
    whole = lambda x, digits=19: x.cast(f"decimal({digits},0)")
    each = whole(F.round(whole(F.lit(UNIT)) / whole(F.nullif(F.col("t") - F.col("f"), F.lit(0)), 8)))
    asked = asked.withColumn("_rate", (F.coalesce(each, whole(F.lit(0))) * whole(F.col("_n"), 11)).cast("decimal(30,0)"))
    # At day x all windows reach x * slope + level; begun and ended count the windows that begin by then, and that end before.
    zero, none = F.lit(0).cast("decimal(38,0)"), F.lit(0).cast("long")
    at = lambda day, sign, begun, ended: F.struct(day.alias("day"), (F.lit(sign) * F.col("_rate")).cast("decimal(38,0)").alias("slope"), (F.lit(-sign) * F.col("_rate") * whole(day, 8)).cast("decimal(38,0)").alias("level"), begun.alias("begun"), ended.alias("ended"))
    past = F.struct((F.col("t") + 1).alias("day"), zero.alias("slope"), zero.alias("level"), none.alias("begun"), F.col("_n").alias("ended"))
    steps = asked.select(F.explode(F.array(at(F.col("f"), 1, F.col("_n"), none), at(F.col("t"), -1, none, none), past)).alias("x")).select("x.*")
    asked_for = docs.select(F.explode(F.array("_a", "_b")).alias("day")).distinct().select("day", zero.alias("slope"), zero.alias("level"), none.alias("begun"), none.alias("ended"))
    sums = ["slope", "level", "begun", "ended"]
    days = steps.unionByName(asked_for).groupBy("day").agg(*[F.sum(c).cast("long" if c in ("begun", "ended") else "decimal(38,0)").alias(c) for c in sums])
    days = _running(days, sums).select("day", "begun", "ended", (F.col("slope") * whole(F.col("day"), 8) + F.col("level")).cast("decimal(38,0)").alias("reached"))
    on = lambda c: days.select(F.col("day").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in ("begun", "ended", "reached")])
    rows = docs.join(on("_a"), "_a").join(on("_b"), "_b")
    rows = rows.groupBy("document_id").agg(F.sum(F.col("_b_begun") - F.col("_a_ended")).alias("n"), F.sum((F.col("_b_reached") - F.col("_a_reached")).cast("decimal(38,0)")).alias("covered"))
    return rows.where("n > 0").select("document_id", "n", (F.col("covered").cast("double") / UNIT).alias("covered"))
