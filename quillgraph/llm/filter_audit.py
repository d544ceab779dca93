"""Audit of filters that act together: what each of five filters removes, alone and after others, in all 120 orders.

The fifth filter, copies of a text with a smaller doc_id, needs all texts at once. A prepass spares most of them the
shuffle: every task counts its texts in a counting Bloom sketch (a cell counts none, one or more), the sketches
are merged, and a text one of whose cells counts one is guaranteed to be unique. Only the others, the possible repeats, are
shuffled with their full text, once a task and text, for the smallest doc_id of each text.

The flags of a document are one mask; a few counts for each part and mask, which add up over tasks and tables, hold
all that the orders need.

Size: the sketch has ``CELLS_PER_TEXT`` cells for each row, at most ``MOST_CELLS``. It goes to the driver and the executors
as one bit a cell, 64 MB at most. Beyond some 60 million rows it clears fewer texts and more are shuffled; results are the same.

Defined cases: a null text is empty; a null source is the part of the empty string; a null doc_id is neither smaller nor larger than
another, so it neither makes copies fail nor fails; repeated rows count each, and copies of equal doc_id don't fail;
of several labels of a document the larger value of each counts; a document without a label counts as neither good nor
toxic; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import materialise, table

#: Filters by letter; bit k of a mask is the k-th.
LETTERS = "ABCDE"
#: Cells that a text is counted in, cells of the sketch for each row, and cells at most.
HASHES, CELLS_PER_TEXT, MOST_CELLS = 3, 8, 1 << 29
#: Cells of a part of the sketch: parts are merged independently.
PART_CELLS = 1 << 20
#: Cells that a task holds before it puts out its sketch.
HELD_CELLS = 1 << 22


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, "[\\x20\\t-\\r]+"), lambda w: w != "")


def marks(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "source") -> DataFrame:
    """doc_id, part, mask (of the filters A to D that a text fails), and two hashes of the text."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), body.alias("text"))
    words = rows.withColumn("words", words_of(F.col("text")))
    n, different = F.size("words"), F.size(F.array_distinct("words"))
    capitals = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]", ""))
    fails = [n < 50, different * 100 < n * 65, capitals * 100 > F.length("text") * 5, F.col("text").rlike("[#$%&*|]")]
    mask = sum((F.when(bad, 1 << k).otherwise(0) for k, bad in enumerate(fails)), F.lit(0))
    return words.select("doc_id", "part", mask.alias("mask"), *_text_hashes(F.col("text")))


def _text_hashes(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(1)).alias("h2")]


def _cells(h1: pa.Array, h2: pa.Array, n_cells: int) -> Iterator[np.ndarray]:
    """The cells of each text, one array for each of ``HASHES``."""
    a, b = (x.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for x in (h1, h2))
    for k in range(HASHES):
        yield ((a + np.uint64(k) * (b | np.uint64(1))) % np.uint64(n_cells)).astype(np.int64)


def _n_cells(rows: int) -> int:
    return max(1, -(-min(CELLS_PER_TEXT * rows, MOST_CELLS) // PART_CELLS)) * PART_CELLS


def sketch(hashed: DataFrame, n_cells: int) -> DataFrame:
    """part (of the cells) and full: the cells of the part that two texts or more, copies included, are counted in, as bits."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's sketch: for each part the cells that count one, and those that count more."""
        held: list[np.ndarray] = []

        def put() -> Iterator[pa.RecordBatch]:
            cell, times = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.flatnonzero(np.diff(cell // PART_CELLS, prepend=-1))
            for own, n in zip(np.split(cell, cuts[1:]), np.split(times, cuts[1:]), strict=True):
                at = (own % PART_CELLS).astype(np.uint32)
                columns = [pa.array([own[0] // PART_CELLS], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (at[n == 1], at[n > 1])]]
                yield pa.RecordBatch.from_arrays(columns, ["part", "one", "more"])
            held.clear()

        for batch in batches:
            if batch.num_rows:
                held.append(np.concatenate(list(_cells(batch.column(0), batch.column(1), n_cells))))
            if sum(map(len, held)) >= HELD_CELLS:
                yield from put()
        if held:
            yield from put()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds sketches, which come by part; a cell counts to two."""
        part, counts = None, np.zeros(PART_CELLS, np.uint8)
        full = lambda: pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(counts > 1).tobytes()], pa.binary())], ["part", "full"])
        for batch in batches:
            for own, one, more in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if own != part:
                    if part is not None:
                        yield full()
                    part, counts = own, np.zeros(PART_CELLS, np.uint8)
                at = np.frombuffer(one, np.uint32)
                counts[at] = np.minimum(counts[at] + 1, 2)
                counts[np.frombuffer(more, np.uint32)] = 2
        if part is not None:
            yield full()

    counted = hashed.select("h1", "h2").mapInArrow(count, "part int, one binary, more binary")
    return counted.repartition("part").sortWithinPartitions("part").mapInArrow(merge, "part int, full binary")


def copies(docs: DataFrame, marked: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, h1 and h2, once each, of the documents whose text a document of smaller doc_id has. ``marked``: the written marks of docs."""
    n_cells = _n_cells(marked.count())
    full = np.zeros(n_cells // 8, np.uint8)
    for part, bits in sketch(marked, n_cells).collect():  # a bit for each cell, so MOST_CELLS bound it
        full[part * PART_CELLS // 8 :][: PART_CELLS // 8] = np.frombuffer(bits, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(full)

    @F.arrow_udf("boolean")
    def may_repeat(h1: pa.Array, h2: pa.Array) -> pa.Array:
        bits, found = shared.value, np.ones(len(h1), bool)
        for cells in _cells(h1, h2, n_cells):
            found &= (bits[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 1
        return pa.array(found)

    body = F.coalesce(F.col(text), F.lit(""))
    texts = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), body.alias("text"), *_text_hashes(body))
    # A task sends each text once, with its smallest doc_id.
    first = texts.where(may_repeat("h1", "h2")).groupBy("h1", "h2", "text").agg(F.min("doc_id").alias("doc_id")).drop("text")
    repeats = marked.where("doc_id IS NOT NULL").where(may_repeat("h1", "h2")).select("doc_id", "h1", "h2")
    return repeats.join(first, ["doc_id", "h1", "h2"], "left_anti").distinct()


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents that fail just the filters of the mask, and those with labels among them."""
    marked = materialise(marks(docs), "marks")
    failing = copies(docs, marked).withColumn("copy", F.lit(1 << 4))
    labelled = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long")).alias(to) for c, to in (("quality", "good"), ("toxic", "bad"))])
    known = marked.where("doc_id IS NOT NULL").join(failing, ["doc_id", "h1", "h2"], "left").join(labelled, "doc_id", "left")
    unknown = marked.where("doc_id IS NULL").selectExpr("part", "mask", "0 AS copy", "0L AS good", "0L AS bad")
    return (
        known.select("part", "mask", "copy", "good", "bad").unionByName(unknown)
        .groupBy("part", (F.col("mask") + F.coalesce("copy", F.lit(0))).alias("mask"))
        .agg(F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("good", "bad")])
    )


def audit(counts: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step, from the counts of masks."""
    orders = ["".join(order) for order in permutations(LETTERS)]
    bit = "shiftleft(1, instr('{0}', {1}) - 1)"
    steps = (
        counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "bad")).alias("masks"))  # 32 at most
        .select("part", "masks", F.explode(F.array(*map(F.lit, orders))).alias("filter_order"))
        .select("part", "masks", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step"))
        .withColumn("own", F.expr(bit.format(LETTERS, "substr(filter_order, step, 1)")))
        .withColumn("earlier", F.expr(f"aggregate(sequence(1, step), 0, (e, k) -> e + {bit.format(LETTERS, 'substr(filter_order, k, 1)')}) - own"))
    )
    total = "aggregate(filter(masks, m -> {0}), 0L, (a, m) -> a + {1})"
    here = "(m.mask & earlier) = 0 AND (m.mask & own) <> 0"
    sums = {
        "kept": ("(m.mask & (earlier | own)) = 0", "m.n"),
        "removed": (here, "m.n"),
        "redundant": ("(m.mask & earlier) <> 0 AND (m.mask & own) <> 0", "m.n"),
        "unique_fails": ("m.mask = own", "m.n"),
        "good_lost": (here, "m.good"),
        "toxic_lost": (here, "m.bad"),
        # Of the orders of all filters, those in which this one comes first of those that a document fails.
        "shapley": ("(m.mask & own) <> 0", f"m.n * {len(orders)} div bit_count(m.mask)"),
    }
    return steps.select("part", "filter_order", "step", *[F.expr(total.format(*rule)).alias(name) for name, rule in sums.items()])


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(mask_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


OP13_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
worded AS (SELECT *, [w FOR w IN string_split_regex(t, '[\x20\x09-\x0D]+') IF w <> ''] AS ws FROM texts),
failing AS (
  SELECT doc_id, part, (len(ws) < 50)::INT + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT
    + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask
  FROM worded),
labelled AS (SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS bad FROM labels GROUP BY doc_id),
counts AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(bad, 0)) AS bad FROM failing LEFT JOIN labelled USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE b.l <> a.l AND c.l NOT IN (a.l, b.l) AND d.l NOT IN (a.l, b.l, c.l) AND e.l NOT IN (a.l, b.l, c.l, d.l)),
bits AS (SELECT filter_order, step::INT AS step, (1 << (ascii(filter_order[step]) - 65))::INT AS own FROM orders, range(1, 6) r(step)),
steps AS (SELECT *, (sum(own) OVER (PARTITION BY filter_order ORDER BY step) - own)::INT AS earlier FROM bits)
SELECT part, filter_order, step,
  sum(CASE WHEN (mask & (earlier | own)) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN (mask & earlier) = 0 AND (mask & own) <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN (mask & earlier) <> 0 AND (mask & own) <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN (mask & earlier) = 0 AND (mask & own) <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN (mask & earlier) = 0 AND (mask & own) <> 0 THEN bad ELSE 0 END)::BIGINT AS toxic_lost,
  sum(CASE WHEN (mask & own) <> 0 THEN n * 120 // bit_count(mask) ELSE 0 END)::BIGINT AS shapley
FROM counts, steps GROUP BY part, filter_order, step
"""
