"""Approximate nearest neighbours by adaptive dimension scan (after ADSampling, Gao & Long, 2023).

Nearness is the inner product. With one more dimension that lifts every vector to the same length (the greatest in
the table), order by inner product is order by distance, so lists, rotation and tests work on distances.

1. Fit on about ``SAMPLE`` vectors: centres of the lists (k-means), and the number of lists to probe, the fewest that
   take in ``TARGET`` of the true neighbours of sampled queries. The rotation is a fixed random one.
2. Every vector is assigned to its nearest list, rotated. A list is dealt into blocks of about ``BLOCK`` vectors by a
   hash of the id, so a list of any size, copies of one vector too, is many groups.
3. A query probes its nearest lists. In each block the columns are scanned ``STEP`` at a time: a candidate is
   abandoned once its partial distance, scaled up by the share of columns seen, passes the best ``k``-th distance by
   the factor (1 + EPSILON / sqrt(d))^2 - the hypothesis test that its whole distance is smaller fails.
   Survivors are scored exactly, in double precision, on the original vectors, and the block's best come out.
4. A query's best over its blocks, ties to the smaller id, are its result.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part; rows of one id are candidates each, and the id is named once, with its best row (a query is never its own candidate,
by id); query rows of one id are one query, with the least of their vectors; a query probes on until its lists hold 2 k vectors, so small tables are searched whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import materialise, table

#: Vectors that the lists are fitted on, at most.
SAMPLE = 20_000
BLOCK = 4096
STEP = 16
EPSILON = 2.1
#: Share of the true neighbours of sampled queries, within the sample, whose lists the probes must take in.
TARGET = 0.97
#: Sampled queries that the number of probes is set by.
TRIALS = 400
MOST_LISTS = 4096


def usable(embedding: Column, dimensions: int) -> Column:
    """Whether a vector takes part."""
    whole = ~F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(embedding) == dimensions) & whole & F.exists(embedding, lambda x: x != 0), F.lit(False))


def rotation(dimensions: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(7).normal(size=(dimensions, dimensions)))
    return q * np.sign(np.diag(r))


class Index:
    """Rotation, greatest length, and the centres of the lists."""

    def __init__(self, dimensions: int, longest: float, centres: np.ndarray, probes: int):
        self.dimensions, self.longest, self.centres, self.probes = dimensions, longest, centres, probes
        self.turn = rotation(dimensions + 1)

    def lift(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Rotated vectors of one more dimension; queries are scaled to the greatest length with a 0 there."""
        length = np.sqrt((x * x).sum(axis=1))
        if query:
            more = np.zeros(len(x))
            x = x * (self.longest / np.maximum(length, 1e-300))[:, None]
        else:
            more = np.sqrt(np.maximum(self.longest**2 - length**2, 0))
        return np.hstack([x, more[:, None]]) @ self.turn

    def distances(self, x: np.ndarray) -> np.ndarray:
        return (x * x).sum(axis=1)[:, None] - 2 * x @ self.centres.T + (self.centres**2).sum(axis=1)[None, :]


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    random = np.random.default_rng(11)
    x = x[np.lexsort(x.T[::-1])]
    distinct = np.unique(x, axis=0)
    centres = distinct[random.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(rounds):
        near = ((centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def build_index(vectors: DataFrame, dimensions: int, k: int) -> Index | None:
    """Fits on a bounded sample: rows whose hashed id falls below the rate that gives ``SAMPLE`` of them."""
    length = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    n, longest = vectors.agg(F.count("*"), F.max(F.sqrt(length))).first()
    if not n:
        return None
    draw = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = vectors.where(draw < min(1.0, SAMPLE / n)).select("embedding").limit(2 * SAMPLE).collect()
    if not rows:
        rows = vectors.select("embedding").limit(SAMPLE).collect()
    # The sample follows the table's square root with its lists, so a list stays at about that many vectors.
    lists = max(1, min(MOST_LISTS, round(math.sqrt(n) / 2), len(rows)))
    index = Index(dimensions, float(longest) * (1 + 1e-12), np.zeros((0, dimensions + 1)), 0)
    sample = np.array([r[0] for r in rows], np.float64)
    lifted = index.lift(sample)
    index.centres = _kmeans(lifted, lists)
    index.probes = _probes(index, sample, lifted, k)
    return index


def _probes(index: Index, sample: np.ndarray, lifted: np.ndarray, k: int) -> int:
    """Fewest probes with which ``TARGET`` of the sampled queries' true neighbours are in probed lists."""
    asked = sample[:: max(1, len(sample) // TRIALS)][:TRIALS]
    order = np.argsort(index.distances(index.lift(asked, query=True)), axis=1, kind="stable")
    place = np.argsort(order, axis=1)  # place[q, l]: turn of list l for query q
    own = index.distances(lifted).argmin(axis=1)
    scores = asked @ sample.T
    scores[np.arange(len(asked)), np.arange(0, len(sample), max(1, len(sample) // TRIALS))[: len(asked)]] = -np.inf
    near = np.argsort(-scores, axis=1)[:, : min(k, len(sample) - 1)]
    turns = np.take_along_axis(place, own[near], axis=1).ravel()
    return int(np.quantile(turns, TARGET)) + 1 if len(turns) else len(index.centres)


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dimensions)


def adaptive_scan(query: np.ndarray, base: np.ndarray, k: int) -> np.ndarray:
    """Rows of ``base`` that survive the tests for one query; both lifted and rotated, base in blocks of columns."""
    d = base.shape[1]
    first = min(len(base), 2 * k + 8)
    reach = ((base[:first] - query) ** 2).sum(axis=1)
    best = np.partition(reach, min(k, first) - 1)[: min(k, first)].max() if first >= k else np.inf
    alive = np.arange(first, len(base))
    part = np.zeros(len(alive))
    for start in range(0, d, STEP):
        end = min(start + STEP, d)
        part += ((base[alive, start:end] - query[start:end]) ** 2).sum(axis=1)
        if end < d:
            keep = part * (d / end) <= best * (1 + EPSILON / math.sqrt(end)) ** 2
            alive, part = alive[keep], part[keep]
    if len(alive) > k:
        # All that is left has a whole distance: the k nearest and their ties.
        alive = alive[part <= max(np.partition(part, k - 1)[k - 1], 0) * (1 + 1e-9) + 1e-12]
    return np.concatenate([np.arange(first), alive])


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, dimensions: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest among all other vectors (columns vec_id, embedding)."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    pick = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL")
    vectors, queries = pick(vectors), pick(queries)
    if dimensions is None:
        sizes = vectors.where("size(embedding) > 0").groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"))
        found = sizes.orderBy(F.desc("n"), "d").first()
        if found is None:
            return empty
        dimensions = found["d"]
    vectors, queries = (df.where(usable(F.col("embedding"), dimensions)) for df in (vectors, queries))
    queries = queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    index = build_index(vectors, dimensions, k)
    if index is None:
        return empty
    held = spark.sparkContext.broadcast(index)  # at most MOST_LISTS centres

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = held.value.distances(held.value.lift(_matrix(batch.column(1), dimensions))).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32())], ["vec_id", "embedding", "list"])

    base = materialise(vectors.mapInArrow(assign, "vec_id long, embedding array<double>, list int"), "lists")
    # Blocks of each list: its size is one row a list.
    counts = base.groupBy("list").agg(F.count("*").alias("n"))
    blocks = counts.select("list", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias("blocks"))
    sizes = np.zeros(len(index.centres), np.int64)
    for r in counts.collect():  # one row a list
        sizes[r["list"]] = r["n"]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                away = held.value.distances(held.value.lift(_matrix(batch.column(1), dimensions), query=True))
                order = np.argsort(away, axis=1, kind="stable").astype(np.int32)
                enough = (np.cumsum(sizes[order], axis=1) <= 2 * k).sum(axis=1) + 1
                lists = pa.array([o[: max(n, held.value.probes)].tolist() for o, n in zip(order, enough.tolist(), strict=True)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], ["vec_id", "embedding", "lists"])

    base = base.join(F.broadcast(blocks), "list")
    base = base.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    asked = queries.mapInArrow(probe, "vec_id long, embedding array<double>, lists array<int>")
    asked = asked.withColumn("list", F.explode("lists")).join(F.broadcast(blocks), "list")
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        own = held.value
        out: list[tuple[int, int, float]] = []
        if left.num_rows and right.num_rows:
            order = np.argsort(left.column("vec_id").to_numpy(), kind="stable")
            ids = left.column("vec_id").to_numpy()[order]
            # Rows of the query's own id, and further rows of other ids, may stand before the k-th id.
            own_rows = 1 + len(ids) - len(np.unique(ids))
            vecs = _matrix(left.column("embedding").combine_chunks(), dimensions)[order]
            lifted = own.lift(vecs)
            asked_ids = right.column("vec_id").to_numpy()
            raw = _matrix(right.column("embedding").combine_chunks(), dimensions)
            turned = own.lift(raw, query=True)
            for q in range(len(asked_ids)):
                rows = adaptive_scan(turned[q], lifted, k + own_rows)
                rows = rows[ids[rows] != asked_ids[q]]
                scores = (vecs[rows] * raw[q]).sum(axis=1)
                best = np.lexsort((ids[rows], -scores))
                best = best[np.sort(np.unique(ids[rows][best], return_index=True)[1])][:k]  # the best row of each id
                out += [(int(asked_ids[q]), int(ids[rows[x]]), float(scores[x])) for x in best]
        kinds = [pa.int64(), pa.int64(), pa.float64()]
        return pa.table([pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)], names=["query_id", "vec_id", "score"])

    # Rows of one id may lie in several lists.
    repeated = base.count() > base.select("vec_id").distinct().count()
    pieces = base.select("list", "block", "vec_id", "embedding").groupBy("list", "block")
    found = pieces.cogroup(asked.select("list", "block", "vec_id", "embedding").groupBy("list", "block")).applyInArrow(scan, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")) if repeated else found
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_adaptive_scan(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 20 = 0"), k=20)
