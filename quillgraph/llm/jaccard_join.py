"""N-gram Jaccard join with Bayesian candidate pruning (after BayesLSH, Satuluri & Parthasarathy, 2012).

Every pair of different texts whose sets of word shingles (five words) have a Jaccard similarity of at least 0.8 is
linked. Steps, each a Spark job over rows that any executor can take:

1. Equal texts become one row with its number of copies. MinHash values of every whole text; bands of them are bucket
   keys. Two linked texts miss all ``BANDS`` buckets with probability below (1 - 0.8 ** ROWS) ** BANDS < 5e-5. A bucket
   is reduced to its smallest text, to which its others are tied: one row a text and band, no pairs.
2. Connected components of those ties are the sets in which links can lie. Texts are compared within a component, or
   within the buckets of a component where that is fewer pairs (loose chains of buckets); a pair that shares several
   buckets counts in the first of them only.
3. Pairs compare their MinHash values ``STEP`` at a time. A pair is dropped as soon as the posterior probability (uniform
   prior) that its similarity reaches the threshold is below ``TOLERANCE``; the rest is verified on the whole shingle
   sets. A group returns counts a text and a spanning forest, never pairs.
4. Components of the verified links are the classes.

A component or bucket of more than ``BLOCK`` texts is split into blocks by hash, and every pair of blocks is a group of
its own, so no group grows with the data. Texts with over a ``HOT`` part of all documents are few, and their result is
sent to the documents; the others meet theirs by a shuffle.

Defined cases: a null text is in a class of its own; equal texts, empty ones too, share a class without counting as
links; a text without a word has no links; a text of fewer than five words is one shingle; a text that only rows
without a doc_id have takes no part in links, and rows with a null doc_id come with the class of their text; repeated rows
are copies; an empty table gives an empty result; further columns are ignored. ``first_of_class`` states its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import materialise, small_batches, table
from quillgraph.llm.components import connected_components
from quillgraph.llm.shingles import shingle_set

THRESHOLD = 0.8
WIDTH = 5
BANDS, ROWS = 25, 5
HASHES = 128
STEP = 32
TOLERANCE = 1e-6
#: Texts in a block; two blocks at most meet in one group.
BLOCK = 512
#: Texts of small components that share a group.
PACK = 1500
#: A text is hot if it has more than one document in so many; at most so many texts can be.
HOT = 1000

_RANDOM = np.random.default_rng(20240229)
_A = (_RANDOM.integers(0, 1 << 31, HASHES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _RANDOM.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def min_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """A row of MinHash values for each non-empty set."""
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    low = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), HASHES), np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(low * _A[k] + _B[k], starts)
    return out


def fewest_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """Fewest matches of n MinHash values with which P(similarity >= threshold) reaches the tolerance.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), and its tail is P(Binomial(n + 1, threshold) <= m).
    """
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, mark, node (a text's digest) and the keys of its buckets; null for a text without a word."""
    for batch in batches:
        texts = batch.column(2).to_pylist()
        nodes = pa.array([None if t is None else hashlib.md5(t.encode("utf-8", "surrogatepass")).digest() for t in texts], pa.binary())
        sets = [_as_set(t) for t in texts]
        keys: list[list[int] | None] = [None] * len(texts)
        found = [k for k, x in enumerate(sets) if len(x)]
        if found:
            values = min_hashes([sets[k] for k in found])[:, : BANDS * ROWS].reshape(len(found), BANDS, ROWS).astype(np.uint64)
            rolled = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(found), 1))
            for r in range(ROWS):
                rolled = (rolled ^ values[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
                rolled ^= rolled >> np.uint64(31)
            for k, row in zip(found, rolled.view(np.int64).tolist(), strict=True):
                keys[k] = row
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), nodes, pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "mark", "node", "keys"])


def _as_set(text: str | None) -> np.ndarray:
    return shingle_set(text, WIDTH)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingle sets and MinHash values of texts that may have links."""
    for batch in batches:
        sets = [_as_set(t) for t in batch.column(1).to_pylist()]
        values = min_hashes([s if len(s) else np.zeros(1, np.uint64) for s in sets]) if sets else []
        packed = [pa.array([x.tobytes() for x in column], pa.binary()) for column in (sets, values)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *packed], ["node", "shingles", "hashes"])


def linked_pairs(
    hashes: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, before: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Of all pairs of a left and a later right member, those linked; indices into the arrays.

    ``before`` has the keys of the bands before a bucket's own: pairs that share one of these are left to that bucket.
    """
    i, j = (x.ravel() for x in np.meshgrid(left, right, indexing="ij"))
    keep = i < j if left is right else np.ones(len(i), bool)
    i, j = i[keep], j[keep]
    for column in () if before is None else before.T:
        keep = column[i] != column[j]
        i, j = i[keep], j[keep]
    sizes = np.array([len(s) for s in sets])
    # Sets of too different sizes can't reach the threshold.
    keep = np.minimum(sizes[i], sizes[j]) >= THRESHOLD * np.maximum(sizes[i], sizes[j]) - 1e-9
    i, j = i[keep], j[keep]
    matches = np.zeros(len(i), np.int32)
    for start in range(0, HASHES, STEP):
        for a in range(0, len(i), 1 << 17):
            b = slice(a, a + (1 << 17))
            matches[b] += (hashes[i[b], start : start + STEP] == hashes[j[b], start : start + STEP]).sum(axis=1, dtype=np.int32)
        keep = matches >= fewest_matches(start + STEP)
        i, j, matches = i[keep], j[keep], matches[keep]
    shared = _shared(sets, i, j)
    keep = shared >= THRESHOLD * (sizes[i] + sizes[j] - shared) - 1e-9
    return i[keep], j[keep]


def _shared(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sets, exactly."""
    if len(i) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    used = np.unique(np.concatenate([i, j]))
    place = np.full(len(sets), -1)
    place[used] = np.arange(len(used))
    flat = np.concatenate([sets[k] for k in used])
    owner = np.repeat(np.arange(len(used)), [len(sets[k]) for k in used])
    _, slot = np.unique(flat, return_inverse=True)
    order = np.argsort(slot, kind="stable")
    owner, slot = owner[order], slot[order]
    product = np.zeros((len(used), len(used)), np.float32)
    width = 4096
    for start in range(0, int(slot[-1]) + 1, width):
        a, b = np.searchsorted(slot, (start, start + width))
        dense = np.zeros((len(used), width), np.float32)
        dense[owner[a:b], slot[a:b] - start] = 1
        product += dense @ dense.T
    return product[place[i], place[j]].astype(np.int64)


def _forest(i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Member and root of every member that has a link."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, find(x)) for x in list(parent)]


def _links(cell: pa.Table) -> pa.Table:
    """Links within one group: a row of counts and one of the forest for each linked text."""
    data = cell.select(["unit", "band", "row", "col", "block", "node", "copies", "keys"]).to_pydict()
    hashes = np.array([np.frombuffer(h, np.uint32) for h in cell.column("hashes").to_pylist()]).reshape(-1, HASHES)
    sets = [np.frombuffer(s, np.uint64) for s in cell.column("shingles").to_pylist()]
    copies = np.array(data["copies"], np.int64)
    by: dict[tuple, dict[bytes, int]] = {}
    for k, key in enumerate(zip(data["unit"], data["band"], data["row"], data["col"], strict=True)):
        by.setdefault(key, {}).setdefault(data["node"][k], k)
    nodes: list[bytes] = []
    others: list[bytes | None] = []
    links: list[int] = []
    docs: list[int] = []
    for (_, band, row, col), members in by.items():
        index = np.array([k for _, k in sorted(members.items())])
        block = np.array([data["block"][k] for k in index])
        left, right = np.flatnonzero(block == row), np.flatnonzero(block == col)
        if row == col:
            right = left
        before = np.array([data["keys"][k][:band] for k in index], np.int64).reshape(len(index), band) if band > 0 else None
        i, j = linked_pairs(hashes[index], [sets[k] for k in index], left, right, before)
        n, c = np.zeros(len(index), np.int64), np.zeros(len(index), np.int64)
        for a, b in ((i, j), (j, i)):
            np.add.at(n, a, 1)
            np.add.at(c, a, copies[index[b]])
        for k in np.flatnonzero(n):
            nodes.append(data["node"][index[k]])
            others.append(None)
            links.append(int(n[k]))
            docs.append(int(c[k]))
        for x, root in _forest(i, j):
            nodes.append(data["node"][index[x]])
            others.append(data["node"][index[root]])
            links.append(0)
            docs.append(0)
    return pa.table({"node": pa.array(nodes, pa.binary()), "other": pa.array(others, pa.binary()), "links": pa.array(links, pa.int64()), "docs": pa.array(docs, pa.int64())})


def _groups(texts: DataFrame, unit: Column, band: Column, size: Column, pack: int) -> DataFrame:
    """A row for each group that a text meets others in: all pairs of blocks of its unit; small units share groups."""
    blocks = F.ceil(size / F.lit(BLOCK)).cast("int")
    texts = texts.withColumns({"unit": unit, "band": band, "blocks": blocks}).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    met = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("block", k).alias("row"), F.greatest("block", k).alias("col")))
    cell = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("unit"), F.lit(pack))).otherwise(F.xxhash64("unit", "band", "row", "col"))
    texts = texts.withColumn("met", F.explode(met)).select("node", "copies", "keys", "unit", "band", "blocks", "block", "met.row", "met.col")
    return texts.withColumn("cell", cell).drop("blocks")


def _candidates(texts: DataFrame) -> DataFrame:
    """The groups of texts that may be linked; ``texts`` has node, id, copies and keys."""
    bands = texts.select("id", F.explode("keys").alias("key"))
    buckets = bands.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    ties = bands.join(buckets.select("key", "first"), "key").where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    parts = connected_components(ties).withColumnRenamed("node", "id")
    texts = texts.select("node", "id", "copies", "first", "keys").join(parts, "id")
    sizes = materialise(texts.groupBy("component").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    total, largest = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    texts = texts.join(sizes, "component")
    pack = max(1, -(-total // PACK))
    none = F.lit(None).cast("array<long>")
    if largest <= BLOCK:
        return _groups(texts.withColumn("keys", none), F.col("component"), F.lit(-1), F.col("size"), pack)
    # Loose components have fewer pairs in their buckets than as a whole.
    texts = materialise(texts, "texts")
    large = texts.where(F.col("size") > BLOCK).select("component", "node", "copies", "keys", F.posexplode("keys").alias("band", "key"))
    buckets = materialise(large.groupBy("component", "band", "key").agg(F.count("*").alias("met")).where("met > 1"), "buckets")
    cost = buckets.groupBy("component").agg(F.sum(F.col("met").cast("double") * F.col("met")).alias("cost"))
    loose = sizes.join(cost, "component").where(F.col("cost") < F.col("size").cast("double") * F.col("size")).select("component")
    tight = _groups(texts.join(loose, "component", "left_anti").withColumn("keys", none), F.col("component"), F.lit(-1), F.col("size"), pack)
    split = large.join(buckets.join(loose, "component", "left_semi"), ["component", "band", "key"])
    return tight.unionByName(_groups(split, F.col("key"), F.col("band"), F.col("met"), pack))


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, mark and node of every row; and of each text: class, class_id, best (least doc_id and mark), copies, links."""
    spark = docs.sparkSession
    small_batches(spark)
    # Digests and bucket keys are read several times and so kept.
    known = materialise(docs.mapInArrow(_bands, "doc_id long, mark long, node binary, keys array<long>"), "known")
    texts = known.where(F.col("node").isNotNull()).groupBy("node").agg(
        F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "mark")).alias("best"), F.count("*").alias("copies"), F.first("keys").alias("keys")
    )
    texts = materialise(texts.withColumn("id", F.xxhash64("node")), "nodes")  # an id met twice only brings two sets together
    assigned = materialise(_candidates(texts.where(F.col("first").isNotNull() & F.col("keys").isNotNull())), "assigned")
    wanted = assigned.select("node").distinct().join(texts.select("node", "first"), "node")
    members = docs.select("doc_id", "text").join(wanted, F.col("doc_id") == F.col("first")).where(F.unhex(F.md5("text")) == F.col("node"))
    members = members.dropDuplicates(["node"]).select("node", "text").mapInArrow(_members, "node binary, shingles binary, hashes binary")
    found = assigned.join(members, "node").groupBy("cell").applyInArrow(_links, "node binary, other binary, links long, docs long")
    found = materialise(found, "links")
    counts = found.where(F.col("other").isNull()).groupBy("node").agg(F.sum("links").alias("n_links"), F.sum("docs").alias("n_linked_docs"))
    classes = connected_components(found.where(F.col("other").isNotNull()).select(F.col("node").alias("a"), F.col("other").alias("b")))
    linked = classes.join(counts, "node").join(texts.select("node", "first", "best"), "node")
    first = linked.groupBy("component").agg(F.min("first").alias("class_id"))
    linked = linked.join(first, "component").select("node", "class_id", F.col("component").alias("class"), "n_links", "n_linked_docs")
    texts = texts.select("node", "first", "best", "copies").join(linked, "node", "left").select(
        "node", F.coalesce("class", "node").alias("class"), F.coalesce("class_id", "first").alias("class_id"), "best", F.col("copies").alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_linked_docs", F.lit(0)).alias("n_linked_docs"),
    )
    return known.select("doc_id", "mark", "node"), texts


def jaccard_classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), n_copies, n_links, n_linked_docs of every document.

    n_copies: documents of the same text, this one too; n_links: different texts that this one is linked to;
    n_linked_docs: the documents that have those texts.
    """
    known, texts = _classes(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("mark"), F.col(text).alias("text")))
    texts = materialise(texts, "classes")
    total = known.count()
    hot = texts.where(F.col("n_copies") * HOT > total)  # at most HOT rows
    columns = ["doc_id", "class_id", "n_copies", "n_links", "n_linked_docs"]
    of_hot = known.join(F.broadcast(hot), "node").select(*columns)
    rest = known.where(F.col("node").isNotNull()).join(F.broadcast(hot.select("node")), "node", "left_anti")
    rest = rest.join(texts.where(F.col("n_copies") * HOT <= total), "node").select(*columns)
    zero = F.lit(0).cast("long")
    own = known.where(F.col("node").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("n_copies"), zero.alias("n_links"), zero.alias("n_linked_docs"))
    return of_hot.unionByName(rest).unionByName(own)


def first_of_class(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each class, that of the smallest doc_id; all columns as they are.

    Rows without a doc_id are compared as well and come after the others. Of rows with the same doc_id in one class the
    one of the smallest row hash stays; of rows alike in every column, one. Rows of null text all stay, but for repeats.
    """
    hashed = F.xxhash64(*[F.to_json(c) if kind.startswith("map") else F.col(c) for c, kind in docs.dtypes])
    # A row without a doc_id is known by its text, above all usual ids.
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(1 << 62) + F.pmod(F.xxhash64(text), F.lit(1 << 62)))
    rows = docs.withColumns({"_key": key, "_mark": hashed})
    known, texts = _classes(rows.select(F.col("_key").alias("doc_id"), F.col("_mark").alias("mark"), F.col(text).alias("text")))
    first = texts.groupBy("class").agg(F.min("best").alias("best")).select(F.col("best.doc_id").alias("_key"), F.col("best.mark").alias("_mark"))
    first = first.unionByName(known.where(F.col("node").isNull()).select(F.col("doc_id").alias("_key"), F.col("mark").alias("_mark")).distinct())
    # Repeated rows go before the shuffle; the join then finds them where they are.
    return rows.dropDuplicates(["_key", "_mark"]).join(first, ["_key", "_mark"], "left_semi").select(*docs.columns)


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


OP8_SQL = r"""WITH RECURSIVE words AS (
  SELECT doc_id, md5(text) AS node, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
texts AS (SELECT node, any_value(w) AS w, count(*) AS copies FROM words GROUP BY node),
grams AS (SELECT DISTINCT node, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g FROM texts),
sizes AS (SELECT node, count(*) AS n FROM grams GROUP BY node),
pairs AS (SELECT a.node AS x, b.node AS y, count(*) AS s FROM grams a JOIN grams b ON a.g = b.g AND a.node <> b.node GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN sizes p ON p.node = x JOIN sizes q ON q.node = y WHERE s >= 0.8 * (p.n + q.n - s) - 1e-9),
reach(node, root) AS (SELECT node, node FROM texts UNION SELECT r.node, l.y FROM reach r JOIN links l ON r.root = l.x),
comp AS (SELECT node, min(root) AS class FROM reach GROUP BY node),
cls AS (SELECT class, min(doc_id) AS class_id FROM words JOIN comp USING (node) GROUP BY class),
cnt AS (SELECT x AS node, count(*) AS n_links, sum(copies)::BIGINT AS n_linked_docs FROM links JOIN texts ON texts.node = y GROUP BY x)
SELECT doc_id, class_id, copies AS n_copies, coalesce(n_links, 0) AS n_links, coalesce(n_linked_docs, 0) AS n_linked_docs
FROM words JOIN texts USING (node) JOIN comp USING (node) JOIN cls USING (class) LEFT JOIN cnt USING (node)
UNION ALL SELECT doc_id, doc_id, 1, 0, 0 FROM documents WHERE text IS NULL"""
