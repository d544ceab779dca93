"""Removal of repeated byte strings by distributed prefix doubling over a sparse set of positions.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts in a document with a smaller doc_id. Ranking all
positions would move many times the input (``doubling.py`` does that, for small corpora), so ranks are given to
synchronising positions first: each window of ``LENGTH`` bytes has one anchor, the leftmost smallest hash of its
``SEED``-byte strings, and neighbouring windows with the same anchor form a run. Equal windows have equal anchors at equal
offsets, so ranks of anchors decide for all positions:

1. Anchors are ranked by their SEED-byte prefix. Those whose rank is unique among documents drop out.
2. The rest are ranked by the pair of that rank and the rank of the whole run (its bytes from the first window's start
   to the last one's end). A run that also occurs in an earlier document is repeated as a whole.
3. Only positions of runs that share their anchor with an earlier or later block, but not the whole run, are ranked by
   the pair of the ranks of their first and their second ``LENGTH`` / 2 bytes, which is past the threshold.

Documents are dealt into blocks by ranges of doc_id, so comparing blocks compares documents. A rank is the hash of the
string; a block sends each rank once, to the bucket that the rank falls in, so a string in a third of all documents is
one entry a block. Buckets sort the entries and answer which of them an earlier block has. The texts are shuffled once:
all passes of the plan read the same exchange.

Ranks are wide enough to be taken for the strings: runs compare by 104 bits (64 of them where the anchors are the same),
windows by 96. Among 10^12 different windows (100 TB) a false match has a chance below one in 10^5.

Blocks: cuts of doc_id at equal numbers of bytes, at most ``MOST_CUTS`` of them; a larger corpus has several blocks of
equal width in doc_id between two cuts, so what the driver holds doesn't grow.

Defined cases: a null text counts as empty; texts shorter than ``LENGTH`` lose nothing; rows of the same doc_id don't
repeat each other; rows with a null doc_id lose nothing; a text of any length is one piece of a block; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import small_batches, table, whole_text

LENGTH = 50
SEED = 20
#: Bytes of text in a block, about.
BLOCK_BYTES = 3 << 20
#: Cuts of doc_id that are sent around.
MOST_CUTS = 4096
#: Ranges of the hash that a block's windows are compared in, by the four leading bits.
SLICES = 16
#: Bytes that are hashed at once.
CHUNK = 1 << 19

HALF = LENGTH // 2
_MIXED = np.uint64((1 << 64) - 1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTERS = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, kept for later calls."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            out = np.ones(size, np.uint64)
            done, step = 1, base
            while done < size:
                out[done : 2 * done] = out[:done] * np.uint64(step)
                done, step = 2 * done, step * step % (1 << 64)
            _POWERS[k] = out
    return _POWERS[0][:n], _POWERS[1][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Chunk:
    """Hashes of the substrings of a piece of a block's bytes."""

    def __init__(self, raw: bytes):
        letters = _LETTERS[np.frombuffer(raw, np.uint8)]
        powers, self.inverse = _powers(len(letters) + 1)
        self.sums = np.zeros(len(letters) + 1, np.uint64)
        np.cumsum(letters * powers[:-1], out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def of_length(self, n: int) -> np.ndarray:
        return _mix((self.sums[n:] - self.sums[:-n]) * self.inverse[: len(self.sums) - n] + np.uint64(n))


class Block:
    """Documents of a block in order of doc_id, and its runs ordered by anchor, run and document."""

    def __init__(self, ids: list[int], texts: list[bytes]):
        order = sorted(range(len(ids)), key=ids.__getitem__)
        self.ids, self.texts = [ids[k] for k in order], [texts[k] for k in order]
        _, self.rank = np.unique(np.array(self.ids, np.int64), return_inverse=True)
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        parts = [self._runs(*c) for c in self._chunks()]
        low, high, anchor, run = (np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.int64) for k in range(4))
        doc = self.rank[np.searchsorted(self.starts, low, "right") - 1] if len(low) else np.empty(0, np.int64)
        order = np.lexsort((doc, run, anchor))
        self.low, self.high, self.doc = low[order], high[order], doc[order]
        anchor, run = anchor[order].astype(np.uint64), run[order].astype(np.uint64)
        n = len(anchor)
        new = np.ones(n, bool)
        new[1:] = anchor[1:] != anchor[:-1]
        own = new.copy()
        own[1:] |= run[1:] != run[:-1]
        first = self.doc[np.flatnonzero(own)][np.cumsum(own) - 1] if n else self.doc
        #: Runs that an earlier document of this block has too.
        self.repeated = self.doc > first
        #: Entries: one for each anchor; of several runs, or of one.
        self.entry = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        self.anchors = anchor[at]
        several = np.bincount(self.entry[own], minlength=len(at)) > 1 if n else np.empty(0, bool)
        self.several = several
        self.run_ranks = np.where(several, _MIXED, np.minimum(run[at], _MIXED - np.uint64(1)))

    def _chunks(self):
        """Pieces of whole documents: the offset of the first, their sizes, their bytes."""
        k = 0
        while k < len(self.texts):
            end, size = k, 0
            while end < len(self.texts) and (end == k or size + self.sizes[end] <= CHUNK):
                size += self.sizes[end]
                end += 1
            yield int(self.starts[k]), self.sizes[k:end], b"".join(self.texts[k:end])
            k = end

    @staticmethod
    def _runs(offset: int, sizes: np.ndarray, raw: bytes):
        """First and last window start of each run, the hash of its anchor (40 bits) and of the run."""
        empty = np.empty(0, np.int64)
        n = len(raw) - LENGTH + 1
        if n <= 0:
            return empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
        chunk = Chunk(raw)
        seeds = chunk.of_length(SEED)
        # The smallest hash of each window with its place in the low bits: the leftmost of equals.
        bits = max(20, len(seeds).bit_length())
        low_bits = np.uint64((1 << bits) - 1)
        least = (seeds & ~low_bits) | np.arange(len(seeds), dtype=np.uint64)
        width, have = LENGTH - SEED + 1, 1
        while 2 * have <= width:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < width:
            least = np.minimum(least[: -(width - have)], least[width - have :])
        place = (least & low_bits).astype(np.int64)
        mark = np.zeros(n + 1, np.int32)
        ends = np.cumsum(sizes)
        long = sizes >= LENGTH
        np.add.at(mark, (ends - sizes)[long], 1)
        np.add.at(mark, (ends - LENGTH + 1)[long], -1)
        valid = np.cumsum(mark[:-1]) > 0
        opens = valid.copy()
        opens[1:] &= ~valid[:-1] | (place[1:] != place[:-1])
        closes = valid.copy()
        closes[:-1] &= ~valid[1:] | (place[1:] != place[:-1])
        low, high = np.flatnonzero(opens), np.flatnonzero(closes)
        return low + offset, high + offset, seeds[place[low]] >> np.uint64(24), chunk.hashes(low, high + LENGTH)

    def windows(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and rank of every window of the given runs, by start (and so by document)."""
        runs = runs[np.argsort(self.low[runs], kind="stable")]
        low, n = self.low[runs], self.high[runs] - self.low[runs] + 1
        total = int(n.sum())
        starts = np.arange(total, dtype=np.int32) + np.repeat((low - np.cumsum(n) + n).astype(np.int32), n)
        ranks = np.empty(total, RANK)
        for offset, _, raw in self._chunks():
            a, b = np.searchsorted(starts, np.array([offset, offset + len(raw)], starts.dtype))
            if a < b:
                at = starts[a:b].astype(np.int64) - offset
                chunk = Chunk(raw)
                # The pair of the ranks at the window and half a window further on; the second is kept in 32 bits beside it.
                first, second = chunk.hashes(at, at + HALF), chunk.hashes(at + HALF, at + LENGTH)
                ranks["pair"][a:b] = _mix(first * np.uint64(_BASE) + second)
                ranks["second"][a:b] = (second >> np.uint64(32)).astype(np.uint32)
        return starts, ranks

    def documents(self, starts: np.ndarray) -> np.ndarray:
        return self.rank[np.searchsorted(self.starts, starts, "right") - 1]


#: The rank of a window.
RANK = np.dtype([("pair", "<u8"), ("second", "<u4")])


def _ordered(ranks: np.ndarray) -> np.ndarray:
    """A stable order by rank. Ranks with the same pair but not the same second half are put in order where they meet."""
    order = np.argsort(ranks["pair"], kind="stable")
    pair, second = ranks["pair"][order], ranks["second"][order]
    odd = np.flatnonzero((pair[1:] == pair[:-1]) & (second[1:] != second[:-1]))
    return np.lexsort((ranks["second"], ranks["pair"])) if len(odd) else order


def _news(ranks: np.ndarray) -> np.ndarray:
    """Where a rank differs from the one before it."""
    new = np.ones(len(ranks), bool)
    new[1:] = (ranks["pair"][1:] != ranks["pair"][:-1]) | (ranks["second"][1:] != ranks["second"][:-1])
    return new


def _distinct(ranks: np.ndarray) -> np.ndarray:
    """Sorted and without repeats."""
    ranks = ranks[_ordered(ranks)]
    return ranks[_news(ranks)]


def _find(ranks: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each rank among distinct sorted ones, and whether it is there."""
    place = np.searchsorted(among["pair"], ranks["pair"])
    same = np.zeros(len(ranks), bool)
    at = np.minimum(place, len(among) - 1)
    open_ = np.arange(len(ranks))
    # Nearly always the first of a pair is the only one.
    while len(open_):
        here = (place[open_] < len(among)) & (among["pair"][at[open_]] == ranks["pair"][open_])
        hit = here & (among["second"][at[open_]] == ranks["second"][open_])
        same[open_[hit]] = True
        open_ = open_[here & ~hit]
        place[open_] += 1
        at[open_] = np.minimum(place[open_], len(among) - 1)
    return at, same


def _deltas(values: np.ndarray) -> bytes:
    """Sorted numbers as differences, byte by byte: the high bytes are zeros, which the shuffle's compression takes out."""
    values = values.astype("<u8")
    values[1:] -= values[:-1].copy()
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()


def _sums(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n).reshape(8, n).T).view("<u8").ravel(), dtype=np.uint64)


def _answers(data: pa.Table | None, kind: int) -> np.ndarray:
    """The answers of one kind, in the order of what was asked: buckets are ranges of ranks."""
    rows = sorted((b, p) for k, b, p in zip(*(data.column(c).to_pylist() for c in ("kind", "bucket", "payload")), strict=True) if k == kind)
    return np.frombuffer(b"".join(p for _, p in rows), np.uint8)


def _block(cell: pa.Table) -> Block:
    return Block(cell.column("doc_id").to_pylist(), cell.column("raw").to_pylist())


def _slices(block: int, ranks: np.ndarray, bits: int, buckets: int, payload, kind: int) -> pa.Table:
    """A row for each bucket that some rank (sorted, of so many bits) falls in."""
    bucket = ((ranks >> np.uint64(bits - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(ranks)]]) if len(ranks) else np.zeros(1, np.int64)
    rows = [(int(bucket[a]), payload(a, b)) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    n = len(rows)
    return pa.table({"block": pa.array([block] * n, pa.int32()), "kind": pa.array([kind] * n, pa.int32()), "bucket": pa.array([b for b, _ in rows], pa.int32()), "payload": pa.array([p for _, p in rows], pa.binary())})


MESSAGE = "block int, kind int, bucket int, payload binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept binary"


def _ask_runs(buckets: int):
    def run(cell: pa.Table) -> pa.Table:
        block = _block(cell)
        payload = lambda i, j: _deltas(block.anchors[i:j]) + block.run_ranks[i:j].astype("<u8").tobytes()
        return _slices(cell.column("block")[0].as_py(), block.anchors, 40, buckets, payload, 1)

    return run


def _tell_runs(cell: pa.Table) -> pa.Table:
    """0: no other block has the anchor, or this one has the run first; 1: an earlier block has the run; 2: undecided."""
    blocks, payloads = cell.column("block").to_pylist(), cell.column("payload").to_pylist()
    order = sorted(range(len(blocks)), key=blocks.__getitem__)
    sizes = [len(payloads[k]) // 16 for k in order]
    anchor = np.concatenate([_sums(payloads[k], n) for k, n in zip(order, sizes, strict=True)])
    run = np.concatenate([np.frombuffer(payloads[k], "<u8", n, 8 * n) for k, n in zip(order, sizes, strict=True)])
    sort = np.lexsort((np.arange(len(anchor)), run, anchor))  # rows stand by block, so ties do too
    a, r = anchor[sort], run[sort]
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    own = new.copy()
    own[1:] |= r[1:] != r[:-1]
    group = np.cumsum(new) - 1
    met = np.bincount(group)[group] > 1
    alike = (np.bincount(group[own])[group] == 1) & (r != _MIXED)
    state = np.where(~met, 0, np.where(~own & (r != _MIXED), 1, np.where(alike, 0, 2))).astype(np.uint8)
    out = np.empty(len(a), np.uint8)
    out[sort] = state
    return _replies(cell, [blocks[k] for k in order], sizes, out, 1)


def _tell_windows(cell: pa.Table) -> pa.Table:
    """1 if an earlier block has the window."""
    blocks, payloads = cell.column("block").to_pylist(), cell.column("payload").to_pylist()
    order = sorted(range(len(blocks)), key=blocks.__getitem__)
    sizes = [len(payloads[k]) // RANK.itemsize for k in order]
    ranks = np.empty(sum(sizes), RANK)
    ranks["pair"] = np.concatenate([_sums(payloads[k], n) for k, n in zip(order, sizes, strict=True)])
    ranks["second"] = np.concatenate([np.frombuffer(payloads[k], "<u4", n, 8 * n) for k, n in zip(order, sizes, strict=True)])
    sort = _ordered(ranks)
    out = np.empty(len(ranks), np.uint8)
    out[sort] = ~_news(ranks[sort])
    return _replies(cell, [blocks[k] for k in order], sizes, out, 2)


def _replies(cell: pa.Table, blocks: list[int], sizes: list[int], out: np.ndarray, kind: int) -> pa.Table:
    ends = np.cumsum(sizes)
    n = len(blocks)
    bucket = cell.column("bucket")[0].as_py()
    parts = [out[e - s : e].tobytes() for s, e in zip(sizes, ends.tolist(), strict=True)]
    return pa.table({"block": pa.array(blocks, pa.int32()), "kind": pa.array([kind] * n, pa.int32()), "bucket": pa.array([bucket] * n, pa.int32()), "payload": pa.array(parts, pa.binary())})


def _open_runs(block: Block, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs whose windows must be told apart within the block, and of these the ones that other blocks are asked for."""
    state = states[block.entry] if len(block.entry) else np.empty(0, np.uint8)
    asked = (state == 2) & ~block.repeated
    inside = (state == 0) & block.several[block.entry] & ~block.repeated if len(block.entry) else asked
    return np.flatnonzero(asked | inside), asked


def _ask_windows(buckets: int):
    def run(cell: pa.Table, told: pa.Table) -> pa.Table:
        if not cell.num_rows:
            return _slices(0, np.empty(0, np.uint64), 64, buckets, None, 2)
        block = _block(cell)
        _, asked = _open_runs(block, _answers(told, 1))
        ranks = _distinct(block.windows(np.flatnonzero(asked))[1])
        payload = lambda i, j: _deltas(ranks["pair"][i:j]) + ranks["second"][i:j].tobytes()
        return _slices(cell.column("block")[0].as_py(), ranks["pair"], 64, buckets, payload, 2)

    return run


def _remove(with_text: bool):
    def run(cell: pa.Table, told: pa.Table) -> pa.Table:
        rows = []
        if cell.num_rows:
            block = _block(cell)
            states, seen = _answers(told, 1), _answers(told, 2).astype(bool)
            mark = np.zeros(int(block.starts[-1]) + 1, np.int32)
            gone = block.repeated | (states[block.entry] == 1) if len(block.entry) else block.repeated
            np.add.at(mark, block.low[gone], 1)
            np.add.at(mark, block.high[gone] + LENGTH, -1)
            runs, asked = _open_runs(block, states)
            outside = _distinct(block.windows(np.flatnonzero(asked))[1])
            starts, ranks = block.windows(runs)
            # By ranges of the rank, so that what is sorted at once stays small.
            for part in range(SLICES):
                mine = (ranks["pair"] >> np.uint64(60)) == part
                at, own = starts[mine], ranks[mine]
                if not len(at):
                    continue
                order = _ordered(own)  # starts ascend, so equal ranks stand by document
                at, own = at[order], own[order]
                docs = block.documents(at)
                covered = docs > docs[np.flatnonzero(new := _news(own))][np.cumsum(new) - 1]
                if len(outside):
                    place, known = _find(own, outside)
                    covered |= known & seen[place]
                np.add.at(mark, at[covered], 1)
                np.add.at(mark, at[covered] + LENGTH, -1)
            del starts, ranks, outside
            removed = np.cumsum(mark[:-1]) > 0
            for k, text in enumerate(block.texts):
                own = removed[block.starts[k] : block.starts[k + 1]]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
                kept = np.frombuffer(text, np.uint8)[~own].tobytes() if len(edges) else text
                spans = [{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()]
                rows.append((block.ids[k], len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), spans, kept if with_text else None))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), span, pa.binary()]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
        return pa.table([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=names)

    return run


def _blocks(docs: DataFrame) -> tuple[DataFrame, int]:
    """block, doc_id, raw of the rows with a doc_id, in blocks of neighbouring ids and about BLOCK_BYTES; and the number of blocks."""
    size, rows = docs.agg(F.coalesce(F.sum(F.octet_length("raw")), F.lit(0)), F.count("doc_id")).first()
    known = docs.where(F.col("doc_id").isNotNull())
    n = max(1, min(rows, -(-size // BLOCK_BYTES)))
    cuts = min(n, MOST_CUTS)
    if n == 1:
        return known.select(F.lit(0).alias("block"), "doc_id", "raw"), 1
    # A document counts once for each mean size that it has, so parts between cuts hold about the same bytes.
    mean = max(1, size // max(rows, 1))
    weighed = known.select("doc_id", F.explode(F.sequence(F.lit(0), F.floor(F.octet_length("raw") / mean))).alias("k"))
    found = weighed.agg(F.percentile_approx("doc_id", [k / cuts for k in range(1, cuts)], 4 * cuts), F.min("doc_id"), F.max("doc_id")).first()
    edges = sorted({float(c) for c in found[0] or []})
    part = Bucketizer(splits=[-float("inf"), *edges, float("inf")], inputCol="_x", outputCol="_part").transform(known.withColumn("_x", F.col("doc_id").cast("double")))
    each = -(-n // cuts)
    low = F.element_at(F.array(*[F.lit(x) for x in [float(found[1]), *edges]]), F.col("_part").cast("int") + 1) if each > 1 else F.lit(0.0)
    high = F.element_at(F.array(*[F.lit(x) for x in [*edges, float(found[2]) + 1]]), F.col("_part").cast("int") + 1) if each > 1 else F.lit(1.0)
    within = F.least(F.floor((F.col("_x") - low) / F.greatest(high - low, F.lit(1.0)) * each), F.lit(each - 1)) if each > 1 else F.lit(0)
    return part.select((F.col("_part").cast("int") * each + within.cast("int")).alias("block"), "doc_id", "raw"), n


def remove_repeats(docs: DataFrame, with_text: bool = False, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed bytes) and, if asked for, the kept bytes."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).cast("binary").alias("raw"))
    known, n = _blocks(docs)
    blocks = known.groupBy("block")
    buckets = n
    told_runs = blocks.applyInArrow(_ask_runs(buckets), MESSAGE).groupBy("bucket").applyInArrow(_tell_runs, MESSAGE)
    asked = blocks.cogroup(told_runs.groupBy("block")).applyInArrow(_ask_windows(buckets), MESSAGE)
    told_windows = asked.groupBy("bucket").applyInArrow(_tell_windows, MESSAGE)
    told = told_runs.unionByName(told_windows)
    found = blocks.cogroup(told.groupBy("block")).applyInArrow(_remove(with_text), RESULT)
    none = docs.where(F.col("doc_id").isNull()).select(
        "doc_id", F.octet_length("raw").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.sha2("raw", 256).alias("kept_sha256"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"), (F.col("raw") if with_text else F.lit(None).cast("binary")).alias("kept"),
    )
    return found.unionByName(none)


def op1_prefix_doubling(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
