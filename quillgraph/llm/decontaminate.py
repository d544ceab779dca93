"""Benchmark decontamination with SimHash windows, multi-index Hamming blocks and exact weighted-shingle similarity.

The benchmark goes through in parts of about ``PART_WORDS`` words, dealt by a hash, so what is broadcast has a bound at
any size. For an item of n words, windows of n words slide over every whole text; a text of fewer words is one window as
a whole, so that a cut copy is found too:

1. A window can only be similar to an item if it shares a shingle with it, so places without a shingle of some item of
   that length are passed over (this loses nothing). Every item-sized window with such a shingle gets a SimHash of
   ``BITS`` bits over its weighted word shingles, and meets the items whose shingles are near.
2. Fingerprints are split into ``BLOCKS`` blocks. Two that differ in at most ``RADIUS`` bits differ in at most
   RADIUS // BLOCKS bits in one block at least, so looking up each block among the items' blocks within that distance
   finds all fingerprints within the radius (pigeonhole), and the whole distance is then tested.
3. Candidates are verified by the weighted Jaccard similarity of their shingle multisets, at least ``THRESHOLD``; a
   shingle weighs 1, times its count.

Words are runs of letters and digits, lower-cased, so case and punctuation don't hide a leak. Reported for each
document and item: the best window (first of equals), its similarity and place, and the number of windows that match.

Defined cases: null and empty texts match nothing; texts too short for the threshold can't match an item; items
without a word match nothing; items shorter than a shingle are one shingle; items of null id are searched like others;
repeated documents are reported for each row, repeated items once; texts of any length go through in pieces of
``PIECE`` windows; an empty benchmark or table gives an empty result; further columns are ignored (``clean_documents``
keeps them).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm.common import materialise, small_batches, table
from quillgraph.llm.shingles import WIDTH, roll, word_hashes

THRESHOLD = 0.8
BITS = 64
BLOCKS = 4
#: Windows of similarity 0.8 differ in about 10 bits of 64 from the item (angle of cosine 8/9), with a deviation of 3.
RADIUS = 23
#: Words of the benchmark in one part, about; the index of a part is broadcast.
PART_WORDS = 500_000
#: Windows that are looked up at once.
PIECE = 1024

_WORD = re.compile(r"[^\W_]+")
#: Leading hash bits that tell most places without a benchmark shingle at once.
_TABLE_BITS = 20


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _signs(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each shingle's hash."""
    bits = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    """Fingerprints: a bit is 1 where the weighted sum is positive."""
    packed = np.packbits(sums > 0, axis=1, bitorder="little")
    return np.ascontiguousarray(packed).view("<u8").ravel()


def _blocks(prints: np.ndarray) -> np.ndarray:
    width = BITS // BLOCKS
    shifts = np.arange(BLOCKS, dtype=np.uint64) * np.uint64(width)
    return ((prints[:, None] >> shifts) & np.uint64((1 << width) - 1)).astype(np.int64)


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the lesser counts over the sum of the greater ones."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    least = int(np.minimum(n[i], m[j]).sum())
    return least / (len(a) + len(b) - least) if len(a) or len(b) else 0.0


class Group:
    """Items of one length in words: fingerprints, and their blocks as sets of values within reach."""

    def __init__(self, length: int, width: int, items: list[tuple[int, np.ndarray]]):
        self.length, self.width, self.items = length, width, items
        self.prints = _pack(np.stack([_signs(s).sum(axis=0) for _, s in items]))
        self.blocks = _blocks(self.prints)

    def candidates(self, prints: np.ndarray, items: np.ndarray) -> list[tuple[int, int]]:
        """Windows, and of the given items those whose fingerprints differ in at most RADIUS bits."""
        reached = np.zeros((len(prints), len(items)), bool)
        for own, column in zip(self.blocks[items].T, _blocks(prints).T, strict=True):
            values, inverse = np.unique(column, return_inverse=True)
            theirs, place = np.unique(own, return_inverse=True)
            reached |= (np.bitwise_count(values[:, None] ^ theirs[None, :]) <= RADIUS // BLOCKS)[inverse][:, place]
        window, item = np.nonzero(reached)
        close = np.bitwise_count(prints[window] ^ self.prints[items[item]]) <= RADIUS
        return list(zip(window[close].tolist(), items[item[close]].tolist(), strict=True))


class Index:
    """One part of the benchmark."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        by: dict[tuple[int, int], list[tuple[int | None, np.ndarray]]] = {}
        for item_id, text in items:
            words = words_of(text)
            if words:
                width = min(WIDTH, len(words))
                by.setdefault((len(words), width), []).append((item_id, roll(word_hashes(words), width)))
        self.groups = [Group(length, width, found) for (length, width), found in sorted(by.items())]
        # The distinct shingles of each width, sorted, and the items that have them: a run of (group, item) each.
        self.shingles: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        self.tables = {}
        for w in {g.width for g in self.groups}:
            own = [(np.unique(s), k, i) for k, g in enumerate(self.groups) if g.width == w for i, (_, s) in enumerate(g.items)]
            flat = np.concatenate([s for s, _, _ in own])
            group, item = (np.repeat([o[c] for o in own], [len(s) for s, _, _ in own]) for c in (1, 2))
            order = np.lexsort((item, group, flat))
            values, counts = np.unique(flat[order], return_counts=True)
            self.shingles[w] = values, np.concatenate([[0], np.cumsum(counts)]), group[order], item[order]
            self.tables[w] = np.zeros(1 << _TABLE_BITS, bool)
            self.tables[w][values >> np.uint64(64 - _TABLE_BITS)] = True

    def search(self, text: str | None) -> list[tuple[int, float, int, int, int]]:
        """item_id, similarity, first and end word of the best window, number of matching windows."""
        words = words_of(text)
        hashes = word_hashes(words)
        found: dict[tuple[int, int], tuple[float, int, int, int]] = {}
        for width, (shingles, runs, groups, items) in self.shingles.items():
            rolled = roll(hashes, width)
            near = np.flatnonzero(self.tables[width][rolled >> np.uint64(64 - _TABLE_BITS)])
            if not len(near):
                continue
            place = np.minimum(np.searchsorted(shingles, rolled[near]), len(shingles) - 1)
            sure = shingles[place] == rolled[near]
            near, place = near[sure], place[sure]
            # A row for each hit of an item: its place in the text, group and item.
            many = runs[place + 1] - runs[place]
            at = np.repeat(near, many)
            row = np.repeat(runs[place] - np.cumsum(many) + many, many) + np.arange(many.sum())
            for g in np.unique(groups[row]).tolist():
                own = groups[row] == g
                self._search_group(g, at[own], items[row[own]], rolled, len(hashes), found)
        return [(self.groups[g].items[k][0], *rest) for (g, k), rest in found.items()]

    def _search_group(self, g: int, hits: np.ndarray, items: np.ndarray, rolled: np.ndarray, n_words: int, found: dict) -> None:
        group = self.groups[g]
        span = group.length - group.width + 1  # shingles in a window
        if len(rolled) < THRESHOLD * span - 1e-9:
            return  # too short for any window to be similar enough
        # A text with fewer words than the item is one window as a whole.
        span, last = min(span, len(rolled)), max(n_words - group.length, 0)
        # Window starts that hold a hit: hit - span + 1 to hit.
        mark = np.zeros(last + 2, np.int32)
        np.add.at(mark, np.clip(hits - span + 1, 0, last + 1), 1)
        np.add.at(mark, np.clip(hits + 1, 0, last + 1), -1)
        starts = np.flatnonzero(np.cumsum(mark)[: last + 1] > 0)
        for a, b in _runs(starts) if len(starts) else ():
            near = np.unique(items[(hits >= a) & (hits < b + span)])
            sums = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(_signs(rolled[a : b + span]), axis=0, dtype=np.int32)])
            prints = _pack(sums[span : span + b - a + 1] - sums[: b - a + 1])
            for window, k in group.candidates(prints, near):
                start = a + window
                score = weighted_jaccard(rolled[start : start + span], group.items[k][1])
                if score >= THRESHOLD - 1e-12:
                    best = found.get((g, k), (-1.0, 0, 0, 0))
                    n = best[3] + 1
                    found[g, k] = (score, start, min(start + group.length, n_words), n) if score > best[0] else (*best[:3], n)


def _runs(starts: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """First and last of each run of neighbouring starts, cut into pieces of bounded length."""
    cuts = np.flatnonzero(np.diff(starts) > 1) + 1
    for run in np.split(starts, cuts):
        for k in range(0, len(run), most):
            yield int(run[k]), int(run[min(k + most, len(run)) - 1])


def indexes(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[Index]:
    """The benchmark's parts, one after the other; a word has some six bytes. At least one, which may be empty."""
    rows = benchmark.where(F.col(text).isNotNull()).select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).distinct()
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-total // (6 * PART_WORDS)))
    for k in range(parts):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()  # about PART_WORDS words
        yield Index(sorted(((r[0], r[1]) for r in own), key=lambda r: (r[0] is None, r[0] or 0, r[1])))


def build_index(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> Index:
    """The index of a benchmark that is known to be one part."""
    (index,) = indexes(benchmark, item_id, text)
    return index


RESULT = "doc_id long, item_id long, similarity double, first_word long, end_word long, n_windows long"


def _each_part(docs: DataFrame, benchmark: DataFrame, step, add) -> DataFrame:
    """The step's frame over every part of the benchmark. With several, each part's result is written before the next part is read."""
    out, parts = None, indexes(benchmark)
    index = next(parts)
    while index is not None:
        after = next(parts, None)
        held = docs.sparkSession.sparkContext.broadcast(index)
        found = step(docs if out is None or add else out, held)
        if out is None and after is None:
            return found
        found = materialise(found, "part")
        held.unpersist()
        out = found if out is None or not add else out.unionByName(found)
        index = after
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, item_id, similarity, first_word, end_word, n_windows of every leak."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]

    def step(rows: DataFrame, held) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaks = [(i, *leak) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for leak in held.value.search(t)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in leaks], kind) for k, kind in enumerate(kinds)], [c.split()[0] for c in RESULT.split(", ")])

        return rows.mapInArrow(run, RESULT)

    return _each_part(docs, benchmark, step, add=True)


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a leak, all columns kept; one pass for each part of the benchmark, nothing is shuffled."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def step(rows: DataFrame, held) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not held.value.search(t) for t in batch.column(at).to_pylist()], pa.bool_()))

        return rows.mapInArrow(run, T.StructType(docs.schema.fields))

    return _each_part(docs, benchmark, step, add=False)


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
