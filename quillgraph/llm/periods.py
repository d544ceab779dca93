"""Periodic runs: stretches of words that repeat with a period, found by block convolution.

At the scale of distances S to 2S - 1 (S a power of two), the words of many documents, one after the other with separators
that equal nothing, are cut into blocks of S words. For each block an exact number-theoretic transform gives the sums of squared
differences between the block and every window that follows it at such a distance; where a sum is zero, the
block occurs again. A run of period q has three periods or more, so at the scale of q it holds a whole block and its next
occurrence: each such distance is the seed of an extension to both sides, word by word. Sums are residues, so a zero is
necessary for an occurrence, and the extension compares the words themselves: nothing is missed and nothing is invented.

The transform works modulo the prime ``PRIME``, in parts of at most 64 points as matrix products of whole numbers
below 2^53, which doubles hold exactly. Blocks of more than ``LONGEST_BLOCK`` words are cut to it; the windows then follow one after the other.

Every document lies in one task as a whole; nothing is shuffled, and a lost task is computed again.

Defined cases: a null or empty text has no words and no runs; a null doc_id is kept; repeated rows are documents of their
own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import table

#: 7 * 2^20 + 1, whose multiplicative group 3 generates.
PRIME = 7_340_033
GENERATOR = 3
#: Words of the smallest blocks; they serve all distances below twice as many.
FIRST = 8
#: Words of the longest blocks.
LONGEST_BLOCK = 1 << 18
#: A run has so many words and so many periods at least.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words of the documents that are transformed together.
GROUP_WORDS = 1 << 20
#: Points of a transform held at a time.
POINTS = 1 << 16


def _mod(x: np.ndarray) -> np.ndarray:
    """Whole numbers below 2^52 in size to residues between -PRIME / 2 and PRIME / 2, in place."""
    t = x * (1.0 / PRIME)
    np.rint(t, out=t)
    t *= PRIME
    x -= t
    return x


@lru_cache(maxsize=256)
def _powers(n: int, sign: int) -> np.ndarray:
    """Powers 0 to n - 1 of a root of unity of order n."""
    root = pow(GENERATOR, (PRIME - 1) // n, PRIME)
    root = pow(root, PRIME - 2, PRIME) if sign < 0 else root
    powers = np.ones(1)
    while len(powers) < n:
        powers = np.concatenate([powers, _mod(powers * float(pow(root, len(powers), PRIME)))])
    return powers


@lru_cache(maxsize=256)
def _matrix(n: int, sign: int, factor: int) -> np.ndarray:
    k = np.arange(n)
    return _mod(_powers(n, sign)[np.outer(k, k) % n] * float(factor))


@lru_cache(maxsize=64)
def _turns(n: int, a: int, sign: int) -> np.ndarray:
    return _powers(n, sign)[np.arange(a)[:, None] * np.arange(n // a)[None, :]]


def transform(x: np.ndarray, sign: int = 1, factor: int = 1, first: int | None = None) -> np.ndarray:
    """``factor`` times the transform of each row, whose length is a power of two; sign -1: the inverse one, without 1 / n.

    Rows are residues; results are whole numbers below 2^50 that stand for theirs, the ``first`` ones of each row if given.
    """
    rows, n = x.shape
    if n <= 64:
        return x @ _matrix(n, sign, factor)[:, :first]
    bits = n.bit_length() - 1
    a = 1 << -(-bits // -(-bits // 6))  # parts of about the same size
    b = n // a
    # Points k = b * i + j: transforms over i, a turn for each pair, transforms over j.
    y = _mod(np.matmul(_matrix(a, sign, factor), x.reshape(rows, a, b)))
    y = _mod(y * _turns(n, a, sign))
    y = transform(y.reshape(rows * a, b), sign, first=None if first is None else -(-first // a))
    return y.reshape(rows, a, -1).transpose(0, 2, 1).reshape(rows, -1)[:, :first]


def occurrences(values: np.ndarray, scale: int, longest: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances at which blocks of ``values`` seem to occur again, for one scale.

    ``values``: residues. Blocks begin at multiples of ``scale``; distances are those of the scale (all below twice
    it for the smallest). A pair may be wrong with a chance of one in ``PRIME``; none is missed.
    """
    block = min(scale, longest or LONGEST_BLOCK)
    step = scale // block  # blocks from one start to the next
    n = -(-len(values) // block)
    cells = np.zeros((n + 2 * step + 2) * block)
    cells[: len(values)] = values
    squares = np.concatenate([[0.0], np.cumsum(_mod(cells * cells))])
    cells = cells.reshape(-1, block)
    shifts = range(step if scale > FIRST else 0, 2 * step)
    lags = np.arange(block)
    factor = pow(block, PRIME - 2, PRIME)  # 2 / (2 * block)
    some = max(1, POINTS // (2 * block)) * step
    places, distances = [], []

    def spectra(rows: np.ndarray) -> np.ndarray:
        return _mod(transform(np.hstack([rows, np.zeros_like(rows)])))

    for at in range(0, n, some):
        end = min(at + some, n)
        own = np.arange(at, end, step)
        # Of blocks that follow one another at once each is transformed once, of others those of a window at a time.
        all_of = spectra(cells[at : end + 2]) if step == 1 else None
        flipped = all_of[: len(own)].copy() if step == 1 else spectra(cells[own])
        flipped[:, 1:] = flipped[:, :0:-1].copy()  # the spectrum at -f: the product is that of a correlation
        size = (squares[(own + 1) * block] - squares[own * block])[:, None]
        followed = None
        for shift in shifts:
            if step == 1:
                followed, following = all_of[shift : shift + len(own)], all_of[shift + 1 : shift + 1 + len(own)]
            else:
                followed = spectra(cells[own + shift]) if followed is None else following
                following = spectra(cells[own + shift + 1])
            # A window of two blocks: the spectrum of the second is half a turn on.
            window = np.empty_like(flipped)
            np.add(followed[:, ::2], following[:, ::2], out=window[:, ::2])
            np.subtract(followed[:, 1::2], following[:, 1::2], out=window[:, 1::2])
            window *= flipped
            total = transform(_mod(window), -1, PRIME - factor, first=block)
            start = ((own + shift) * block)[:, None] + lags
            total = total + size
            total += squares[start + block]
            total -= squares[start]
            row, lag = np.nonzero(_mod(total) == 0)
            places.append(own[row] * block)
            distances.append(shift * block + lag)
    place, distance = np.concatenate(places), np.concatenate(distances)
    real = (distance > 0) & (place + distance + block <= len(values))
    return place[real], distance[real]


def _agree(words: np.ndarray, a: int, b: int, step: int, most: int) -> int:
    """How many words agree from a and b on, going by ``step`` (1 or -1), at most ``most``."""
    done, size = 0, 32
    while done < most:
        size = min(size, most - done)
        i, j = a + step * done, b + step * done
        if step > 0:
            differ = words[i : i + size] != words[j : j + size]
        else:
            differ = (words[i - size + 1 : i + 1] != words[j - size + 1 : j + 1])[::-1]
        first = int(differ.argmax())
        if differ[first]:
            return done + first
        done, size = done + size, size * 2
    return most


def _residues(numbers: np.ndarray) -> np.ndarray:
    """A residue for each number, different for numbers that are less than ``PRIME`` apart."""
    return _mod((numbers % PRIME * 2_654_435 % PRIME).astype(np.float64))


def _joined(words: np.ndarray, bounds: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of some documents in one line, a number of its own before each; and where each begins."""
    sizes = np.diff(bounds)[docs]
    starts = np.cumsum(sizes + 1) - sizes
    line = np.empty(sizes.sum() + len(docs), np.int64)
    inside = np.ones(len(line), bool)
    inside[starts - 1] = False
    line[inside] = words[np.repeat(bounds[docs] - (starts - 1 - np.arange(len(docs))), sizes) + np.arange(sizes.sum())]
    line[~inside] = -1 - np.arange(len(docs))
    return line, starts


def _extend(line: np.ndarray, low: int, high: int, places: list[int], d: int, block: int, scale: int, known: dict[tuple[int, int], int]) -> None:
    """Adds to the ``known`` runs of the document in ``low`` to ``high`` those of distance ``d`` through the blocks at ``places`` (ascending)."""
    done = -1
    k = 0
    while k < len(places):
        p = places[k]
        k += 1
        if p < max(low, done) or p + d + block > high:
            continue
        # Inside a run whose period divides d there is nothing new, up to its end.
        inside = [e for (s, e), q in known.items() if d % q == 0 and s <= p - low and p - low + d + block <= e]
        if inside:
            done = max(inside) + low - d - block + 1
        else:
            right = _agree(line, p, p + d, 1, high - p - d)
            if right < block:
                continue
            done = p + right - block + 1
            left = _agree(line, p - 1, p + d - 1, -1, p - low) if p > low else 0
            s, e = p - left - low, p + d + right - low
            if e - s >= max(LEAST_WORDS, LEAST_PERIODS * d) and d < known.get((s, e), d + 1):
                known[s, e] = d
        if done - p > 8 * scale:
            k = bisect_left(places, done, k)


def find_runs(words: np.ndarray, bounds: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each document, by start and period.

    ``words``: the numbers of all words, none negative; ``bounds``: where the documents begin, and the end.
    """
    sizes = np.diff(bounds)
    found: list[dict[tuple[int, int], int]] = [{} for _ in sizes]
    scale = FIRST
    while True:
        docs = np.flatnonzero(sizes >= max(LEAST_WORDS, LEAST_PERIODS * scale if scale > FIRST else 0))
        if not len(docs):
            return [[(s, e - s, q) for (s, e), q in sorted(own.items(), key=lambda x: (x[0][0], x[1]))] for own in found]
        line, starts = _joined(words, bounds, docs)
        place, distance = occurrences(_residues(line), scale)
        owner = np.searchsorted(starts, place, side="right") - 1
        order = np.lexsort((place, distance, owner))
        place, distance, owner = place[order], distance[order], owner[order]
        cuts = np.flatnonzero((np.diff(owner, prepend=-2) != 0) | (np.diff(distance, prepend=-2) != 0)).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(place)] if cuts else [], strict=True):
            k = int(owner[a])
            if k >= 0:
                low = int(starts[k])
                _extend(line, low, low + int(sizes[docs[k]]), place[a:b].tolist(), int(distance[a]), min(scale, LONGEST_BLOCK), scale, found[docs[k]])
        scale *= 2


class Numbers(dict):
    """Numbers of words, from 0."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


Prepare = Callable[[int | None, list[bytes]], list[bytes]]


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those of a run after its first period, joined by a space."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words), bool)
    for start, length, period in runs:
        gone[start + period : start + length] = True
    return b" ".join([words[k] for k in np.flatnonzero(~gone).tolist()])


def _group(ids: list, texts: list[list[bytes]], names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    numbers = Numbers()
    words = np.fromiter((number for own in texts for number in map(numbers.__getitem__, own)), np.int32, sum(map(len, texts)))
    runs = find_runs(words, np.append(0, np.cumsum([*map(len, texts)])))
    columns = [
        pa.array(ids, kind),
        pa.array([len(own) for own in texts], pa.int64()),
        pa.array([[dict(zip(("start", "length", "period"), run, strict=True)) for run in own] for own in runs], _RUNS),
        pa.array([*map(_collapsed, texts, runs)], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names)


_RUNS = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))


def periodic_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", prepare: Prepare | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start and period) and collapsed (binary) of every text.

    Words are what white space of one byte parts. ``prepare`` may replace the words of a document (id, words) first.
    """
    names = ["doc_id", "n_words", "runs", "collapsed"]
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, held = [], [], 0
            for i, raw in zip(batch.column(0), batch.column(1), strict=True):
                words = raw.as_py().split()
                ids.append(i.as_py())
                texts.append(prepare(ids[-1], words) if prepare else words)
                held += len(texts[-1])
                if held >= GROUP_WORDS:
                    yield _group(ids, texts, names, batch.schema.field(0).type)
                    ids, texts, held = [], [], 0
            if ids:
                yield _group(ids, texts, names, batch.schema.field(0).type)

    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("raw"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary")


def with_planted_runs(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of the query: a tenth of the documents, by their id, get a run up to their end."""
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op11_block_periods(spark, sf_dir: str) -> DataFrame:
    """Digests of the runs of every document; a null doc_id has no run planted."""
    found = periodic_runs(table(spark, sf_dir, "documents"), prepare=with_planted_runs)
    # The greatest exponent: fractions compare by cross products.
    best = F.array_sort(
        "runs",
        lambda x, y: F.when(x["length"] * y["period"] != y["length"] * x["period"], F.signum(y["length"] * x["period"] - x["length"] * y["period"]).cast("int"))
        .when(x["start"] != y["start"], F.signum(x["start"] - y["start"]).cast("int"))
        .otherwise(F.signum(x["period"] - y["period"]).cast("int")),
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.withColumn("best", F.get(best, F.lit(0))).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{name}").alias(name) for name in ("start", "length", "period")],
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
