"""Byte-level BPE: texts to token ids by a rank queue, and ids back to bytes.

The pattern of the vocabulary parts a text into pre-tokens. All pre-tokens that a task hasn't met yet are merged together:
their bytes lie in one linked list, in which no link crosses a pre-token, and each neighbouring pair that is a token
waits in the bucket of its rank. A hierarchical bitmap over the buckets (64 children a word) gives the lowest rank by
find-first-set; the live entries of that bucket merge at once, entries whose pair has gone meanwhile are skipped, and the
pairs that arise wait in their own buckets. A pre-token of any length takes time near linear in its length, as each
merge adds two entries at most. Ids are the ranks of the file.

``encode_texts`` gives doc_id and ids, ``decode_ids`` gives their bytes. Both are maps over partitions: nothing is shuffled,
and a lost task is computed again. What a worker holds is bounded by ``SLICE_BYTES``, ``ROUND_BYTES`` and ``MEMORY_PIECES``,
save for one single longer text.

Defined cases: a null or empty text has no ids; a null doc_id is kept; repeated rows are encoded each; names of special tokens
are ordinary text; bytes that aren't UTF-8 count as U+FFFD; an empty table gives an empty result; further columns are
ignored. A file that lacks one of the 256 bytes is an error.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from quillgraph.llm.common import table

#: Bytes of text whose ids are put out together.
SLICE_BYTES = 1 << 21
#: Bytes of new pre-tokens merged in one go.
ROUND_BYTES = 1 << 20
#: Stretches that are split into pre-tokens at a time.
SPLIT_STRETCHES = 1 << 15
#: Different stretches of text, and pre-tokens, that a worker remembers.
MEMORY_PIECES = 300_000


def ranks_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class RankQueue:
    """Positions by rank; the lowest rank that has any is found through a bitmap of bitmaps."""

    def __init__(self, n_ranks: int):
        self.levels = []
        while True:
            n_ranks = (n_ranks + 63) // 64
            self.levels.append([0] * n_ranks)
            if n_ranks <= 1:
                break
        self.single: dict[int, list[int]] = {}
        self.many: dict[int, list[np.ndarray]] = {}

    def _mark(self, rank: int) -> None:
        for words in self.levels:
            word, bit = rank >> 6, 1 << (rank & 63)
            if words[word] & bit:
                return
            words[word] |= bit
            rank = word

    def _unmark(self, rank: int) -> None:
        for words in self.levels:
            word = rank >> 6
            words[word] &= ~(1 << (rank & 63))
            if words[word]:
                return
            rank = word

    def push(self, positions: np.ndarray, ranks: np.ndarray) -> None:
        """Positions whose rank is negative have no pair."""
        if len(positions) <= 24:
            for position, rank in zip(positions.tolist(), ranks.tolist(), strict=True):
                if rank >= 0:
                    self.single.setdefault(rank, []).append(position)
                    self._mark(rank)
            return
        known = ranks >= 0
        positions, ranks = positions[known], ranks[known]
        order = np.argsort(ranks, kind="stable")
        positions, ranks = positions[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks, prepend=-1))
        for rank, own in zip(ranks[cuts].tolist(), np.split(positions, cuts[1:]) if len(cuts) else [], strict=True):
            self.many.setdefault(rank, []).append(own)
            self._mark(rank)

    def first(self) -> int:
        """The lowest rank with positions, or -1."""
        rank = 0
        for words in reversed(self.levels):
            word = words[rank]
            if not word:
                return -1
            rank = (rank << 6) | ((word & -word).bit_length() - 1)
        return rank

    def take(self, rank: int) -> np.ndarray:
        """All positions of a rank, in ascending order."""
        self._unmark(rank)
        found = self.many.pop(rank, [])
        if single := self.single.pop(rank, None):
            found.append(np.array(single, np.int32))
        return np.sort(found[0] if len(found) == 1 else np.concatenate(found))


class Ranks:
    """The tables of one rank file."""

    _known: dict[str, Ranks] = {}

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        if lacking := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the rank file lacks {len(lacking)} of the 256 bytes")
        self.size = max(ranks.values()) + 1
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs, early = {}, np.zeros(self.size, bool)
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a * (self.size + 1) + b] = rank
                    early[[x for x in (a, b) if rank < x]] = True
        keys = np.array(sorted(pairs), np.int64)
        self.keys = np.append(keys, np.iinfo(np.int64).max)
        self.values = np.array([*map(pairs.get, keys.tolist()), -1], np.int32)
        #: Tokens whose arrival can make a pair of lower rank than their own.
        self.early = early
        names: list[bytes] = [b""] * self.size
        for token, rank in ranks.items():
            names[rank] = token
        self.lengths = np.array([*map(len, names)], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(names), np.uint8)

    @classmethod
    def of(cls, path: str) -> Ranks:
        """One per worker process."""
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids put together, or -1."""
        wanted = left.astype(np.int64) * (self.size + 1) + right
        at = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[at] == wanted, self.values[at], -1)

    def merge(self, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens one after the other, and how many each has. ``flat``: their bytes; no length is 0."""
        n, nobody = len(flat), self.size
        ends = np.cumsum(lengths)
        owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        ids = np.append(self.byte_ids[flat], np.int32(nobody))
        follow, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        follow[ends - 1] = n
        before[ends - lengths] = n
        held = self.pair_ranks(ids[:n], ids[follow[:n]])
        queue = RankQueue(self.size)
        queue.push(np.arange(n, dtype=np.int32), held)
        while (rank := queue.first()) >= 0:
            at = queue.take(rank)
            at = at[held[at] == rank]  # the rest is stale
            if len(at) > 1:
                merged = np.ones(len(at), bool)
                linked = follow[at[:-1]] == at[1:]
                if linked.any():
                    # Of pairs that overlap in a row, the first, third, fifth and so on merge.
                    index = np.arange(len(at))
                    chain = np.maximum.accumulate(np.where(np.append(False, linked), 0, index))
                    merged = (index - chain) % 2 == 0
                if self.early[rank]:
                    # What follows, in its pre-token, a merge that makes a lower pair waits until that has merged.
                    own = at[merged]
                    after = follow[follow[own]]
                    left = np.where(np.append(False, after[:-1] == own[1:]), rank, ids[before[own]])
                    lower = [self.pair_ranks(*pair) for pair in ((left, np.int64(rank)), (np.full(len(own), rank), ids[after]))]
                    low = own[np.logical_or(*((0 <= x) & (x < rank) for x in lower))]
                    if len(low):
                        place = np.searchsorted(low, at)
                        waits = (place > 0) & (owner[low[place - 1]] == owner[at])
                        queue.push(at[waits], np.full(np.count_nonzero(waits), rank))
                        merged &= ~waits
                at = at[merged]
            if not len(at):
                continue
            right = follow[at]
            after = follow[right]
            ids[at], ids[right], held[right] = rank, nobody, -1
            follow[at], before[after] = after, at
            left = before[at]
            changed = np.concatenate([at, left[(left < n) & (left != np.append(n, at[:-1]))]])
            held[changed] = now = self.pair_ranks(ids[changed], ids[follow[changed]])
            queue.push(changed, now)
        alive = ids[:n] < nobody
        return ids[:n][alive], np.bincount(owner[alive], minlength=len(lengths))

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts one after the other, and how many each has. ``counts``: ids of each text."""
        lengths = self.lengths[ids]
        ends = np.append(0, np.cumsum(lengths))
        flat = self.bytes[np.repeat(self.starts[ids] - ends[:-1], lengths) + np.arange(ends[-1])]
        return flat, np.diff(ends[np.append(0, np.cumsum(counts))])


class Numbers(dict):
    """Numbers of strings; one that is new gets the next number and waits."""

    def __init__(self) -> None:
        super().__init__()
        self.waiting: list = []

    def __missing__(self, key) -> int:
        number = self[key] = len(self)
        self.waiting.append(key)
        return number

    def take(self) -> list:
        waiting, self.waiting = self.waiting, []
        return waiting

    def forget(self, keep: int) -> None:
        """Those met first are the common ones: they stay."""
        for key in list(islice(self, keep, None)):
            del self[key]


class Lists:
    """Lists of ids by number, in one array."""

    def __init__(self) -> None:
        self.flat, self.counts, self.starts = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, flats: list[np.ndarray], counts: list[np.ndarray]) -> None:
        self.flat, self.counts = np.concatenate([self.flat, *flats]), np.concatenate([self.counts, *counts])
        self.starts = np.cumsum(self.counts) - self.counts

    def forget(self, keep: int) -> None:
        self.counts, self.starts = self.counts[:keep], self.starts[:keep]
        self.flat = self.flat[: self.counts.sum()]

    def join(self, numbers: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of all numbers one after the other; how many ids each run of ``sizes`` numbers has."""
        many = self.counts[numbers]
        ends = _offsets(many)
        flat = self.flat[np.repeat(self.starts[numbers] - ends[:-1], many) + np.arange(ends[-1])]
        return flat, np.diff(ends[_offsets(sizes)])


#: White space of one byte, and first bytes of characters that are no white space.
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_SOLID = (np.arange(256) < 128) & ~_BLANK | (np.arange(256) >= 0xC4) & ~np.isin(np.arange(256), [0xE1, 0xE2, 0xE3])


class Encoder:
    """Ids of whole texts; remembers the ids of stretches and of their pre-tokens.

    A pre-token always ends before a space that no white space follows, and on both sides of a line break between two
    characters that are none. Texts are cut there, and the pattern is applied once to each different stretch.
    """

    _known: dict[tuple[str, str], Encoder] = {}

    def __init__(self, ranks: Ranks, pattern: str):
        import regex

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.stretches, self.stretch_ids = Numbers(), Lists()
        self.pieces, self.piece_ids = Numbers(), Lists()

    @classmethod
    def of(cls, path: str, pattern: str) -> Encoder:
        """One per worker process, so that later tasks find what earlier ones met."""
        if (path, pattern) not in cls._known:
            cls._known[path, pattern] = cls(Ranks.of(path), pattern)
        return cls._known[path, pattern]

    def _learn_pieces(self) -> None:
        waiting = [piece.encode() for piece in self.pieces.take()]
        sizes = np.array([*map(len, waiting)], np.int64)
        rounds = np.flatnonzero(np.diff(np.cumsum(sizes) // ROUND_BYTES)) + 1
        flats, counts = [], []
        for a, b in zip([0, *rounds.tolist()], [*rounds.tolist(), len(waiting)], strict=True):
            flat, many = self.ranks.merge(np.frombuffer(b"".join(waiting[a:b]), np.uint8), sizes[a:b])
            flats.append(flat)
            counts.append(many)
        self.piece_ids.add(flats, counts)

    def _learn(self) -> None:
        waiting, sizes, numbers = self.stretches.take(), [], []
        for at in range(0, len(waiting), SPLIT_STRETCHES):
            found = [self.pattern.findall(raw.decode("utf-8", "replace")) for raw in waiting[at : at + SPLIT_STRETCHES]]
            sizes.append(np.array([*map(len, found)], np.int64))
            numbers.append(np.array([self.pieces[piece] for pieces in found for piece in pieces], np.int32))
        if self.pieces.waiting:
            self._learn_pieces()
        flat, many = self.piece_ids.join(np.concatenate(numbers), np.concatenate(sizes))
        self.stretch_ids.add([flat], [many])

    def number(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the stretches of all texts, and how many each text has. ``raw``: their bytes, ``offsets``: where they begin, and the end."""
        if not len(raw):
            return np.empty(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        edges = offsets[offsets < len(raw)]
        solid = _SOLID[raw]
        cut = np.zeros(len(raw), bool)
        cut[:-1] = (raw[:-1] == 32) & solid[1:]
        cut[edges[edges > 0] - 1] = False  # what follows is another text
        line = (raw[1:] == 10) & solid[:-1] & (raw[:-1] < 128)
        cut[1:] |= line
        cut[2:] |= line[:-1] & solid[2:]
        cut[edges] = True
        starts = np.flatnonzero(cut)
        bounds = pa.py_buffer(np.append(starts, len(raw)).astype(np.int32))
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, bounds, pa.py_buffer(raw)]).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        numbers = np.fromiter(map(self.stretches.__getitem__, distinct), np.int32, len(distinct))
        return numbers[coded.indices.to_numpy()], np.diff(np.searchsorted(starts, offsets))

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For runs of texts: the first, the one after the last, their ids one after the other, and how many each has."""
        for numbers, lists in ((self.stretches, self.stretch_ids), (self.pieces, self.piece_ids)):
            if len(numbers) > MEMORY_PIECES:
                numbers.forget(MEMORY_PIECES // 2)
                lists.forget(MEMORY_PIECES // 2)
        slices = list(_slices(np.diff(offsets)))
        numbered = [self.number(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices]
        if self.stretches.waiting:
            self._learn()
        for k, (a, b) in enumerate(slices):
            own, numbered[k] = numbered[k], None
            yield a, b, *self.stretch_ids.join(*own)


def _offsets(counts: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(counts))


def _bounds(column: pa.Array) -> np.ndarray:
    """Where the values of a column of bytes begin in its buffer, and the end."""
    return np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)


def _binary(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Values of so many bytes each."""
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(_offsets(counts).astype(np.int32)), pa.py_buffer(flat)])


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of ``SLICE_BYTES`` or so."""
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE_BYTES)) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)], strict=True)


def encode_texts(
    docs: DataFrame, ranks: str | None = None, pattern: str | None = None, text: str = "text", doc_id: str = "doc_id", decoded: bool = False
) -> DataFrame:
    """doc_id and ids (array of int) of every text. ``ranks``: path of a rank file; ``pattern``: what parts a text into pre-tokens.

    ``decoded`` adds what ``decode_ids`` finds, in the same pass.
    """
    ranks, pattern = ranks or ranks_path(), pattern or split_pattern()
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["doc_id", "ids", "decoded"] if decoded else ["doc_id", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(ranks, pattern)
        for batch in batches:
            bounds = _bounds(batch.column(1))
            raw = np.frombuffer(batch.column(1).buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
            for a, b, ids, counts in encoder.encode(raw, bounds - bounds[0]):
                lists = pa.ListArray.from_arrays(pa.array(_offsets(counts), pa.int32()), pa.array(ids, pa.int32()))
                columns = [batch.column(0).slice(a, b - a), lists]
                yield pa.RecordBatch.from_arrays([*columns, _binary(*encoder.ranks.decode(ids, counts))] if decoded else columns, names)

    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.select(F.col(doc_id).alias("doc_id"), body.alias("raw")).mapInArrow(run, f"doc_id {kind}, ids array<int>" + ", decoded binary" * decoded)


def decode_ids(encoded: DataFrame, ranks: str | None = None, ids: str = "ids") -> DataFrame:
    """All columns, and ``decoded`` (in place of any such column): the bytes of the ids; null ids have none. An id that the file lacks is an error."""
    ranks = ranks or ranks_path()
    encoded = encoded.drop("decoded")
    schema = StructType([*encoded.schema.fields, StructField("decoded", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Ranks.of(ranks)
        place = encoded_columns.index(ids)
        for batch in batches:
            lists = batch.column(place)
            for a, b in _slices(4 * lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)):
                part = batch.slice(a, b - a)
                own = part.column(place)
                sizes = own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                raw = _binary(*tables.decode(own.flatten().to_numpy(zero_copy_only=False), sizes))
                yield pa.RecordBatch.from_arrays([*part.columns, raw], [*batch.schema.names, "decoded"])

    encoded_columns = encoded.columns
    return encoded.mapInArrow(run, schema)


def op12_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded bytes of every document."""
    coded = encode_texts(table(spark, sf_dir, "documents"), decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
