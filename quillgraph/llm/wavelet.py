"""Wavelet matrix of a token sequence: one bit-plane per bit of an id, with rank and select support.

A plane holds one bit of each id, most significant plane first; between planes the ids are stably parted into those
with a 0 bit and those with a 1 bit. ``dump`` gives one byte string: for each plane the number of ones before every
``SUPERBLOCK`` bits, and its bits compressed in pieces of ``PIECE`` bits. ``load`` reads the counts; a piece is
decompressed when a query meets it, so access, count and locate touch a few pieces of a shard and never the whole.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

MAGIC = b"WMX2"
#: Bits between two stored rank counts, and bits of a compressed piece (a multiple).
SUPERBLOCK = 4096
PIECE = 1 << 19


def _part(values: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return np.concatenate([np.compress(~mask, values), np.compress(mask, values)])


def _counts(plane: np.ndarray) -> np.ndarray:
    """Ones before each superblock, and at the end."""
    step = SUPERBLOCK // 8
    whole = len(plane) // step * step
    ones = np.bitwise_count(plane[:whole]).reshape(-1, step).sum(axis=1, dtype=np.uint32)
    rest = [int(np.bitwise_count(plane[whole:]).sum())] if whole < len(plane) else []
    return np.concatenate([[0], np.cumsum(np.concatenate([ones, rest]), dtype=np.uint32)]).astype("<u4")


def dump(ids: np.ndarray, bits: int) -> bytes:
    """Rank counts and compressed planes of unsigned ids below 2 ** bits."""
    n, level = len(ids), np.asarray(ids)
    press = zstandard.ZstdCompressor(level=1)
    head, body = [MAGIC, struct.pack("<BQ", bits, n)], []
    for b in range(bits - 1, -1, -1):
        mask = (level & level.dtype.type(1 << b)).astype(bool)
        plane = np.packbits(mask, bitorder="little")
        pieces = [press.compress(plane[k : k + PIECE // 8].tobytes()) for k in range(0, len(plane), PIECE // 8)]
        head += [_counts(plane).tobytes(), struct.pack(f"<{len(pieces)}I", *map(len, pieces))]
        body += pieces
        if b:
            level = _part(level, mask)
    return b"".join(head + body)


class WaveletMatrix:
    """Rank and select run on stored counts and single pieces of the packed planes."""

    def __init__(self, blob: bytes, bits: int, n: int, counts: list[np.ndarray], places: list[list[tuple[int, int]]]):
        self.blob, self.bits, self.n, self.counts, self.places = blob, bits, n, counts, places
        self._press = zstandard.ZstdDecompressor()
        self._pieces: dict[tuple[int, int], np.ndarray] = {}

    @classmethod
    def load(cls, blob: bytes) -> WaveletMatrix:
        if blob[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        bits, n = struct.unpack_from("<BQ", blob, 4)
        blocks, pieces = -(-n // SUPERBLOCK) + 1, -(-n // PIECE)
        at, counts, sizes = 13, [], []
        for _ in range(bits):
            counts.append(np.frombuffer(blob, "<u4", blocks, at))
            sizes.append(struct.unpack_from(f"<{pieces}I", blob, at + 4 * blocks))
            at += 4 * blocks + 4 * pieces
        places = []
        for own in sizes:
            ends = at + np.cumsum(own, dtype=np.int64) if own else np.empty(0, np.int64)
            places.append([(int(e) - s, int(e)) for e, s in zip(ends, own, strict=True)])
            at = int(ends[-1]) if own else at
        return cls(blob, bits, n, counts, places)

    def _raw(self, level: int, piece: int) -> np.ndarray:
        a, b = self.places[level][piece]
        return np.frombuffer(self._press.decompress(self.blob[a:b]), np.uint8)

    def _bytes(self, level: int, piece: int) -> np.ndarray:
        if (level, piece) not in self._pieces:
            if len(self._pieces) >= 4 * self.bits:
                del self._pieces[next(iter(self._pieces))]
            self._pieces[level, piece] = self._raw(level, piece)
        return self._pieces[level, piece]

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block = i // SUPERBLOCK
        found = int(self.counts[level][block])
        if i % SUPERBLOCK:
            own, start = self._bytes(level, i // PIECE), block * SUPERBLOCK % PIECE // 8
            end = i % PIECE
            found += int(np.bitwise_count(own[start : end // 8]).sum())
            found += int(own[end // 8] & ((1 << end % 8) - 1)).bit_count() if end % 8 else 0
        return found

    def _zeros(self, level: int) -> int:
        return self.n - int(self.counts[level][-1])

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            bit = int(self._bytes(level, i // PIECE)[i % PIECE // 8]) >> (i % 8) & 1
            ones = self._ones(level, i)
            value, i = value << 1 | bit, self._zeros(level) + ones if bit else i - ones
        return value

    def _range(self, value: int, i: int, j: int) -> tuple[int, int]:
        if value >> self.bits:
            return 0, 0
        for level in range(self.bits):
            a, b = self._ones(level, i), self._ones(level, j)
            i, j = (self._zeros(level) + a, self._zeros(level) + b) if value >> (self.bits - 1 - level) & 1 else (i - a, j - b)
        return i, j

    def count(self, value: int, i: int = 0, j: int | None = None) -> int:
        """How often an id occurs in positions i to j - 1 (rank)."""
        a, b = self._range(value, i, self.n if j is None else j)
        return b - a

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) bit of a kind in a plane: its superblock by the counts, then its place in it."""
        ones = self.counts[level].astype(np.int64)
        ends = np.minimum(np.arange(len(ones)) * SUPERBLOCK, self.n)
        before = ones if bit else ends - ones
        block = int(np.searchsorted(before, k, "right")) - 1
        start = block * SUPERBLOCK
        own = self._bytes(level, start // PIECE)[start % PIECE // 8 :][: SUPERBLOCK // 8]
        flags = np.unpackbits(own, bitorder="little", count=min(SUPERBLOCK, self.n - start))
        return start + int(np.flatnonzero(flags == bit)[k - int(before[block])])

    def locate(self, value: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of an id (select)."""
        start, end = self._range(value, 0, self.n)
        if not 0 <= k < end - start:
            raise IndexError(k)
        at = start + k
        for level in range(self.bits - 1, -1, -1):
            bit = value >> (self.bits - 1 - level) & 1
            at = self._select_bit(level, bit, at - (self._zeros(level) if bit else 0))
        return at

    def decode(self) -> np.ndarray:
        """All ids in order: planes are undone from the last to the first."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        values = np.zeros(self.n, kind)
        for k in range(self.bits - 1, -1, -1):
            plane = [self._raw(k, p) for p in range(len(self.places[k]))]
            mask = np.unpackbits(np.concatenate(plane) if plane else np.empty(0, np.uint8), count=self.n, bitorder="little").view(bool)
            zeros = self._zeros(k)
            before = np.empty_like(values)
            before[np.flatnonzero(~mask)] = values[:zeros]
            before[np.flatnonzero(mask)] = values[zeros:]
            before |= mask.astype(kind) << kind(self.bits - 1 - k)
            values = before
        return values
