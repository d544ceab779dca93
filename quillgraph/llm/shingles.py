"""Word shingles of whole texts as 64-bit hashes, for use inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

WIDTH = 5
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Hash of a word; remembers a bounded number of them."""

    MOST = 500_000

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.MOST:
            self[word] = value
        return value


_HASHES = WordHashes()


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def roll(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words, in order."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    value = np.zeros(n, np.uint64)
    for k in range(width):
        value = (value ^ hashes[k : k + n]) * _MIX
        value ^= value >> np.uint64(29)
    return value


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Distinct shingles of the lower-cased, white-space separated words; a shorter text is one shingle of all its words."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(roll(word_hashes(words), min(width, len(words))))
