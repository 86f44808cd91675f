"""Hashes of words and word shingles, the same on every executor."""

from __future__ import annotations

import numpy as np
import xxhash

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Words whose hashes a worker remembers.
REMEMBER = 100_000


class WordHashes(dict):
    """64-bit hash of each word, computed once."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > REMEMBER:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _A
    return x ^ (x >> np.uint64(31))


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each window of so many words; none if there are fewer."""
    n = len(words) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * _A + words[k : k + n]
    return mix(out)


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """The distinct shingles, ascending; all words as one where there are fewer; none without words."""
    if not len(words):
        return words
    if len(words) < size:  # a hash that no full shingle has by design
        return mix(windows(words, len(words)) + np.uint64(len(words)))
    return np.unique(windows(words, size))
