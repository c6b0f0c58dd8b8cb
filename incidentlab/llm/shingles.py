"""Hashed word shingles."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORDS = 5
_WORD = re.compile(r"\w+")
CACHE_WORDS = 300_000
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))  # fixed values: a 64-bit finaliser


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over 64 bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class Shingler:
    """64-bit hashes of the runs of ``size`` words (letters, digits and underscores, in lower case) of a text.

    A text of fewer words is one shingle of all its words where ``short``, else
    has none; a text without words has none.
    """

    def __init__(self, size: int = WORDS, short: bool = True):
        self.size, self.short, self.words = size, short, {}

    def word_hashes(self, text: str) -> np.ndarray:
        found, known = _WORD.findall(text.lower()), self.words
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in set(found).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))

    def all(self, text: str) -> np.ndarray:
        """One hash for each place, in order, repeats included."""
        words = self.word_hashes(text)
        n = len(words) - self.size + 1
        if n < 1:
            if not len(words) or not self.short:
                return np.empty(0, np.uint64)
            n, size = 1, len(words)
        else:
            size = self.size
        out = np.full(n, size, np.uint64)
        for k in range(size):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[k:k + n])
        return out
