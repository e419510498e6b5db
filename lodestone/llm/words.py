"""Words of a text and their hashes, a text at a time in numpy.

A word is a run of bytes other than ASCII white space; A-Z is lower-cased. UTF-8 never puts those bytes inside a
longer character, so bytes and code points give the same words.
"""

from __future__ import annotations

import numpy as np


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHasher:
    """64-bit hashes of words: each byte's random value times its position's random odd value, summed and mixed."""

    def __init__(self, positions: int = 256):
        self.values = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        lower = np.arange(256)
        lower[65:91] += 32
        self.values = self.values[lower]
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.values[self.space] = 0
        self._grow(positions)

    def _grow(self, n: int) -> None:
        self.places = mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)

    def __call__(self, data: bytes) -> np.ndarray:
        b = np.frombuffer(data, np.uint8)
        if not len(b):
            return np.zeros(0, np.uint64)
        space = self.space[b]
        begins = ~space
        begins[1:] &= space[:-1]
        starts = np.flatnonzero(begins)
        if not len(starts):
            return np.zeros(0, np.uint64)
        b = b[starts[0] :]
        starts -= starts[0]
        run = np.diff(starts, append=len(b))
        place = np.arange(len(b)) - np.repeat(starts, run)
        longest = int(run.max())
        if longest > len(self.places):
            self._grow(2 * longest)
        return mix64(np.add.reduceat(self.values[b] * self.places[place], starts))


def shingle_set(words: np.ndarray, n: int = 2) -> np.ndarray:
    """The sorted distinct hashes of all runs of n words; of a shorter text, of all its words as one."""
    if not len(words):
        return words
    m = max(1, len(words) - n + 1)
    h = np.full(m, min(n, len(words)), np.uint64)
    for i in range(min(n, len(words))):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + words[i : i + m])
    return np.unique(h)
