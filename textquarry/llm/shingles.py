"""Hashes of word shingles, vectorised; used by the near-duplicate and fingerprint operators."""

from __future__ import annotations

import numpy as np
import xxhash

from textquarry.llm.bpe import Kept

STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers (the murmur3 finalizer)."""
    x = x ^ x >> np.uint64(33)
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


class Shingles:
    """64-bit hashes of a text's shingles of k words; a text with fewer words is one shingle, one without words has none.

    bytes.split() splits at exactly the six ASCII white-space characters, and
    bytes.lower() lower-cases A-Z alone.
    """

    def __init__(self, k: int, lower: bool = False, most_words: int = 600_000):
        self.k, self.lower = k, lower
        self.words = Kept(xxhash.xxh3_64_intdigest, most_words)

    def __call__(self, text: str) -> np.ndarray:
        raw = text.encode()
        words = (raw.lower() if self.lower else raw).split()
        n = len(words)
        if not n:
            return np.zeros(0, np.uint64)
        hashes = np.fromiter(map(self.words.__getitem__, words), np.uint64, n)
        width = min(self.k, n)
        out = np.full(n - width + 1, width, np.uint64)
        for j in range(width):
            out = mixed(out * STEP + hashes[j : n - width + 1 + j])
        return np.unique(out)
