"""Word shingles of whole texts as sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of ``width`` words. A-Z are lower-cased, words are runs without
    ASCII white space; fewer words than that make one shingle of all; no word makes the empty set."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    w = min(width, n)
    m = n - w + 1
    acc = h[:m].copy()
    for j in range(1, w):
        acc *= _STEP
        acc += h[j : j + m]
    acc += np.uint64(w)
    acc ^= acc >> np.uint64(31)
    acc *= _MIX
    acc ^= acc >> np.uint64(29)
    return np.unique(acc)
