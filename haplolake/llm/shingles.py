"""Hashed sets of word shingles."""

from __future__ import annotations

import numpy as np
import xxhash

from haplolake.llm.common import Remember

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (one-to-one)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_hash = Remember(xxhash.xxh3_64_intdigest, 150_000)


def words_of(text: str | None) -> list[bytes]:
    """Words between the six ASCII spaces, A to Z folded; bytes.split() and bytes.lower() mean just that."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's ``size``-word shingles.

    Fewer words make one shingle of all of them; NULL, empty and blank texts have none.
    """
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.array([_hash[w] if len(w) <= 64 else xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    k = min(size, len(h))
    n = len(h) - k + 1
    joined = h[:n].copy()
    for j in range(1, k):
        joined = joined * _FACTOR + h[j : j + n]
    return np.unique(mix(joined))
