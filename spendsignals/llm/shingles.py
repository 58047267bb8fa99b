"""Word hashes and rolling word-shingle hashes with numpy; a word is hashed once per task while it recurs."""

from __future__ import annotations

import numpy as np
import xxhash

CACHE_WORDS = 500_000
_STEP = np.uint64(0x9E3779B97F4A7C15)     # an odd multiplier (2^64 over the golden ratio)


class _Cache(dict):
    def __missing__(self, word):
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class WordHasher:
    def __init__(self):
        self._cache = _Cache()

    def hashes(self, words: list) -> np.ndarray:
        """64-bit hash per word (bytes or str)."""
        if len(self._cache) > CACHE_WORDS:
            self._cache.clear()
        get = self._cache.__getitem__
        return np.fromiter(map(get, words), dtype=np.uint64, count=len(words))


class _RunCache(dict):
    def __init__(self, pattern):
        super().__init__()
        self.find = pattern.findall

    def __missing__(self, chunk):
        value = self[chunk] = b"".join([xxhash.xxh3_64_digest(w) for w in self.find(chunk)])
        return value


class TextHasher:
    """Hashes of the lower-cased runs of ``pattern`` (which match no white space) in a text. Texts are split at
    white space first, and what lies between is looked up: it recurs, so few pieces meet the pattern."""

    def __init__(self, pattern):
        self._cache = _RunCache(pattern)

    def hashes(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, dtype=np.uint64)
        if len(self._cache) > CACHE_WORDS:
            self._cache.clear()
        return np.frombuffer(b"".join(map(self._cache.__getitem__, text.lower().split())), dtype=">u8").astype(np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words, in order; none if there are fewer words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = words[:n].copy()
    for k in range(1, width):
        out *= _STEP
        out += words[k:k + n]
    return mix(out)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingles; of fewer than ``width`` words the whole sequence is one; none of no word."""
    if len(words) == 0:
        return np.empty(0, dtype=np.uint64)
    return np.unique(shingle_hashes(words, min(width, len(words))) + np.uint64(max(0, width - len(words))))
