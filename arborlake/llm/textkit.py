"""Word and shingle kernels shared by the text operators (NumPy, no Spark).

A *word* is a maximal run of characters other than space and \\x09-\\x0D; folding
lower-cases A-Z only.  Both are exactly what ``bytes.lower().split()`` does on UTF-8
text, so no regular expression is needed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

SHINGLE_WORDS = 5
_MASK = (1 << 64) - 1
#: Odd 64-bit multipliers, one for each word position of an n-gram.
_POS = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) | 1 for k in range(1, 17)], dtype=np.uint64)


def fold_words(text: str | None) -> list[bytes]:
    """Words of a whole text with A-Z in lower case; none for a null text."""
    return text.encode("utf-8", "replace").lower().split() if text else []


class WordHash(dict):
    """word -> 64-bit hash; forgets everything once ``limit`` words are held, so memory is bounded."""

    def __init__(self, limit: int = 250_000) -> None:
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) >= self.limit:
            self.clear()
        if len(word) <= 64:
            self[word] = h
        return h


def word_hashes(words: list[bytes], cache: WordHash) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))


def mix64(h: np.ndarray) -> np.ndarray:
    """Final avalanche of a 64-bit hash, in place on a fresh array."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def ngram_hashes(w: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of n words, in order; empty if there are fewer words."""
    m = len(w) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    h = w[:m] * _POS[0]
    for k in range(1, n):
        h += (w[k : k + m] ^ (w[k : k + m] >> np.uint64(29))) * _POS[k]
    return mix64(h)


def shingle_set(text: str | None, cache: WordHash, n: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text: runs of n words, or the whole
    sequence when there are fewer words; empty without words."""
    words = fold_words(text)
    if not words:
        return np.empty(0, dtype=np.uint64)
    w = word_hashes(words, cache)
    if len(w) < n:
        return mix64(np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64))
    h = ngram_hashes(w, n)
    h.sort()
    keep = np.empty(len(h), dtype=bool)
    keep[0] = True
    np.not_equal(h[1:], h[:-1], out=keep[1:])
    return h[keep]


def set_key(s: np.ndarray) -> bytes:
    """128-bit digest of a shingle set; equal sets have equal keys."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


class MinHash:
    """``bands`` x ``rows`` multiply-shift minima over 32-bit mixes of the shingle hashes."""

    def __init__(self, bands: int, rows: int, seed: int = 1) -> None:
        self.bands, self.rows, self.k = bands, rows, bands * rows
        g = np.random.default_rng(seed)
        self.a = (g.integers(0, 1 << 32, self.k, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
        self.x = g.integers(0, 1 << 32, self.k, dtype=np.uint64).astype(np.uint32)
        self.band_pos = np.array([pow(0xC2B2AE3D27D4EB4F, 2 * r + 1, 1 << 64) | 1 for r in range(1, rows + 1)], dtype=np.uint64)
        self.band_seed = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def minima(self, s: np.ndarray, step: int = 8192) -> np.ndarray:
        """k minima of a non-empty shingle set, by blocks of ``step`` shingles."""
        v = (s >> np.uint64(32)).astype(np.uint32)
        out = None
        for i in range(0, len(v), step):
            block = v[i : i + step, None] ^ self.x
            block *= self.a
            block ^= block >> np.uint32(15)
            m = block.min(axis=0)
            out = m if out is None else np.minimum(out, m)
        return out

    def band_keys(self, minima: np.ndarray) -> np.ndarray:
        """One signed 64-bit bucket id for each band; the band's number is mixed in."""
        m = minima.reshape(self.bands, self.rows).astype(np.uint64)
        h = self.band_seed.copy()
        for r in range(self.rows):
            h += (m[:, r] + np.uint64(0x165667B19E3779F9)) * self.band_pos[r]
            h = mix64(h)
        return h.view(np.int64)
