"""Word shingle sets of texts as sorted 64-bit fingerprints, and their MinHash sketches."""

from __future__ import annotations

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)
_SHIFT = np.uint64(29)
#: Words whose fingerprints a task remembers at a time.
MEMORY = 400_000


class Shingler:
    """Distinct runs of ``words`` words, A-Z in lower case; a shorter text is one run."""

    def __init__(self, words: int) -> None:
        self.words, self.known = words, {}

    def __getstate__(self):
        return {"words": self.words, "known": {}}

    def __call__(self, text: str) -> np.ndarray:
        import xxhash

        # bytes.lower and bytes.split know ASCII letters and the six ASCII white-space characters only
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > MEMORY:
            known.clear()
        try:
            found = [known[word] for word in words]
        except KeyError:
            for word in words:
                if word not in known:
                    known[word] = xxhash.xxh3_64_intdigest(word)
            found = [known[word] for word in words]
        prints = np.array(found, np.uint64)
        size = min(self.words, len(words))
        count = len(words) - size + 1
        found = np.full(count, size, np.uint64)
        for n in range(size):
            found = (found ^ prints[n:n + count]) * _MIX
            found ^= found >> _SHIFT
        return np.unique(found * _MIX2)


class Sketcher:
    """Minima of ``bands * rows`` universal hash functions a*x + b, and a hash of each band."""

    def __init__(self, bands: int, rows: int, seed: int) -> None:
        random = np.random.Generator(np.random.PCG64(seed))
        self.bands, self.rows = bands, rows
        self.a = random.integers(0, 1 << 32, bands * rows, np.uint32) | np.uint32(1)
        self.b = random.integers(0, 1 << 32, bands * rows, np.uint32)
        self.band = random.integers(0, 1 << 63, bands, np.uint64)

    def minima(self, prints: np.ndarray, step: int = 2048) -> np.ndarray:
        folded = (prints >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for n in range(0, len(folded), step):
            hashed = np.multiply.outer(self.a, folded[n:n + step])
            hashed += self.b[:, None]
            np.minimum(least, hashed.min(axis=1), out=least)
        return least

    def buckets(self, minima: np.ndarray) -> np.ndarray:
        found = self.band.copy()
        for column in minima.reshape(self.bands, self.rows).T:
            found = (found ^ column) * _MIX
            found ^= found >> _SHIFT
        return (found * _MIX2).view(np.int64)
