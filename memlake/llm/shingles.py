"""Word shingles and MinHash signatures, vectorised with numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def ascii_lower_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 text with A-Z lower-cased; null has none.

    ``bytes.lower`` and ``bytes.split`` act on ASCII only, which is what the pattern asks for.
    """
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct 64-bit fingerprints of the ``width``-word shingles.

    Fewer words than ``width`` make one shingle of the whole sequence; no words, none. The
    number of words is mixed in, so a short sequence never equals a full shingle.
    """
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    if n < width:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=n)], np.uint64)
    out = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        out = _mix(out + h[i : n - width + 1 + i] * _MULT[i % 3] + np.uint64(i + 1))
    return np.unique(out)


class MinHash:
    """``bands * rows`` minima of the shingle fingerprints under multiply-add permutations."""

    def __init__(self, bands: int, rows: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self._a = (rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) << np.uint64(1) | np.uint64(1))[:, None]
        self._b = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)[:, None]

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """uint32 minima; blocks of shingles keep the work matrix small for very long texts."""
        best = np.full(len(self._a), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(shingles), 4096):
            np.minimum(best, (self._a * shingles[None, i : i + 4096] + self._b).min(axis=1), out=best)
        return (best >> np.uint64(32)).astype(np.uint32)

    def band_keys(self, signature: np.ndarray) -> np.ndarray:
        """One signed 64-bit key per band, the band's number mixed in."""
        s = signature.astype(np.uint64).reshape(self.bands, self.rows)
        out = np.arange(self.bands, dtype=np.uint64)
        for i in range(self.rows):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + s[:, i] + np.uint64(1))
        return out.view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Intersection and union size of two sorted distinct arrays."""
    inter = len(np.intersect1d(a, b, assume_unique=True))
    return inter, len(a) + len(b) - inter
