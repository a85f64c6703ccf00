"""Word shingles as sorted sets of 64-bit hashes, for use inside Arrow batches.

Words are the maximal runs without ASCII white space, after lower-casing A-Z.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Independent odd multipliers, one for each place of a word in its shingle.
_PLACES = np.random.default_rng(11).integers(0, 1 << 63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Distinct words whose hashes a worker remembers.
CACHE_WORDS = 200_000


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        self[word] = value
        return value


_WORDS = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str, size: int) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles; with fewer words, of the whole sequence; none without words."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(size, len(words))
    total = h[: len(h) - n + 1] * _PLACES[0]
    for i in range(1, n):
        total = total + h[i : len(h) - n + 1 + i] * _PLACES[i]
    return np.unique(_mix(total + np.uint64(n)))


def permutations(count: int, seed: int = 20) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, size=count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, size=count, dtype=np.uint64)


def minhash(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 32-bit minimum for each multiply-shift function."""
    out = np.full(len(a), 0xFFFFFFFF, dtype=np.uint64)
    for at in range(0, len(values), 4096):
        part = values[None, at : at + 4096] * a[:, None]
        part += b[:, None]
        np.minimum(out, part.min(axis=1) >> np.uint64(32), out=out)
    return out.astype(np.uint32)
