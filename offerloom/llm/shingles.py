"""Sets of hashed word shingles, made inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Word hashes remembered by a task.
_MOST_WORDS = 100_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MOST_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``k`` words, A-Z lower-cased.

    Words are parted by space and the five controls from tab to carriage return. A text with fewer
    words has its whole sequence as one shingle; one without words has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=k)], dtype=np.uint64)
    hashed = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = len(words) - k + 1
    runs = hashed[:n]
    for j in range(1, k):
        runs = _mix(runs * _MIX + hashed[j : n + j])
    return np.unique(runs)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0


def bitmap(values: np.ndarray) -> bytes:
    """Which hash columns a set has: at least four columns a value, a power of two."""
    width = max(64, 1 << int(4 * len(values) - 1).bit_length())
    bits = np.zeros(width, dtype=np.uint8)
    bits[(values & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def fold(bits: bytes, size: int) -> np.ndarray:
    """A bitmap over fewer columns, given in bytes: halves are joined by or."""
    out = np.frombuffer(bits, dtype=np.uint8)
    while len(out) > size:
        half = len(out) // 2
        out = out[:half] | out[half:]
    return out


def most_shared(n: int, bits: bytes, other: bytes) -> int:
    """Upper bound on how many of a set's ``n`` values another set, or union of sets, can have.

    A column that only the first has holds at least one value that the other lacks.
    """
    size = min(len(bits), len(other))
    lacking = fold(bits, size) & ~fold(other, size)
    return n - int(np.bitwise_count(lacking).sum())
