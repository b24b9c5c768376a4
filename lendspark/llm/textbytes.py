"""Vectorised hashing of byte strings, for use inside tasks.

Prefix sums of bytes times powers of an odd base, modulo 2**64, give the hash
of any substring by one subtraction and one product, as odd bases have inverses.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
BASE2 = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n - 1), modulo 2**64."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(1 << max(16, int(n).bit_length()), base, dtype=np.uint64)
        known[0] = 1
        _POWERS[base] = known = np.multiply.accumulate(known)
    return known[:n]


class Prefix:
    """Hashes of substrings of one byte string."""

    def __init__(self, data: np.ndarray, base: int = BASE):
        self.inverse = pow(base, -1, 1 << 64)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(base, len(data)), out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the substrings from ``start`` to before ``end``."""
        n = len(self.sums)
        return mix((self.sums[end] - self.sums[start]) * powers(self.inverse, n)[start] + (end - start).astype(np.uint64))
