"""Hashes of all windows of a byte string, for every wanted length from the same prefix sums.

The hash of a window does not depend on where it stands, so equal byte strings hash alike in every text and task.
"""

import numpy as np

_STEP = np.uint64(0xD1342543DE82EF95)
_BACK = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_BYTES = np.random.default_rng(4711).integers(1, 1 << 62, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def scatter(x: np.ndarray) -> np.ndarray:
    """Spread each bit of a 64-bit value over all others."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Prefix sums of a byte string; `windows` gives hashes of windows of any length in constant time each."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        powers = np.full(n + 1, _STEP)
        powers[0] = 1
        np.cumprod(powers, out=powers)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[data] * powers[:-1], out=self.sums[1:])
        powers[:] = _BACK
        powers[0] = 1
        self.back = np.cumprod(powers)

    def windows(self, first: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Hash of the bytes [first, first + size), its length mixed in."""
        value = (self.sums[first + size] - self.sums[first]) * self.back[first]
        return scatter(value + np.asarray(size).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
