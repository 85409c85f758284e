"""Hashes of spans in byte and number arrays, with numpy."""

from __future__ import annotations

import numpy as np

M1, M2, M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


class Spans:
    """Hashes of any spans of an array of bytes or of 64-bit numbers.

    Windows of a power of two are hashed from their two halves; a span is hashed from the two windows, the longest that
    fit, at its start and at its end, and its length. All parts of equal spans are equal, so their hashes are; those of
    different ones are equal as seldom as random numbers of 64 bits, also in texts of much structure, as between any two
    levels the halves are mixed (sums of powers modulo 2^64 are not safe: two different Thue-Morse words of 1,024 bytes
    have the same one). Levels are kept one at a time.
    """

    def __init__(self, values: np.ndarray) -> None:
        self.n = len(values)
        if values.dtype == np.uint8:
            # The first level has the 8 bytes from each place on; beyond the end there are zeros.
            padded = np.concatenate((values, np.zeros(16, np.uint8)))
            self.raw = np.empty(self.n + 8, np.uint64)
            for k in range(8):
                part = self.raw[k::8]
                part[:] = np.frombuffer(padded.data, "<u8", len(part), k)
            self.first, self.base = 3, None
        else:
            self.raw, self.first, self.base = None, 0, mixed(values.astype(np.uint64) + M3)
        self.level, self.now = -1, np.zeros(0, np.uint64)

    def windows(self, level: int) -> np.ndarray:
        """The hash of the 2^level values from each place on."""
        if level < self.level or self.level < 0:
            self.level, self.now = self.first, (mixed(self.raw[: max(self.n - 7, 0)] + M3) if self.base is None else self.base)
        while self.level < level:
            half = 1 << self.level
            x = self.now[: max(len(self.now) - half, 0)] * M1
            x += self.now[half:]
            x ^= x >> np.uint64(29)
            self.level, self.now = self.level + 1, x
        return self.now

    def _both(self, a: np.ndarray, b: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mixed(a * M3 + b + np.asarray(length, np.uint64) * M2)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        length = ends - starts
        level = np.frexp(length.astype(np.float64))[1] - 1  # floor of the binary logarithm
        out = np.zeros(len(starts), np.uint64)
        for j in np.unique(level).tolist():
            at = np.flatnonzero(level == j)
            s, e, n = starts[at], ends[at], length[at]
            if j < self.first:  # short: the bytes themselves
                part = self.raw[s] & ((np.uint64(1) << (np.uint64(8) * n.astype(np.uint64))) - np.uint64(1))
                out[at] = self._both(part, part, n)
            else:
                h = self.windows(j)
                out[at] = self._both(h[s], h[e - (1 << j)], n)
        return out

    def rolling(self, k: int) -> np.ndarray:
        """The hash of every window of k values (8 at least, of bytes)."""
        if self.n < k:
            return np.zeros(0, np.uint64)
        j = k.bit_length() - 1
        h, n = self.windows(j), self.n - k + 1
        return self._both(h[:n], h[k - (1 << j) :][:n], k)
