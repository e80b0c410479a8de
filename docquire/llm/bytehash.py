"""Vectorised hashing of windows with numpy.

Polynomial hashes modulo 2**64 over values that are mixed already, such as names of words or of short runs of bytes: over plain letters
such sums can be made to collide. Prefix sums make the hash of any window a subtraction and a multiplication. All
bases derive from fixed seeds, so all workers agree.
"""

from __future__ import annotations

import numpy as np

U = np.uint64


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values."""
    x = x + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Roll:
    """A family of window hashes; ``seed`` picks one."""

    def __init__(self, seed: int):
        self.base = int(splitmix(np.array([seed], np.uint64))[0]) | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            for name, base in (("up", self.base), ("down", self.inverse)):
                p = getattr(self, name)
                while len(p) < n:
                    p = np.concatenate([p, p * U(pow(base, len(p), 1 << 64))])
                setattr(self, name, p)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums over 64-bit values, to be given to ``windows``."""
        self._powers(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.down[: len(values)], out=out[1:])
        return out

    def windows(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hashes of [start, end); equal content gives equal hashes wherever it stands."""
        return splitmix((prefix[end] - prefix[start]) * self.up[start] + (end - start).astype(np.uint64))


BYTE_ROLL, WORD_ROLL, SECOND_ROLL = Roll(11), Roll(23), Roll(37)


def word_windows(hashes: np.ndarray, size: int, roll: Roll = WORD_ROLL) -> np.ndarray:
    """Hash of each run of ``size`` consecutive words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(n)
    return roll.windows(roll.prefix(hashes), at, at + size)
