"""Words of many texts at once, as numpy arrays over one byte buffer."""

from __future__ import annotations

import numpy as np

# ASCII white space; odd multipliers of the polynomial hashes.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER_TABLE = np.arange(256, dtype=np.uint8)
LOWER_TABLE[0x41:0x5B] += 0x20
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buffer, first byte of each text): the texts with a space behind each."""
    buffer = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return buffer, np.cumsum(sizes) - sizes


def bounds(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each run of bytes that are no ASCII white space."""
    inside = np.zeros(len(buffer) + 1, bool)
    np.logical_not(SPACE[buffer], out=inside[1:])
    change = np.flatnonzero(inside[1:] != inside[:-1])
    if len(change) % 2:
        change = np.append(change, len(buffer))
    return change[0::2], change[1::2]


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Hasher:
    """64-bit hashes of byte ranges of a buffer, by prefix sums of a polynomial."""

    def __init__(self, which: int = 0):
        self.base = MULTIPLIERS[which]
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.zeros(0, np.uint64)

    def __call__(self, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(buffer) + 1
        if n > len(self.up):
            self.up, self.down = powers(self.base, n), powers(self.inverse, n)
        sums = np.zeros(n, np.uint64)
        np.cumsum((buffer + np.uint64(1)) * self.up[:n - 1], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
