"""Vectorised 64-bit hashes of words and of stretches of characters (wrap-around arithmetic on uint64)."""

from __future__ import annotations

import numpy as np

# The multipliers of the public splitmix64 finaliser, and an odd base for polynomials.
MIX_1, MIX_2, GAMMA = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15
BASE = 0x2545F4914F6CDD1D


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit."""
    x = x + np.uint64(GAMMA)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_2)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of BASE and of its inverse, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            inverse = pow(BASE, -1, 1 << 64)
            grow = lambda b: np.cumprod(np.r_[np.uint64(1), np.full(size, b, np.uint64)], dtype=np.uint64)
            self.up, self.down = grow(BASE), grow(inverse)
        return self.up, self.down


POWERS = Powers()


def prefix_hash(symbols: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial of a sequence of uint64 symbols, with a leading zero."""
    up, _ = POWERS.of(len(symbols) + 1)
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(mix(symbols) * up[: len(symbols)], dtype=np.uint64, out=out[1:])
    return out


def stretch_hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the stretches [start, stop) that depend only on their symbols."""
    _, down = POWERS.of(len(prefix))
    return mix((prefix[stop] - prefix[start]) * down[start])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by the minima of blocks from either end."""
    n = len(x)
    padded = np.r_[x, np.full(-n % width, np.iinfo(np.uint64).max, np.uint64)].reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
