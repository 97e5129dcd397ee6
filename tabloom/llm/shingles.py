"""Word and shingle hashes of whole texts, computed over buffers of many documents at once."""

from __future__ import annotations

import numpy as np

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTES = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * U(2) + U(1)
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
_MIX = _RNG.integers(1, 2**63, 8, dtype=np.int64).astype(np.uint64) * U(2) + U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, as long as any buffer so far."""

    def __init__(self, base: int = _BASE):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, U)

    def upto(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << max(16, int(n - 1).bit_length())
            for name, b in (("up", self.base), ("down", self.inverse)):
                x = np.full(size, b, U)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))


POWERS = Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(texts: list[bytes | None]) -> list[np.ndarray]:
    """Hashes of the words of each text, A-Z lower-cased, words parted by space and the characters 9 to 13."""
    data = np.frombuffer(b" ".join(t or b"" for t in texts) + b" ", np.uint8)
    bounds = np.cumsum([len(t or b"") + 1 for t in texts])
    POWERS.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTES[_LOWER[data]] * POWERS.up[: len(data)], out=sums[1:])
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    h = mix((sums[ends] - sums[starts]) * POWERS.down[starts])
    cut = np.searchsorted(starts, bounds)
    return np.split(h, cut[:-1])


def shingle_set(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word shingles; of all its words as one where there are fewer."""
    n = len(words)
    if n == 0:
        return np.zeros(0, U)
    width = min(n, k)
    h = np.full(n - width + 1, U(width), U)
    for j in range(width):
        h = h * _MIX[7] + words[j : n - width + 1 + j] * _MIX[j]
    return np.unique(mix(h))
