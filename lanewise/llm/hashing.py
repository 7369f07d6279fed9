"""Word and window hashes of a text, 64 bits each."""

from __future__ import annotations

import numpy as np
import xxhash

# Fixed values of the splitmix64 mixer.
STEP = 0x9E3779B97F4A7C15
MULTIPLIERS = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def step(turn: int) -> np.uint64:
    return np.uint64(STEP * turn % (1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MULTIPLIERS[0]
    x = (x ^ (x >> np.uint64(27))) * MULTIPLIERS[1]
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` words, in order."""
    n = len(hashes) - width + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = mixed(hashes[:n])
    for i in range(1, width):
        out = mixed(out * step(1) + hashes[i : n + i])
    return out
