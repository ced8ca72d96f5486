"""Word hashes, window hashes and packed integer arrays for the operators on word windows.

Many small rows cost more than they hold. These operators send blocks instead: arrays of integers,
one byte plane after the other, compressed.
"""

from __future__ import annotations

import numpy as np
import xxhash
import zstandard

#: Odd 64-bit multipliers from a fixed seed, one for each word of a window.
MULTIPLIERS = np.random.Generator(np.random.PCG64(7)).integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def window_hashes(hashes: np.ndarray, width: int, other: int = 0) -> np.ndarray:
    """The hash of each run of ``width`` words; none if there are fewer words. ``other`` picks another
    hash function."""
    n = len(hashes) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    total = hashes[:n] * MULTIPLIERS[other]
    for k in range(1, width):
        total += hashes[k : k + n] * MULTIPLIERS[other + k]
    return mixed(total)


def pack(*arrays: np.ndarray) -> bytes:
    """Non-negative integer arrays as one block."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a, np.uint64)
        width = (int(a.max()).bit_length() + 7) // 8 if len(a) else 0
        planes = a.view(np.uint8).reshape(-1, 8)[:, :width].T
        parts += [np.array([len(a), width], np.uint64).tobytes(), planes.tobytes()]
    return zstandard.compress(b"".join(parts), 1)


def unpack(block: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(block), 0, []
    while at < len(raw):
        n, width = (int(x) for x in np.frombuffer(raw, np.uint64, 2, at))
        at += 16
        full = np.zeros((n, 8), np.uint8)
        full[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
        out.append(full.view(np.uint64).ravel())
        at += n * width
    return out
