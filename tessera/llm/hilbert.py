"""Hilbert curve positions of integer points, vectorised over points."""

from __future__ import annotations

import numpy as np


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Positions (uint64) of points (n x m, coordinates below 2**bits; bits * m at most 63) on the m-dimensional curve: the coordinates are turned into the curve's transposed index by undoing its rotations level by level, then their bits are interleaved."""
    x = points.astype(np.uint64).T.copy()
    m = len(x)
    one = np.uint64(1)
    q = one << np.uint64(bits - 1)
    while q > one:
        low = q - one
        for i in range(m):
            high = (x[i] & q) != 0
            flip = (x[0] ^ x[i]) & low
            x[0] = np.where(high, x[0] ^ low, x[0] ^ flip)
            if i:
                x[i] = np.where(high, x[i], x[i] ^ flip)
        q >>= one
    for i in range(1, m):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = one << np.uint64(bits - 1)
    while q > one:
        turn = np.where((x[m - 1] & q) != 0, turn ^ (q - one), turn)
        q >>= one
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(m):
            out = (out << one) | ((x[i] >> np.uint64(b)) & one)
    return out
