"""Keys along a Hilbert curve for points of a small integer grid, in numpy."""

from __future__ import annotations

import numpy as np


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of each point: (n, dims) integers below 2 ** bits, dims * bits at most 63.

    Works from the highest bit down: a point's octant in the current frame gives the next digit of the key, by a
    reflected Gray code, and turns the frame for the bits below it.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = np.int64(1 << level), np.int64((1 << level) - 1)
        for k in range(dims):
            flip = (x[k] & bit) != 0
            swap = np.where(flip, 0, (x[0] ^ x[k]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[k] ^= swap
    for k in range(1, dims):
        x[k] ^= x[k - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[dims - 1] >> level) & 1, np.int64((1 << level) - 1), 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for k in range(dims):
            key = (key << 1) | ((x[k] >> level) & 1)
    return key
