"""Hilbert curve positions of integer points, vectorised over points."""

from __future__ import annotations

import numpy as np


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of ``points`` (n, dims), of ``bits`` bits a dimension.

    dims * bits is at most 63. The transform turns axes into the transposed index by
    undoing, from the top bit down, the rotations of each level; the Gray code is then
    decoded and the bits are interleaved.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    if dims * bits > 63:
        raise ValueError("dims * bits is at most 63")
    top = np.int64(1) << (bits - 1)
    level = top
    while level > 1:
        low = level - 1
        for i in range(dims):
            high = (x[i] & level) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        level >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    level = top
    while level > 1:
        flip ^= np.where((x[dims - 1] & level) != 0, level - 1, 0)
        level >>= 1
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key
