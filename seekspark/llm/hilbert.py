"""Positions along a Hilbert curve, for many points at once."""

from __future__ import annotations

import math

import numpy as np


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """cells: n x m whole numbers below 2^bits, m * bits <= 63 -> each point's place on the curve, as signed longs.

    The curve is built level by level: in each level the sub-cube that a point lies in tells how the axes of the finer
    levels are reflected and swapped; the turned coordinates, read as one Gray code, count along the curve.
    """
    n, m = cells.shape
    if m * bits > 63:
        raise ValueError("a key has 63 bits")
    axes = [cells[:, i].astype(np.int64) for i in range(m)]
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(m):
            upper = (axes[i] >> level) & 1
            swapped = np.where(upper == 1, 0, (axes[0] ^ axes[i]) & low)
            axes[0] ^= np.where(upper == 1, low, 0) ^ swapped
            if i:
                axes[i] ^= swapped
    for i in range(1, m):
        axes[i] ^= axes[i - 1]
    turn = np.zeros(n, np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((axes[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    keys = np.zeros(n, np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(m):
            keys = keys << 1 | ((axes[i] ^ turn) >> level) & 1
    return keys


def projection(seed: int, size: int, dims: int) -> np.ndarray:
    """size x dims: orthonormal random directions."""
    made = np.random.default_rng(seed).standard_normal((size, max(dims, 1)))
    return np.linalg.qr(made)[0][:, :dims] if size >= dims else made[:, :dims]


_ERF = np.vectorize(math.erf, otypes=[float])
_GRID = np.linspace(-6, 6, 4097)
_CDF = (1 + _ERF(_GRID / math.sqrt(2))) / 2


def to_cells(points: np.ndarray, spread: float, bits: int, shift: np.ndarray | float = 0.0) -> np.ndarray:
    """Coordinates of about normal spread -> cells of about equal use; `shift` (in [0, 1)) moves the grid, without wrapping."""
    share = np.interp(points / spread, _GRID, _CDF)
    return np.minimum(((share + shift) / (1 + np.max(shift)) * (1 << bits)).astype(np.int64), (1 << bits) - 1)
