"""The E8 lattice: decoding points to their nearest lattice point, and the nearest neighbouring cells."""

from __future__ import annotations

import itertools

import numpy as np


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled so that they are whole numbers."""
    found = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((-2, 2), repeat=2):
            v = [0] * 8
            v[i], v[j] = a, b
            found.append(v)
    found += [v for v in itertools.product((-1, 1), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(found, dtype=np.int64)


NEIGHBOURS = minimal_vectors()


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest point of D8 (whole numbers of even sum): round, and mend an odd sum where it costs least."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(1) % 2 != 0)
    if len(odd):
        gap = x[odd] - r[odd]
        k = np.abs(gap).argmax(1)
        r[odd, k] += np.where(gap[np.arange(len(odd)), k] >= 0, 1.0, -1.0)
    return r


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row, doubled (int64): E8 is D8 and D8 shifted by one half."""
    a = _even(x)
    b = _even(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.rint(2 * np.where(nearer[:, None], a, b)).astype(np.int64)


def probes(x: np.ndarray, cells: np.ndarray, n: int) -> np.ndarray:
    """For each row the n neighbouring cells nearest to it (rows, n, 8), doubled."""
    if n == 0:
        return np.zeros((len(x), 0, 8), np.int64)
    gain = (x - cells / 2.0) @ NEIGHBOURS.T
    best = np.argpartition(-gain, n - 1, axis=1)[:, :n]
    return cells[:, None, :] + NEIGHBOURS[best]
