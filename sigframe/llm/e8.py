"""The E8 lattice: nearest points, and the neighbours of a point."""

from __future__ import annotations

from itertools import combinations, product

import numpy as np


def _shortest() -> np.ndarray:
    """The 240 shortest vectors: two coordinates of +-1, or eight of +-1/2 with an even number of minus signs."""
    found = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            found.append(v)
    found += [np.array(s) / 2 for s in product((1.0, -1.0), repeat=8) if np.prod(s) > 0]
    return np.array(found)


SHORTEST = _shortest()


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum: where the sum is odd, the worst rounded coordinate goes the other way."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(1) % 2 != 0)
    if len(odd):
        off = x[odd] - near[odd]
        worst = np.abs(off).argmax(1)
        near[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return near


def nearest(x: np.ndarray) -> np.ndarray:
    """The lattice point nearest to each row of x, from the two cosets of which the lattice is made."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - half) ** 2).sum(1) < ((x - whole) ** 2).sum(1))[:, None], half, whole)


def probes(x: np.ndarray, home: np.ndarray, count: int) -> np.ndarray:
    """The neighbours of the home points that lie nearest to x: rows, count, 8."""
    along = (x - home) @ SHORTEST.T
    best = np.argpartition(-along, min(count, 239), axis=1)[:, :count] if count < 240 else np.argsort(-along, axis=1)
    return home[:, None, :] + SHORTEST[best]
