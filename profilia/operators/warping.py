"""Warping of long series in linear time: a path found on series of half the length is refined in a band around it, level by level."""

from __future__ import annotations

import numpy as np


def _halved(x: np.ndarray) -> np.ndarray:
    """Means of successive pairs; the last point of an odd number stays alone."""
    pairs = x[: len(x) // 2 * 2].reshape(-1, 2, x.shape[1]).mean(1)
    return np.concatenate([pairs, x[-1:]]) if len(x) % 2 else pairs


def band_around(first: np.ndarray, last: np.ndarray, n: int, m: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """first and last place of a coarse path in each coarse row -> of each of n fine rows the range lo..hi (without hi) of the m places
    within `radius` coarse cells of the path."""
    rows = np.arange(len(first))
    lo = 2 * (first[np.maximum(rows - radius, 0)] - radius)
    hi = 2 * (last[np.minimum(rows + radius, len(rows) - 1)] + radius) + 2
    fine = np.arange(n) // 2
    return np.clip(lo[fine], 0, m), np.clip(hi[fine], 0, m)


def band_path(a: np.ndarray, b: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The least sum of point distances along a path inside the band, and the first and last place of that path in each row.

    Of equal steps back the diagonal one is taken, then the one to the row before.
    """
    inf = float("inf")
    table: list[list[float]] = []
    for i in range(len(a)):
        cost = np.sqrt(np.square(b[lo[i] : hi[i]] - a[i]).sum(1)).tolist()
        row, left = [], inf
        if i:
            above, shift = table[-1], int(lo[i] - lo[i - 1])
            width = len(above)
        for j, c in enumerate(cost):
            if i:
                k = j + shift
                up = above[k] if k < width else inf
                slant = above[k - 1] if 0 < k <= width else inf
                best = min(up, slant, left)
            else:
                best = left if j else 0.0
            left = c + best
            row.append(left)
        table.append(row)
    first, last = np.zeros(len(a), int), np.zeros(len(a), int)
    i, j = len(a) - 1, len(b) - 1
    last[i] = j
    at = lambda i, j: table[i][j - lo[i]] if i >= 0 and lo[i] <= j < hi[i] else inf
    while i or j:
        slant, up, left = at(i - 1, j - 1), at(i - 1, j), at(i, j - 1)
        if i and slant <= up and slant <= left:
            first[i], i, j = j, i - 1, j - 1
            last[i] = j
        elif i and up <= left:
            first[i], i = j, i - 1
            last[i] = j
        else:
            j -= 1
    return table[-1][-1], first, last


def refined_path(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[float, np.ndarray, np.ndarray]:
    """As band_path, over bands of `radius` cells around the path of the halved series; series up to radius + 1 points are compared whole."""
    n, m = len(a), len(b)
    if min(n, m) < radius + 2:
        return band_path(a, b, np.zeros(n, int), np.full(n, m))
    _, first, last = refined_path(_halved(a), _halved(b), radius)
    return band_path(a, b, *band_around(first, last, n, m, radius))


def refined_dtw(a: np.ndarray, b: np.ndarray, radius: int) -> float:
    """A warped distance, never below the exact one and equal to it once the radius covers the series; infinite if a side is empty.

    Time and memory are in proportion to (len(a) + len(b)) * radius.
    """
    if radius < 0:
        raise ValueError("radius must not be negative")
    if not len(a) or not len(b):
        return float("inf")
    return refined_path(a, b, max(1, radius))[0]
