"""Least squares in a box for many small normal equations at once (rows of an Arrow batch)."""

from __future__ import annotations

from itertools import product

import numpy as np

SINGULAR = 1e-11


def _solve(a: list[list[np.ndarray]], b: list[np.ndarray]) -> list[np.ndarray]:
    """Elimination, a coefficient of all rows at once; rows that are close to singular give NaN."""
    a, b, size = [[*row] for row in a], [*b], len(b)
    scale = [a[i][i] for i in range(size)]
    for i in range(size):
        a[i][i] = np.where(a[i][i] > SINGULAR * scale[i], a[i][i], np.nan)
        for j in range(i + 1, size):
            factor = a[j][i] / a[i][i]
            for k in range(i + 1, size):
                a[j][k] = a[j][k] - factor * a[i][k]
            b[j] = b[j] - factor * b[i]
    v = [*b]
    for i in reversed(range(size)):
        v[i] = (b[i] - sum(a[i][j] * v[j] for j in range(i + 1, size))) / a[i][i]
    return v


def solve_boxed(a: np.ndarray, b: np.ndarray, yy: np.ndarray, boxes) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and residual sum; infinite where no face of the box has a solution.

    The optimum of a quadratic in a box is the stationary point of one of its
    faces, so the best feasible face solution is the optimum.  Faces are tried
    only for rows whose free solution leaves the box; a face leaves its free coefficients to solve for.
    """
    low, high = (np.array([box[i] for box in boxes], float) for i in (0, 1))
    finite = np.concatenate([low[np.isfinite(low)], high[np.isfinite(high)], [1.0]])
    slack = 1e-9 * np.abs(finite).max()
    size = len(boxes)
    best, best_rss = np.full((size, len(b)), np.nan), np.full(len(b), np.inf)

    def taken(rows):
        """The coefficients of some rows, each in one piece."""
        return [[np.ascontiguousarray(a[rows, i, j]) for j in range(size)] for i in range(size)], [np.ascontiguousarray(b[rows, i]) for i in range(size)]

    def consider(rows, m, r, y, v):
        ok = True
        with np.errstate(invalid="ignore"):
            for i in range(size):
                ok = ok & (v[i] >= low[i] - slack) & (v[i] <= high[i] + slack)
        rss = y - 2 * sum(v[i] * r[i] for i in range(size)) + sum(v[i] * m[i][j] * v[j] for i in range(size) for j in range(size))
        rss = np.where(ok, np.maximum(rss, 0.0), np.inf)
        better = rss < best_rss[rows]
        at = rows[better]
        best_rss[at] = rss[better]
        for i in range(size):
            best[i, at] = np.broadcast_to(v[i], rss.shape)[better]

    m, r = taken(slice(None))
    consider(np.arange(len(b)), m, r, yy, _solve(m, r))
    rows = np.flatnonzero(~np.isfinite(best_rss))
    edges = [[None] + [e for e in box if np.isfinite(e)] for box in boxes]
    (m, r), y = taken(rows), yy[rows]
    for face in product(*edges):
        free = [i for i, e in enumerate(face) if e is None]
        if len(free) == size or not len(rows):
            continue
        rhs = [r[i] - sum(m[i][j] * e for j, e in enumerate(face) if e is not None) for i in free]
        v = [*face]
        for i, x in zip(free, _solve([[m[i][j] for j in free] for i in free], rhs)):
            v[i] = x
        consider(rows, m, r, y, v)
    return np.ascontiguousarray(best.T), best_rss
