"""Parameter grids for the exponential fits."""

from __future__ import annotations

from itertools import product
from math import exp, log

# Default boxes of the fit parameters.
TAU_BOUNDS = [(1.0, 3600.0)]
K_BOUNDS = [(-120.0, 120.0)]
T_BOUNDS = (0.0, 120.0)

POINTS = {1: 32, 2: 16, 3: 10}
MIN_RATIO = 1.05


def expand_bounds(bounds: list[tuple[float, float]], order: int) -> list[tuple[float, float]]:
    """One box per term; the last one given repeats."""
    return [tuple(map(float, bounds[min(i, len(bounds) - 1)])) for i in range(order)]


def log_grid(low: float, high: float, points: int) -> list[float]:
    """Log-spaced values including both ends exactly."""
    if points < 2 or low == high:
        return [low]
    step = (log(high) - log(low)) / (points - 1)
    return [low, *[exp(log(low) + i * step) for i in range(1, points - 1)], high]


def tau_tuples(order: int, bounds: list[tuple[float, float]], points: int | None = None,
               taus: list[float] | None = None) -> list[tuple[float, ...]]:
    """Start tuples; terms that share a box are taken in rising order only."""
    boxes = expand_bounds(bounds, order)
    grids = [[t for t in taus if lo <= t <= hi] if taus else log_grid(lo, hi, points or POINTS[order])
             for lo, hi in boxes]

    def distinct(tup):
        for i, a in enumerate(tup):
            for j in range(i + 1, order):
                b = tup[j]
                if max(a, b) / min(a, b) < MIN_RATIO or (boxes[i] == boxes[j] and a > b):
                    return False
        return True

    return [tup for tup in product(*grids) if distinct(tup)]


def spacing(bounds: list[tuple[float, float]], order: int, points: int | None = None) -> float:
    """Largest log step of the start grid."""
    return max(log(hi / lo) / max((points or POINTS[order]) - 1, 1) for lo, hi in expand_bounds(bounds, order))
