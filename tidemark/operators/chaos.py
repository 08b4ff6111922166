"""Memory and chaos of a series: Hurst exponent, correlation dimension, largest Lyapunov exponent of its log returns.

Each value looks at the closes of the bar and of `window` bars before. Rows come in Arrow batches with the last closes
carried over from batch to batch. Pairs of closes that aren't both positive make no return, and a null close is passed over.
"""
from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from ..schema import KEY
from .carried import scanned


def slope(x, y) -> float | None:
    """Of the least-squares line; null for fewer than two places."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    n = len(x)
    below = n * (x * x).sum() - x.sum() ** 2
    return None if n < 2 or abs(below) < 1e-10 else float((n * (x * y).sum() - x.sum() * y.sum()) / below)


def ladder(first: int, most: int, n: int) -> list[int]:
    """Window sizes from `first`, each half as large again, up to the largest possible, which is among them where a step
    passes it."""
    top = min(n, most)
    if n <= 2 * first:
        return [first, top] if first < top else []
    sizes = [first]
    while (after := int(sizes[-1] * 1.5)) <= top:
        sizes.append(after)
    return sizes if sizes[-1] == top else [*sizes, top]


def hurst(returns: np.ndarray, window: int = 100, least: int = 10) -> float | None:
    """Slope of the log rescaled range over the log of the window's size; null for under 2 * least returns."""
    if len(returns) < 2 * least:
        return None
    sizes = ladder(least, window, len(returns))
    if len(sizes) < 2:
        return None
    scaled = []
    for n in sizes:
        part = returns[-n:]
        apart = part - part.mean()
        path, var = apart.cumsum(), (apart * apart).mean()
        scaled.append(max((path.max() - path.min()) / (math.sqrt(var) if var > 0 else 1e-4), 1e-10))
    return slope(np.log(sizes), np.log(scaled))


def distances(returns: np.ndarray, dim: int, lag: int) -> np.ndarray:
    """Of all pairs of delay vectors: squares of single differences are summed along the diagonals."""
    n = len(returns) - (dim - 1) * lag
    if n <= 0:
        return np.zeros((0, 0))
    apart = (returns[:, None] - returns[None, :]) ** 2
    return np.sqrt(sum(apart[k * lag : k * lag + n, k * lag : k * lag + n] for k in range(dim)))


def correlation_dimension(returns: np.ndarray, window: int = 100, dim: int = 10, lag: int = 1, radii: int = 10) -> float | None:
    """Slope of the log share of pairs nearer than a radius over its log, for radii from the twentieth part of the sorted
    distances to the nineteenth; pairs at no distance are left out. Null for under window // 2 returns, 20 vectors, ten
    distances or three radii with pairs, and where the slope isn't over zero."""
    if len(returns) < window // 2:
        return None
    d = distances(returns, dim, lag)
    if len(d) < 20:
        return None
    d = np.sort(d[np.triu_indices(len(d), 1)])
    d = d[d > 0]
    if len(d) < 10:
        return None
    low, high = d[len(d) // 20], d[min(len(d) - 1, len(d) * 19 // 20)]
    if high <= low or math.log(high) <= math.log(low):
        return None
    at = [math.log(low) + (math.log(high) - math.log(low)) * i / (radii - 1) for i in range(radii)]
    nearer = np.searchsorted(d, [math.exp(x) for x in at], "left")
    found = [(x, math.log(c / len(d))) for x, c in zip(at, nearer.tolist()) if c]
    value = slope(*zip(*found)) if len(found) >= 3 else None
    return value if value is not None and value > 0 else None


def lyapunov(returns: np.ndarray, window: int = 100, dim: int = 10, lag: int = 1, apart: int = 10) -> float | None:
    """Slope over the steps of the mean log distance between each delay vector and its nearest one that is more than `apart`
    steps away in time (the earlier of equals). Null for under window // 2 returns, 2 * apart vectors, or two steps."""
    if len(returns) < window // 2:
        return None
    d = distances(returns, dim, lag)
    n, steps = len(d), min(len(d) // 4, 20)
    if n < 2 * apart or steps < 2:
        return None
    place = np.arange(n)
    far = np.where((np.abs(place[:, None] - place[None, :]) <= apart) | (d <= 0), np.inf, d)[: n - steps]
    near = far.argmin(1)
    ok = np.isfinite(far.min(1)) & (near + steps < n)
    start, near = place[: n - steps][ok], near[ok]
    means, at = [], []
    for k in range(steps):
        x = d[start + k, near + k]
        if (x > 0).any():
            at.append(k)
            means.append(np.log(x[x > 0]).mean())
    return slope(at, means) if len(at) >= 2 else None


class _Window:
    """Closes of the last bars, from batch to batch."""

    def __init__(self, window: int, values: dict[str, tuple[int, Callable]]):
        self.window, self.values, self.before = window, values, np.zeros(0)

    def feed(self, rows):
        close = rows["close"].astype(float)
        ok = ~np.isnan(close)
        every = np.concatenate([self.before, close[ok]])
        with np.errstate(invalid="ignore", divide="ignore"):
            steps = np.log(every[1:] / every[:-1])
        both = (every[1:] > 0) & (every[:-1] > 0)
        upto, steps = np.concatenate([[0], np.cumsum(both)]), steps[both]
        out = {name: np.full(len(close), np.nan) for name in self.values}
        for row, i in zip(np.flatnonzero(ok), range(len(self.before), len(every))):
            first = max(0, i - self.window)
            for name, (least, value) in self.values.items():
                if i - first + 1 >= least and (found := value(steps[upto[first] : upto[i]])) is not None:
                    out[name][row] = found
        self.before = every[-self.window :]
        return out


def chaos(bars: DataFrame, key=KEY, window: int = 100, least: int = 10, dim: int = 10, lag: int = 1, radii: int = 10, apart: int = 10) -> DataFrame:
    """bars with hurst, correlation_dimension and lyapunov, null where there are too few closes."""
    span = (dim - 1) * lag
    values = {
        "hurst": (2 * least, lambda r: hurst(r, window, least)),
        "correlation_dimension": (span + 20, lambda r: correlation_dimension(r, window, dim, lag, radii)),
        "lyapunov": (span + 2 * apart + 10, lambda r: lyapunov(r, window, dim, lag, apart)),
    }
    return scanned(bars, "hurst double, correlation_dimension double, lyapunov double", lambda: _Window(window, values), ["close"], key)
