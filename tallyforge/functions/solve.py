"""Poisson-binomial sums and bisection as expressions over arrays in the JVM, and over the games of many teams side by side in NumPy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.expr import phi_sql

BOUND = 60.0
HALVINGS = 60


def pmf(ps: str) -> Column:
    """Distribution of the number of successes of independent trials: array of length n + 1, by convolution."""
    step = (
        "zip_with(concat(acc, array(0D)), concat(array(0D), acc), (a, b) -> a * (1 - p) + b * p)"
    )
    return F.expr(f"aggregate({ps}, array(1D), (acc, p) -> {step})")


def upper_tail(pmf_column: str, k: str) -> Column:
    """Probability of k successes or more, k being brought into 0 to n."""
    at = f"greatest(0, least(size({pmf_column}) - 1, {k}))"
    return F.expr(f"aggregate(slice({pmf_column}, cast({at} as int) + 1, size({pmf_column})), 0D, (a, x) -> a + x)")


def log_key_sql(tail: str) -> str:
    return f"least(300.0, -log10(greatest({tail}, 1e-300)))"


def expected_wins_sql(q: str, schedule: str, edge: float, sigma: float) -> str:
    """Sum of win probabilities of a team of quality q over an array of structs (power, site)."""
    return f"aggregate(transform({schedule}, g -> ({q} - g.power + {edge!r} * g.site) / {sigma!r}), 0D, (acc, z) -> acc + {phi_sql('z')})"


def wins_root(target: str, schedule: str, edge: float, sigma: float) -> Column:
    """Quality at which expected wins equal the target, by a fixed number of halvings of [-BOUND, BOUND]."""
    wins = expected_wins_sql("((s.lo + s.hi) / 2)", schedule, edge, sigma)
    step = f"(s, i) -> case when {wins} < {target} then named_struct('lo', (s.lo + s.hi) / 2, 'hi', s.hi) else named_struct('lo', s.lo, 'hi', (s.lo + s.hi) / 2) end"
    return F.expr(f"aggregate(sequence(1, {HALVINGS}), named_struct('lo', -{BOUND}D, 'hi', {BOUND}D), {step}, s -> (s.lo + s.hi) / 2)")


#: Steps of a root by secants before it is halved, and how close to it they must have come.
SECANTS, CLOSE = 30, 2e-13


def roots(value: Callable[[np.ndarray, np.ndarray], np.ndarray], target: np.ndarray, team: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of each team the quality within [-BOUND, BOUND] at which a rising value summed over its games is the target; a bound where there is none.

    value(q, on) is that of the games `on` at the quality q of their team; games of a team lie side by side from `start` on.  Brackets are narrowed by
    regula falsi with halved weights (Illinois), a step beyond the root closing them; what has not come close by then, as flat sums may not, is halved as
    wins_root does.
    """
    k = len(target)
    size = np.diff(np.append(start, len(team)))
    lo, hi = np.full(k, -BOUND), np.full(k, BOUND)

    def missed(q: np.ndarray, some: np.ndarray) -> np.ndarray:
        n = size[some]
        first = np.cumsum(n) - n
        on = np.repeat(start[some] - first, n) + np.arange(n.sum())
        return np.add.reduceat(value(np.repeat(q, n), on), first) - target[some]

    if not k:
        return lo
    every = np.arange(k)
    low, high = missed(lo, every), missed(hi, every)
    out = np.where(low >= 0, -BOUND, np.where(high < 0, BOUND, np.nan))
    side, beyond = np.zeros(k, int), np.full(k, np.nan)
    some = np.flatnonzero(np.isnan(out))
    for _ in range(SECANTS):
        if not len(some):
            break
        a, b = lo[some], hi[some]
        slope = (high[some] - low[some]) / (b - a)
        q = np.where(np.isnan(beyond[some]), a - low[some] / slope, beyond[some])
        q = np.where((q > a) & (q < b), q, (a + b) / 2)
        f = missed(q, some)
        below = f < 0
        up, down = some[below], some[~below]
        high[up] *= np.where(side[up] == 1, 0.5, 1.0)
        low[down] *= np.where(side[down] == -1, 0.5, 1.0)
        lo[up], low[up], side[up] = q[below], f[below], 1
        hi[down], high[down], side[down] = q[~below], f[~below], -1
        close = np.abs(f) < CLOSE / 2 * slope
        beyond[some] = np.where(close, q + np.where(below, CLOSE, -CLOSE), np.nan)
        some = some[hi[some] - lo[some] > 2 * CLOSE]
    for _ in range(HALVINGS):
        if not len(some):
            break
        q = (lo[some] + hi[some]) / 2
        below = missed(q, some) < 0
        lo[some[below]], hi[some[~below]] = q[below], q[~below]
    return np.where(np.isnan(out), (lo + hi) / 2, out)


def tails(p: np.ndarray, team: np.ndarray, start: np.ndarray, wins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each team the chance of at least its wins, and that less half the chance of just these, by the convolution of pmf over its games in order."""
    size = np.diff(np.append(start, len(team)))
    most, k = int(size.max()) if len(size) else 0, len(size)
    mass = np.zeros((k, most + 1))
    mass[:, 0] = 1.0
    for g in range(most):
        on = np.flatnonzero(size > g)
        q, old = p[start[on] + g][:, None], mass[on]
        new = old * (1 - q)
        new[:, 1:] += old[:, :-1] * q
        mass[on] = new
    tail = np.where(np.arange(most + 1) >= wins[:, None], mass, 0.0).sum(1)
    return tail, tail - 0.5 * mass[np.arange(k), wins]
