"""Least squares: closed forms over sums for few columns, and sparse Gram matrices with conjugate gradients for many."""

from __future__ import annotations

import copy
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import expr


def phi(x: np.ndarray) -> np.ndarray:
    """Normal distribution function, by the approximations that functions.expr states in SQL."""

    def at(coefficients: tuple[float, ...], z: np.ndarray) -> np.ndarray:
        return np.polyval(np.array(coefficients), z)

    y = -np.asarray(x, float) / np.sqrt(2)
    a = np.abs(y)
    out = np.empty_like(a)
    near, far = a <= 0.46875, a > 4
    mid = ~near & ~far
    z = a[near] ** 2
    out[near] = 1 - y[near] * at(expr.ERF_NUM, z) / at(expr.ERF_DEN, z)
    out[mid] = np.exp(-(a[mid] ** 2)) * at(expr.MID_NUM, a[mid]) / at(expr.MID_DEN, a[mid])
    z = 1 / a[far] ** 2
    out[far] = np.exp(-(a[far] ** 2)) / a[far] * (0.5641895835477563 - z * at(expr.FAR_NUM, z) / at(expr.FAR_DEN, z))
    return 0.5 * np.where(~near & (y < 0), 2 - out, out)


def det(m: list[list[str]]) -> str:
    if len(m) == 1:
        return m[0][0]
    if len(m) == 2:
        return f"({m[0][0]} * {m[1][1]} - {m[0][1]} * {m[1][0]})"
    return "(" + " ".join(f"{'+' if j % 2 == 0 else '-'} {m[0][j]} * {det([r[:j] + r[j + 1:] for r in m[1:]])}" for j in range(len(m))) + ")"


class Ols:
    """Ordinary least squares of y on up to three expressions, as SQL text for both engines.

    `sums` are the aggregates to select, by name; `coefficients` the solutions by Cramer's rule over these names, null where
    the columns aren't independent: the determinant is within 1e-9 of nought, on the scale of the columns' own squares.
    """

    def __init__(self, y: str, xs: list[str], weight: str = "1"):
        n = len(xs)
        self.sums = {f"s{i}{j}": f"sum(cast({weight} as double) * ({xs[i]}) * ({xs[j]}))" for i in range(n) for j in range(i, n)}
        self.sums |= {f"t{i}": f"sum(cast({weight} as double) * ({xs[i]}) * ({y}))" for i in range(n)}
        self.sums |= {"yy": f"sum(cast({weight} as double) * ({y}) * ({y}))"}
        m = [[f"s{min(i, j)}{max(i, j)}" for j in range(n)] for i in range(n)]
        self.determinant = det(m)
        sound = f"abs({self.determinant}) > 1e-9 * {' * '.join(m[i][i] for i in range(n))}"
        self.coefficients = [f"(case when {sound} then {det([[f't{r}' if c == i else m[r][c] for c in range(n)] for r in range(n)])} / {self.determinant} end)" for i in range(n)]

    @property
    def select(self) -> str:
        return ", ".join(f"{v} {k}" for k, v in self.sums.items())

    def aggregate(self, rows: DataFrame, by: Iterable[str] = (), more: Iterable = ()) -> DataFrame:
        return rows.groupBy(*by).agg(*(F.expr(v).alias(k) for k, v in self.sums.items()), *more)


def gram(design: DataFrame, by: list[str], key: str = "row_id") -> DataFrame:
    """(by, i, j, a, a2, a0): sums of w * x_i * x_j, of w^2 * x_i * x_j and of x_i * x_j, for i <= j.

    design has a row (by, key, w, entries array<struct<i string, v double>>) for each observation, the response being an entry like
    any other.  Each observation makes the products of its few entries where it lies; partial sums meet in one shuffle.
    """
    pairs = design.select(*by, "w", F.explode("entries").alias("p"), "entries").select(*by, "w", "p", F.explode("entries").alias("q")).where("p.i <= q.i")
    plain = F.col("p.v") * F.col("q.v")
    product = F.col("w") * plain
    return pairs.groupBy(*by, F.col("p.i").alias("i"), F.col("q.i").alias("j")).agg(F.sum(product).alias("a"), F.sum(product * F.col("w")).alias("a2"), F.sum(plain).alias("a0"))


RESPONSE = "~y"


#: Cells of a sparse matrix whose products are held at once.
CELLS = 1 << 18
#: Up to so many unknowns a system that conjugate gradients don't settle is solved densely.
DENSE = 4096


class Gram:
    """A symmetric matrix over many teams and a few special columns behind them: few cells between teams, whole columns beside them.

    Cells between teams are (i, j, v), i < j, each pair as often as it likes.  `order` are the places of (i, j) and, from len(i) on, of (j, i) sorted
    by row and column; it is given where matrices of the same cells are made again and again, `keep` saying which of them count.
    """

    def __init__(self, diag: np.ndarray, border: np.ndarray, corner: np.ndarray, i: np.ndarray, j: np.ndarray, v: np.ndarray, order: np.ndarray | None = None, keep: np.ndarray | None = None):
        self.diag, self.border, self.corner = diag, border, corner
        order = both_ways(i, j) if order is None else order
        if keep is not None:
            order = order[np.concatenate((keep, keep))[order]]
        cell, turned = order % max(len(i), 1), order >= len(i)
        rows, columns, v = np.where(turned, j[cell], i[cell]), np.where(turned, i[cell], j[cell]), v[cell]
        if len(rows):
            first = np.flatnonzero(np.append(True, (np.diff(rows) != 0) | (np.diff(columns) != 0)))
            rows, columns, v = rows[first], columns[first], np.add.reduceat(v, first)
        self.rows, self.columns, self.values = rows, columns, v
        self.starts = np.flatnonzero(np.append(True, np.diff(rows) != 0)) if len(rows) else np.zeros(0, int)

    def __len__(self) -> int:
        return len(self.diag) + len(self.corner)

    def between(self, x: np.ndarray) -> np.ndarray:
        """The product of the cells between teams with columns."""
        out = np.zeros_like(x)
        step = max(1, CELLS // x.shape[1])
        bounds = np.append(self.starts, len(self.values))
        lo = 0
        while lo < len(self.starts):  # whole rows, about `step` cells
            hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + step, "right")) - 1)
            a, b = bounds[lo], bounds[hi]
            out[self.rows[self.starts[lo:hi]]] = np.add.reduceat(self.values[a:b, None] * x[self.columns[a:b]], self.starts[lo:hi] - a, 0)
            lo = hi
        return out

    def __matmul__(self, x: np.ndarray) -> np.ndarray:
        if x.ndim == 1:
            return (self @ x[:, None])[:, 0]
        n = len(self.diag)
        teams, few = x[:n], x[n:]
        return np.concatenate((self.diag[:, None] * teams + self.between(teams) + self.border @ few, self.border.T @ teams + self.corner @ few))

    def diagonal(self) -> np.ndarray:
        return np.append(self.diag, self.corner.diagonal())

    def take(self, teams: np.ndarray, special: list[int]) -> Gram:
        """The matrix of some teams, in ascending order, and of some special columns."""
        at = np.full(len(self.diag), -1)
        at[teams] = np.arange(len(teams))
        on = (at[self.rows] >= 0) & (at[self.columns] >= 0)
        out = copy.copy(self)
        out.diag, out.border, out.corner = self.diag[teams], self.border[np.ix_(teams, special)], self.corner[np.ix_(special, special)]
        out.rows, out.columns, out.values = at[self.rows[on]], at[self.columns[on]], self.values[on]
        out.starts = np.flatnonzero(np.append(True, np.diff(out.rows) != 0)) if len(out.rows) else np.zeros(0, int)
        return out

    def right(self, teams: np.ndarray, special: list[int], y: int) -> np.ndarray:
        """A special column as a right side of take()."""
        return np.append(self.border[teams, y], self.corner[special, y])

    def toarray(self) -> np.ndarray:
        n = len(self.diag)
        out = np.block([[np.diag(self.diag), self.border], [self.border.T, self.corner]])
        out[:n, :n][self.rows, self.columns] += self.values
        return out


def both_ways(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.lexsort((np.concatenate((j, i)), np.concatenate((i, j))))


def ridge(a: np.ndarray | Gram, b: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """Solution of (A + diag(penalty)) x = b; of least norm where that is singular.  A Gram's by conjugate gradients, twice, the second time of what the first left."""
    if isinstance(a, Gram):
        x = ridge_path(a, b, penalty[:, None])[:, 0]
        left = b - a @ x - penalty * x
        more = x + ridge_path(a, left, penalty[:, None], accept=True)[:, 0]
        return more if np.abs(b - a @ more - penalty * more).max() < np.abs(left).max() else x
    m = a + np.diag(penalty)
    try:
        np.linalg.cholesky(m)
        return np.linalg.solve(m, b)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(m, hermitian=True) @ b


def ridge_path(a: np.ndarray | Gram, b: np.ndarray, penalties: np.ndarray, most: int = 300, accept: bool = False) -> np.ndarray:
    """The solutions for several diagonals (one a column) at once, by conjugate gradients to twelve digits.

    A product with A serves all of them, so a path costs some tens of products instead of a factorisation each.  What
    has not settled, as singular systems may not, is solved directly, or in ten times the rounds where it is too large for that; with
    `accept` it stays as it is.  `b` may have a column for each of the penalties'.
    """
    d = np.maximum(a.diagonal()[:, None] + penalties, 1e-300)
    b = np.repeat(b[:, None], d.shape[1], 1) if b.ndim == 1 else b
    x, r = np.zeros_like(d), b.copy()
    z = r / d
    p, rz = z.copy(), (r * z).sum(0)
    goal = rz * 1e-24
    large = len(d) > DENSE
    for _ in range(most * (10 if large and not accept else 1)):
        if (rz <= goal).all():
            return x
        q = a @ p + penalties * p
        pq = (p * q).sum(0)
        alpha = np.divide(rz, pq, out=np.zeros_like(rz), where=(pq > 0) & (rz > goal))
        x += alpha * p
        r -= alpha * q
        z = r / d
        new = (r * z).sum(0)
        p = z + np.divide(new, rz, out=np.zeros_like(rz), where=rz > 0) * p
        rz = np.where(alpha > 0, new, rz)
    if accept:
        return x
    for k in np.flatnonzero(rz > goal):
        if large:
            raise np.linalg.LinAlgError(f"{len(d)} unknowns didn't settle: {np.sqrt(rz[k] / goal[k]) * 1e-12:.1e} of the right side is left")
        x[:, k] = ridge(a.toarray() if isinstance(a, Gram) else a, b[:, k], penalties[:, k])
    return x


def choose_lambda(held_out: Iterable[tuple], k: int, grid: tuple[float, ...], free: np.ndarray, rows: int) -> tuple[float, int]:
    """The grid's value of least squared error over held-out folds, the largest of those within 1e-12; and the folds used.

    A held-out fold is two systems (A, b, yy), that of all other rows and its own, from which the errors come, so no observation is read again.
    Fewer observations than twice the folds: the largest value.
    """
    if k < 2 or rows < 2 * k:
        return max(grid), 0
    penalties = free[:, None] * np.array(grid)
    errors = np.zeros(len(grid))
    for (a, b, _), (own, right, yy) in held_out:
        x = ridge_path(a, b, penalties)
        errors += yy - 2 * x.T @ right + (x * (own @ x)).sum(0)
    return max(v for v, e in zip(grid, errors, strict=True) if e <= errors.min() + 1e-12), k
