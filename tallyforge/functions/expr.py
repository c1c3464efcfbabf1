"""Scalar formulas as SQL text that Spark and DuckDB read alike, and as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of W. J. Cody's rational approximations of erf and erfc (1969), highest power first
# in the order in which they are used.
ERF_NUM = (1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3)
ERF_DEN = (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3)
MID_NUM = (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3)
MID_DEN = (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3)
FAR_NUM = (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4)
FAR_DEN = (1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)


def horner(coefficients: tuple[float, ...], x: str) -> str:
    out = f"cast({coefficients[0]!r} as double)"
    for c in coefficients[1:]:
        out = f"({out} * {x} + cast({c!r} as double))"
    return out


def erfc_sql(x: str) -> str:
    """Complementary error function, relative error near 1e-15 also far out; x is an expression that is repeated."""
    z, a = f"(({x}) * ({x}))", f"abs({x})"
    near = f"(1 - ({x}) * {horner(ERF_NUM, z)} / {horner(ERF_DEN, z)})"
    mid = f"(exp(-{z}) * {horner(MID_NUM, a)} / {horner(MID_DEN, a)})"
    far = f"(exp(-{z}) / {a} * (0.5641895835477563 - (1 / {z}) * {horner(FAR_NUM, f'(1 / {z})')} / {horner(FAR_DEN, f'(1 / {z})')}))"
    return f"(case when {a} <= 0.46875 then {near} when ({x}) < 0 then 2 - (case when {a} <= 4 then {mid} else {far} end) when {a} <= 4 then {mid} else {far} end)"


def phi_sql(x: str) -> str:
    """Normal distribution function of a column or short expression."""
    return f"(0.5 * {erfc_sql(f'((-({x})) / 1.4142135623730951)')})"


def phi(x: str) -> Column:
    return F.expr(phi_sql(x))


def compress_sql(m: str, c: float) -> str:
    """c * tanh(m / c); the margin itself where c is infinite."""
    return f"({m})" if c == float("inf") else f"({c!r} * tanh(cast({m} as double) / {c!r}))"


def compress(m: str, c: float = 32.0) -> Column:
    return F.expr(compress_sql(m, c))


def response_sql(m: str, c: float = 32.0, win: float = 7.0) -> str:
    """Compressed margin and a bonus for the winner: bounded by c + win, odd and rising."""
    return f"({compress_sql(m, c)} + {win!r} * sign({m}))"


def round_sql(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits})"


def rounded(x: Column | str, digits: int) -> Column:
    """Rounds the double's product with the power of ten, as DuckDB does; Spark's round takes its shortest decimal, which may end in a 5 where the double lies beside it."""
    return F.round((F.col(x) if isinstance(x, str) else x) * 10.0**digits, 0) / 10.0**digits
