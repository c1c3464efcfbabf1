"""Every registered query of the engine's own operators against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from tallyforge.plans.catalog import ORACLE_SQL, QUERIES
from tallyforge.plans.registry import RULES


def canonical(df: pd.DataFrame) -> list[tuple]:
    out = []
    for row in df[sorted(df.columns)].itertuples(index=False):
        cells = []
        for v in row:
            if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
                cells.append("null")
            elif isinstance(v, str):
                cells.append(v)
            else:
                try:
                    cells.append(f"{float(v):.5f}".replace("-0.00000", "0.00000"))
                except (TypeError, ValueError):
                    cells.append(str(v))
        out.append(tuple(cells))
    return sorted(out)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = canonical(got), canonical(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for p, q in zip(x, y, strict=True):
            assert p == q or abs(float(p) - float(q)) < 2e-4


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).columns
    QUERIES[name](spark, sf).count()


@pytest.mark.parametrize("name", sorted(RULES))
def test_rules_run(spark, sf, name):
    assert name not in QUERIES and RULES[name](spark, sf).count() >= 0
