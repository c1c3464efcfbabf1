from __future__ import annotations

import glob
import os

import duckdb
import pytest

from tallyforge.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sf, name):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got = QUERIES[name](spark, sf)
    want = c.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a = sorted(tuple(str(r[k]) for k in columns) for r in got.collect())
    b = sorted(tuple(map(str, r)) for r in want.select(", ".join(f'"{k}"' for k in columns)).fetchall())
    assert a == b


def test_all_are_there():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
