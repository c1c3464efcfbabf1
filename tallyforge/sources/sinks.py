"""Outputs: tables in three formats, canonical text, release bundles, upserts (O*)."""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge import ship
from tallyforge.sources import digest

#: Serving tables and their keys (fixed values).
SERVING: dict[str, tuple[str, ...]] = {
    "teams": ("team_id",), "seasons": ("season",), "weeks": ("season", "season_type", "week"), "games": ("game_id",), "runs": ("run_id",), "ratings": ("run_id", "team_id", "layer"),
    "polls": ("run_id", "team_id"), "published_polls": ("season", "poll", "team_id"), "cells": ("run_id", "e", "k", "team_id"), "backtest": ("run_id", "system", "metric"), "recipes": ("slug",), "artifacts": ("run_id", "name"),
}
#: Rows of these are never changed once they stand.
IMMUTABLE = frozenset({"published_polls"})
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def write_all(df: DataFrame, path: str, name: str, sort: list[str]) -> None:
    """A table as Parquet, CSV and JSON lines, each sorted, in one file: for results of a poll's size."""
    one = df.coalesce(1).sortWithinPartitions(*sort)
    one.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    one.write.mode("overwrite").option("header", True).csv(f"{path}/{name}.csv")
    one.write.mode("overwrite").json(f"{path}/{name}.json")


def canonical_number(x: float | int | None) -> str:
    """Ten significant digits, without trailing zeros, as C's %.10g prints them; nothing for null and what isn't finite."""
    if x is None or (isinstance(x, float) and not math.isfinite(x)):
        return ""
    return str(x) if isinstance(x, int) else f"{x:.10g}"


def canonical_lines(df: DataFrame, sort: list[str]) -> DataFrame:
    """(place, value): the lines of a table's canonical text, the header being line 0; it is written, sorted and digested where it lies.

    Numbers are formatted by canonical_number; a null is empty; rows of equal keys are ordered by their lines.
    """

    @F.pandas_udf("string")
    def number(x: pd.Series) -> pd.Series:
        return x.map(lambda v: canonical_number(float(v)) if v is not None else "")

    def text(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        return F.coalesce(number(c.cast("double")) if kind in ("double", "float") else c.cast("string"), F.lit(""))

    ship(df.sparkSession)
    body = digest.placed(df, sort, F.concat_ws(",", *(text(*t) for t in df.dtypes)))
    head = df.sparkSession.range(1).select(F.lit(0).cast("long").alias("place"), F.lit(",".join(df.columns)).alias("value"))
    return head.unionByName(body.withColumn("place", F.col("place") + 1))


def write_canonical(df: DataFrame, path: str, sort: list[str]) -> DataFrame:
    """Writes the canonical text as part files whose names sort as their lines do; gives (digest, rows) of its lines, the header counted."""
    lines = canonical_lines(df, sort)
    lines.orderBy("place").select("value").write.mode("overwrite").text(path)
    return digest.root(lines.select("place", F.sha2("value", 256).alias("value")))


def run_id(parts: dict[str, str]) -> str:
    """The same for the same content: a name-based UUID of the canonical text."""
    return str(uuid.uuid5(NAMESPACE, json.dumps(parts, sort_keys=True, separators=(",", ":"))))


def upsert_sql(table: str, columns: list[str]) -> str:
    """INSERT that updates what stands under the same key, or leaves it where the table is immutable."""
    if table not in SERVING:
        raise KeyError(f"unknown serving table {table}")
    key = SERVING[table]
    rest = [c for c in columns if c not in key]
    act = "DO NOTHING" if table in IMMUTABLE or not rest else "DO UPDATE SET " + ", ".join(f"{c} = EXCLUDED.{c}" for c in rest)
    return f"INSERT INTO {table} ({', '.join(columns)}) VALUES ({', '.join(['%s'] * len(columns))}) ON CONFLICT ({', '.join(key)}) {act}"


def load_jdbc(df: DataFrame, table: str, url: str | None, properties: dict[str, str] | None = None) -> bool:
    """Appends to a staging table over JDBC; does nothing without an address."""
    if not url:
        return False
    df.write.jdbc(url, f"staging_{table}", mode="overwrite", properties=properties or {})
    return True


def inventory(root: str) -> list[dict]:
    """(name, bytes, sha256) of the files below a local folder."""
    base = Path(root)
    return [{"name": str(p.relative_to(base)), "bytes": p.stat().st_size, "sha256": hashlib.sha256(p.read_bytes()).hexdigest()} for p in sorted(base.rglob("*")) if p.is_file() and not p.name.startswith((".", "_"))]


def release(root: str, most_files: int = 1000, most_bytes: int = 2_000_000_000) -> list[dict]:
    """The manifest of a bundle: flattened names must differ, and count and size keep to their bounds."""
    got = inventory(root)
    names = [x["name"].replace("/", "__") for x in got]
    if len(set(names)) != len(names):
        raise ValueError("two files have one flattened name")
    if len(got) > most_files or sum(x["bytes"] for x in got) > most_bytes:
        raise ValueError("the bundle is too large")
    return [x | {"asset": n} for x, n in zip(got, names, strict=True)]


def verify_release(root: str, manifest: list[dict]) -> list[str]:
    """Names that are missing or differ."""
    have = {x["name"]: x["sha256"] for x in inventory(root)}
    return [x["name"] for x in manifest if have.get(x["name"]) != x["sha256"]]


def write_documents(df: DataFrame, root: str, key: list[str], fields: list[str]) -> int:
    """One JSON document a key below a local folder, and an index of them; numbers that aren't finite become null."""
    base = Path(root)
    rows = df.groupBy(*key).agg(F.to_json(F.sort_array(F.collect_list(F.struct(*fields)))).alias("rows")).orderBy(*key)
    names = []
    for r in rows.toLocalIterator():
        name = "-".join(str(r[k]) for k in key) + ".json"
        base.mkdir(parents=True, exist_ok=True)
        (base / name).write_text(json.dumps({k: r[k] for k in key} | {"rows": json.loads(r.rows)}, sort_keys=True))
        names.append(name)
    (base / "index.json").write_text(json.dumps(sorted(names)))
    return len(names)


def publish_decision(armed: bool, resolved: bool, published: bool) -> bool:
    return armed and resolved and not published
