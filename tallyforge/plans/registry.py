"""Operator id -> query and the SQL that states the same result for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyforge.sources.adapters import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: Registries and rules that read no table: tested like queries, but none.
RULES: dict[str, Query] = {}


def query(name: str, sql: str | None = None, **types: str) -> Callable[[Query], Query]:
    """Registers a query under its operator id; `sql` may use the views of sources.adapters by name.

    types: columns whose type DuckDB would choose wider or narrower than Spark does.
    """

    def keep(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            text = with_views(sql)
            casts = ", ".join(f'cast("{c}" as {t}) as "{c}"' for c, t in types.items())
            ORACLE_SQL[name] = f"select * replace ({casts}) from ({text})" if casts else text
        return f

    return keep


def rule(name: str) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        RULES[name] = f
        return f

    return keep
