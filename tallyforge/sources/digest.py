"""Digests of sorted tables: trees of SHA-256, the same however rows are partitioned, with no row on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.sources.stored import stored

#: Digests that one digest of the next level is taken of, in their order (fixed value: the root depends on it).
FAN = 1024
#: Bits of monotonically_increasing_id that count within a partition.
WITHIN = 33


def row_text(columns: list[str]) -> Column:
    """A row's values, each behind its length in bytes, so that no two rows share a text; a null is the letter n."""
    parts = (F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("n")) for c in columns)
    return F.concat(F.lit(""), *parts)


def placed(rows: DataFrame, order: list[str], value: Column) -> DataFrame:
    """(place, value): values in the order of `order`, then of themselves, numbered from 0.

    Sorted partitions are written once and numbered where they lie; only their counts, a row a partition, meet in one window.
    """
    ordered = rows.select(F.struct(*order).alias("key"), value.alias("value")).orderBy("key", "value").select("value", F.monotonically_increasing_id().alias("at"))
    t = stored(ordered, "placed").select("value", F.shiftright("at", WITHIN).alias("part"), F.expr(f"at & {(1 << WITHIN) - 1}L").alias("within"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = t.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return t.join(starts, "part").select((F.col("start") + F.col("within")).alias("place"), "value")


def root(leaves: DataFrame) -> DataFrame:
    """(digest, rows) of (place, value): FAN values at a time become the SHA-256 of their concatenation until one is left; of no rows, that of an empty text."""
    t, n = leaves, leaves.count()
    left = n
    while left > 1:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]), "")
        t = t.groupBy(F.expr(f"place div {FAN}").alias("up")).agg(F.sha2(joined, 256).alias("value")).withColumnRenamed("up", "place")
        left = -(-left // FAN)
    return t.agg(F.coalesce(F.max("value"), F.sha2(F.lit("").cast("binary"), 256)).alias("digest"), F.lit(n).cast("long").alias("rows"))


def root_sql(rows: str, columns: list[str], order: list[str]) -> str:
    """`root` of a table's row texts in SQL, for up to FAN to the third rows."""
    text = " || ".join(f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, 'n')" for c in [*order, *columns])
    up = "select place // %d place, sha256(string_agg(value, '' order by place)) value from %s group by 1"
    levels = ", ".join(f"l{k} as ({up % (FAN, f'l{k - 1}')})" for k in (1, 2, 3))
    pick = " ".join(f"when n <= {FAN**k} then (select max(value) from l{k})" for k in (0, 1, 2))
    return f"""with l0 as (select row_number() over (order by {', '.join(order)}, value) - 1 place, value from (select {', '.join(order)}, sha256({text}) value from {rows})), {levels}
      select coalesce(case {pick} else (select max(value) from l3) end, sha256('')) digest, n as rows from (select count(*) n from l0)"""
