"""Jump consistent hashing: a stable key's shard without a ring table, and gapless places within shards."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tallyforge import ship

from .common import Stored, hash60, table

#: Hash ranges that a shard is counted in, so that its rows are numbered by many tasks.
CHUNKS = 4096
CHUNK_BITS = 60 - (CHUNKS.bit_length() - 1)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of every 64-bit key: jumps ahead with the published generator until the next jump passes the end."""
    if shards < 1:
        raise ValueError("there must be at least one shard")
    state = keys.astype(np.int64).view(np.uint64).copy()
    out = np.zeros(len(state), np.int64)
    todo = np.arange(len(state))
    with np.errstate(over="ignore"):
        while len(todo):
            state[todo] = state[todo] * np.uint64(2862933555777941757) + np.uint64(1)
            ahead = ((out[todo] + 1) * ((1 << 31) / ((state[todo] >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
            on = ahead < shards
            todo = todo[on]
            out[todo] = ahead[on]
    return out


def shards_of(key, now: int, grown: int):
    """Column of structs (now, grown) of shard numbers for a column of 64-bit hashes."""

    @pandas_udf("now int, grown int")
    def of(keys: pd.Series) -> pd.DataFrame:
        k = keys.to_numpy(np.int64)
        return pd.DataFrame({"now": jump(k, now).astype(np.int32), "grown": jump(k, grown).astype(np.int32)})

    return of(key)


def assign(rows: DataFrame, key_col: str, shards: int, grown: int | None = None, order: list[str] | None = None) -> DataFrame:
    """`rows` and (shard int, slot long, grown_shard int), which may not be columns of `rows` already (ValueError).

    The key and the shard count alone decide; null keys are one key of their own.  slot numbers the rows of a
    shard from 0 without gaps, by the key's hash, the key, then `order`; rows equal in all of these have any order
    among themselves.  Rows are numbered within chunks of a shard's hash range, in the order of the hash, and moved on by
    the counts of the chunks before, so no shard is sorted by one task.  Equal keys share a chunk; a key that a third of all
    rows hold must be made unique by the caller, since one key can't be split over shards by this law.
    """
    if clash := {"shard", "slot", "grown_shard", "__hash", "__both", "__chunk", "__before", "__row"} & set(rows.columns):
        raise ValueError(f"columns {sorted(clash)} would be overwritten")
    ship(rows.sparkSession)
    both = rows.withColumn("__hash", hash60(key_col)).withColumn("__both", shards_of(F.col("__hash"), shards, grown or shards + 1))
    hashed = both.withColumns({"shard": F.col("__both.now"), "grown_shard": F.col("__both.grown"), "__chunk": F.shiftright("__hash", CHUNK_BITS).cast("int")}).drop("__both")
    # Written once, so that keys are hashed a single time, in one Python node, for the counts and for the rows.
    hashed = Stored(hashed, "hashed").read()
    within = Window.partitionBy("shard", "__chunk").orderBy("__hash", key_col, *(order or []))
    numbered = hashed.withColumn("__row", F.row_number().over(within))
    before = Window.partitionBy("shard").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = hashed.groupBy("shard", "__chunk").count().select("shard", "__chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    placed = numbered.join(counts, ["shard", "__chunk"])
    return placed.withColumn("slot", (F.col("__before") + F.col("__row") - 1).cast("long")).drop("__hash", "__chunk", "__before", "__row")


def op8_jump_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    out = assign(docs, "doc_id", 8, order=["size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: CRC-32 by its table, itself made from the polynomial; a key's jumps in 128-bit integers, modulo 2^64.
OP8_SQL = """
with recursive t as materialized (select list(list_reduce(range(0, 8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, n) order by n) t from range(0, 256) r(n)),
d as (select doc_id, hex(encode(coalesce(text, ''))) h, ('0x' || substr(md5(case when doc_id is null then 'n' else 'v' || doc_id end), 1, 15))::bigint k from documents),
b as (select doc_id, k, length(h) // 2 + 1 size, list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::bigint) bytes from d),
c as materialized (select doc_id, k, size, xor(list_reduce(bytes, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295), 4294967295) crc from b, t),
n as (select distinct k, unnest([8, 9]) shards from c),
j as (select k, shards, k::uhugeint s, 0::bigint now, 0::bigint ahead from n
  union all select k, shards, s2, ahead, floor((ahead + 1) * (2147483648 / ((s2 // 8589934592::uhugeint)::double + 1)))::bigint from (select *, (s * 2862933555777941757::uhugeint + 1::uhugeint) % 18446744073709551616::uhugeint s2 from j where ahead < shards)),
w as (select k, shards, max(now) shard from j group by k, shards)
select doc_id, size, crc text_crc32, 'key' law, a.shard::int shard, row_number() over (partition by a.shard order by k, doc_id, size, crc) - 1 slot, g.shard::int grown_shard
from c join w a using (k) join w g using (k) where a.shards = 8 and g.shards = 9
"""
