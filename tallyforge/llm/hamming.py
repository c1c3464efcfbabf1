"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into m segments and indexed by each.  Codes within distance m * (r + 1) - 1 of a query agree with it in
some segment up to r bits, so probing all segments up to radius r finds them all.  r grows until the kth best
verified distance of a query is within that bound; only queries that aren't done go on.  Blocks of the index meet
blocks of the queries, so memory is bounded, and what a block returns is k rows a query.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stored, map_arrow, table

BITS = 64
#: Entries of an index block and queries of a query block.
INDEX_BLOCK, QUERY_BLOCK = 65_536, 8192


def sign_codes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, code long): one bit a component, set where it is above 0; component i is bit i.

    Vectors must have at most 64 components; null vectors, and null or NaN components (bit 0), don't fail: a null vector has a null code.
    """
    kind = dict(vectors.dtypes)[id_col]
    weights = (np.uint64(1) << np.arange(BITS, dtype=np.uint64)).astype(np.uint64)

    def make():
        def code(v) -> int | None:
            if v is None:
                return None
            if len(v) > BITS:
                raise ValueError(f"a vector has more than {BITS} components")
            bits = np.array([x is not None and x > 0 for x in v], bool)
            return int(weights[: len(bits)][bits].sum(dtype=np.uint64).view(np.int64)) if len(bits) else 0

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([code(x.as_py()) for x in batch.column(1)], pa.int64())], ["id", "code"])

        return each

    return map_arrow(vectors.select(id_col, vec_col), make, f"id {kind}, code long")


def segments(rows: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment: some bits fewer than the number of codes has, so that probes are as many as what they find."""
    m = max(2, min(8, round(BITS / max(8.0, math.log2(max(2, rows)) - 3))))
    edge = [BITS * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edge, edge[1:], strict=False)]


class Index:
    """Sorted segment values of a block of codes; the place of a code stands for its (code, id) entry."""

    def __init__(self, codes: np.ndarray, ids: np.ndarray):
        self.codes, self.ids = codes, ids
        self.cut = segments(len(codes))
        self.order, self.values = [], []
        for at, bits in self.cut:
            v = codes >> np.uint64(at) & np.uint64((1 << bits) - 1)
            order = np.argsort(v, kind="stable")
            self.order.append(order)
            self.values.append(v[order])

    def met(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query's place, entry's place) of all that agree in a segment up to exactly `radius` bits; once for each such segment."""
        rows, entries = [], []
        for s, (at, bits) in enumerate(self.cut):
            if bits < radius:
                continue
            own = queries >> np.uint64(at) & np.uint64((1 << bits) - 1)
            probes = (own[:, None] ^ masks(bits, radius)[None, :]).ravel()
            lo, hi = np.searchsorted(self.values[s], probes, "left"), np.searchsorted(self.values[s], probes, "right")
            n = hi - lo
            some = np.flatnonzero(n)
            n, lo = n[some], lo[some]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            entries.append(self.order[s][np.repeat(lo, n) + step])
            rows.append(np.repeat(some // len(masks(bits, radius)), n))
        return np.concatenate(rows or [np.zeros(0, int)]), np.concatenate(entries or [np.zeros(0, int)])

    def search(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, id, distance): the k least (distance, id) of each query, the radius growing until they are proved."""
        active = np.arange(len(queries))
        held = np.zeros((0, 3), np.int64)  # query, distance, entry
        done = []
        last = max(b for _, b in self.cut)
        for radius in range(last + 1):
            row, entry = self.met(queries[active], radius)
            q = active[row]
            distance = np.bitwise_count(queries[q] ^ self.codes[entry]).astype(np.int64)
            held = np.concatenate([held, np.stack([q, distance, entry], 1)])
            held = held[np.lexsort((self.ids[held[:, 2]], held[:, 1], held[:, 0]))]
            if len(held):  # an entry that several segments or rounds found follows itself
                held = held[np.concatenate(([True], (held[1:, [0, 2]] != held[:-1, [0, 2]]).any(1)))]
                start = np.searchsorted(held[:, 0], held[:, 0], "left")
                held = held[np.arange(len(held)) - start < k]
            count = np.searchsorted(held[:, 0], active, "right") - np.searchsorted(held[:, 0], active, "left")
            worst = np.full(len(active), BITS + 1)
            full = count == k
            worst[full] = held[np.searchsorted(held[:, 0], active[full], "right") - 1, 1]
            proved = worst <= len(self.cut) * (radius + 1) - 1 if radius < last else np.ones(len(active), bool)
            done.append(held[np.isin(held[:, 0], active[proved])])
            held = held[np.isin(held[:, 0], active[~proved])]
            active = active[~proved]
            if not len(active):
                break
        out = np.concatenate(done)
        return out[:, 0], self.ids[out[:, 2]], out[:, 1]


@lru_cache(maxsize=64)
def masks(bits: int, radius: int) -> np.ndarray:
    """All values of so many bits with exactly `radius` of them set."""
    return np.array([sum(1 << i for i in c) for c in combinations(range(bits), radius)], np.uint64)


def search_block(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest entries of a block for each query of a block."""
    query = pdf["is_query"].to_numpy()
    codes = pdf["code"].to_numpy(np.int64).view(np.uint64)
    entries = pdf.loc[~query]
    if not query.any() or entries.empty:
        return pd.DataFrame({"q": [], "id": [], "distance": []}).astype("int64")
    index = Index(codes[~query], entries["id"].to_numpy(np.int64))
    asked, out = codes[query], []
    for at in range(0, len(asked), 128):
        part = asked[at : at + 128]
        row, found, distance = index.search(part, k)
        out.append(pd.DataFrame({"q": part[row].view(np.int64), "id": found, "distance": distance}))
    return pd.concat(out)


def best(rows: DataFrame, k: int) -> DataFrame:
    """The k least (distance, id) of each query; Spark cuts each task's rows to k before it shuffles them."""
    order = Window.partitionBy("q").orderBy("distance", "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, k: int = 10, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, neighbour_id, distance): the k nearest rows of every row whose id is divisible by `every`.

    Nearest by Hamming distance, then by id; a query is a row itself and finds itself.  Rows without a vector or id
    are neither queries nor answers; repeated rows answer once each; with fewer rows than k all are returned; an
    empty table gives none.  Equal codes are one entry of the index with their k least ids, and equal queries are
    searched once, so a vector that a third of all rows share costs no more than another.
    """
    rows = Stored(sign_codes(vectors, id_col, vec_col).where("id is not null and code is not null"), "codes").read()
    firsts = rows.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("n") <= k).select("code", "id")
    index = Stored(firsts, "index").read()
    queries = rows.where(F.col("id") % every == 0)
    asked = queries.select(F.col("code").alias("q")).distinct()
    blocks, parts = (max(1, -(-n // size)) for n, size in ((index.count(), INDEX_BLOCK), (asked.count(), QUERY_BLOCK)))
    hashed = lambda n: F.pmod(F.xxhash64("code", "id"), F.lit(n)).cast("int")
    every_part, every_block = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (parts, blocks))
    entries = index.select("code", "id", F.lit(False).alias("is_query"), hashed(blocks).alias("block"), every_part.alias("part"))
    probing = asked.select(F.col("q").alias("code"), F.lit(0).cast("long").alias("id"), F.lit(True).alias("is_query"), F.pmod(F.xxhash64("q"), F.lit(parts)).cast("int").alias("part"), every_block.alias("block"))
    both = entries.withColumn("id", F.col("id").cast("long")).unionByName(probing)
    near = both.groupBy("block", "part").applyInPandas(lambda pdf: search_block(pdf, k), "q long, id long, distance long")
    results = best(near, k)
    joined = queries.select(F.col("id").alias("query_id"), F.col("code").alias("q")).join(results, "q")
    return joined.select("query_id", "rank", F.col("id").alias("neighbour_id"), F.col("distance").cast("int").alias("distance"))


def op5_multi_index_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
with d as (select q.vec_id query_id, r.vec_id neighbour_id,
  list_sum(list_transform(list_zip(q.embedding, r.embedding), lambda x: case when (x[1] > 0) <> (x[2] > 0) then 1 else 0 end))::int distance
  from embeddings q join embeddings r on q.vec_id % 50 = 0),
k as (select *, row_number() over (partition by query_id order by distance, neighbour_id)::int "rank" from d)
select query_id, "rank", neighbour_id, distance from k where "rank" <= 10
"""
