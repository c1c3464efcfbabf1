"""URL rules by a Bloom filter cascade: exact membership over the corpus's complete key universe, without joins.

A cascade's first level encodes the listed keys.  The keys of the corpus that pass it though they aren't listed are
its false positives; the second level encodes these, the third the listed keys that pass the second, and so on
until a level has no false positives.  The first level that lacks a key decides: levels 1, 3, ... say it isn't
listed, levels 2, 4, ... that it is.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table

#: Most keys of a list; list and cascade are held whole by the driver and every task (about 100 bytes a key).
MOST_LISTED = 2_000_000

RULES = (("block", "example.com", "/en/"), ("allow", "com", "/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


@dataclass
class Bloom:
    bits: bytearray
    size: int
    hashes: int
    seed: int

    @staticmethod
    def of(keys: Iterable[str], rate: float, seed: int) -> Bloom:
        keys = list(keys)
        size = max(64, math.ceil(-len(keys) * math.log(rate) / math.log(2) ** 2))
        out = Bloom(bytearray(-(-size // 8)), size, max(1, round(-math.log2(rate))), seed)
        for key in keys:
            for p in out.places(key):
                out.bits[p >> 3] |= 1 << (p & 7)
        return out

    def places(self, key: str) -> Iterator[int]:
        import xxhash

        h = xxhash.xxh3_128_intdigest(key, self.seed)
        a, b = h & (1 << 64) - 1, h >> 64 | 1
        return ((a + i * b) % self.size for i in range(self.hashes))

    def __contains__(self, key: str) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self.places(key))


@dataclass
class Cascade:
    levels: list[Bloom]

    def __contains__(self, key: str) -> bool:
        for i, level in enumerate(self.levels):
            if key not in level:
                return i % 2 == 1
        return len(self.levels) % 2 == 1


def cascade(listed: set[str], false_positives: Iterable[str], first: Bloom) -> Cascade:
    """All levels, once the corpus's false positives of the first are known."""
    levels, encode, other, seed = [first], set(false_positives), set(listed), first.seed
    while encode:
        seed += 1
        level = Bloom.of(encode, 0.5, seed)
        levels.append(level)
        encode, other = {k for k in other if k in level}, encode
    return Cascade(levels)


def build(universe: DataFrame, key_col: str, listed: Iterable[str], seed: int = 1) -> Cascade:
    """The cascade that is exact for every key of the universe (a column of strings, repeats allowed, nulls left out).

    The first level's rate is set so that about as many keys pass it wrongly as are listed; should more than the
    stated bound pass, it is made stricter and the universe scanned again, so what the driver gathers is bounded by
    the list's length whatever the corpus holds.
    """
    listed = set(listed)
    if len(listed) > MOST_LISTED:
        raise ValueError(f"a list may have {MOST_LISTED} keys")
    if not listed:
        return Cascade([Bloom.of((), 0.5, seed)])
    keys = universe.select(F.col(key_col).alias("key")).where("key is not null")
    n = keys.agg(F.approx_count_distinct("key")).first()[0]
    rate = min(0.5, max(1e-9, len(listed) / (math.sqrt(2) * max(1, n))))
    bound = 4 * len(listed) + 1000
    while True:
        first = Bloom.of(listed, rate, seed)
        wrong = passing(keys, first, listed).distinct().limit(bound + 1).collect()
        if len(wrong) <= bound:
            return cascade(listed, (r.key for r in wrong), first)
        rate, seed = rate / 16, seed + 1000


def passing(keys: DataFrame, level: Bloom, listed: set[str]) -> DataFrame:
    """The keys that pass a level though they aren't listed."""

    def make():
        seen: set[str] = set()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            if len(seen) > 200_000:
                seen.clear()
            new = set(batch.column(0).to_pylist()) - seen
            seen.update(new)
            return pa.RecordBatch.from_arrays([pa.array([k for k in new if k not in listed and k in level], pa.string())], ["key"])

        return each

    return map_arrow(keys, make, "key string")


def split_url(url: str | None) -> tuple[str, str]:
    """Host, with A-Z in lower case, and path.  Null or no "://": both empty."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for c in "?#" if (i := rest.find(c)) >= 0), default=len(rest))
    rest = rest[:end]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return lower_ascii(host), path


def lower_ascii(text: str) -> str:
    return text.lower() if text.isascii() else "".join(c.lower() if c.isascii() else c for c in text)


def candidates(host: str, path: str, lengths: tuple[int, ...]) -> list[str]:
    """The keys of rules that could fit, longest first: each domain that the host lies in, with each start of the path that has a rule's length."""
    out, at = [], 0
    while host:
        out += [host[at:] + path[:n] for n in lengths if n <= len(path)]
        at = host.find(".", at) + 1
        if not at:
            break
    return sorted(set(out), key=lambda k: (-len(k), k))


def key_universe(pages: DataFrame, url_col: str, lengths: tuple[int, ...]) -> DataFrame:
    """Every key that a lookup over these pages can ask for."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys: set[str] = set()
            for x in batch.column(0):
                keys.update(candidates(*split_url(x.as_py()), lengths))
            return pa.RecordBatch.from_arrays([pa.array(list(keys), pa.string())], ["key"])

        return each

    return map_arrow(pages.select(url_col), make, "key string")


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id_col, host, path, rule, verdict) for every row.

    Of the rules (verdict, host, path) that fit, the one with the longest host and path wins; two lists that hold the
    same rule: block wins.  Where none fits, the url is in no list and gets `default`.  Null urls and urls without
    "://" have an empty host and path and fit nothing; repeated rows stay.
    """
    rules = [(v, lower_ascii(h), p) for v, h, p in rules]
    lengths = tuple(sorted({len(p) for _, _, p in rules}))
    universe = key_universe(pages, url_col, lengths)
    block = build(universe, "key", {h + p for v, h, p in rules if v == "block"}, 1)
    allow = build(universe, "key", {h + p for v, h, p in rules if v == "allow"}, 501)
    kind = dict(pages.dtypes)[id_col]

    def make():
        known: dict[tuple[str, ...], tuple[str | None, str]] = {}

        def decide(keys: tuple[str, ...]) -> tuple[str | None, str]:
            for key in keys:
                if key in block:
                    return key, "block"
                if key in allow:
                    return key, "allow"
            return None, default

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            if len(known) > 200_000:
                known.clear()
            for x in batch.column(1):
                host, path = split_url(x.as_py())
                keys = tuple(candidates(host, path, lengths))
                if keys not in known:
                    known[keys] = decide(keys)
                rows.append((host, path, *known[keys]))
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in zip(*rows, strict=True))], [id_col, "host", "path", "rule", "verdict"])

        return each

    return map_arrow(pages.select(id_col, url_col), make, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")


def op7_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


OP7_SQL = """
with u as (select page_id, case when url like '%://%' then regexp_extract(url, '^.*?://([^?#]*)', 1, 's') else '' end r from pages),
s as (select page_id, translate(split_part(r, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
  case when strpos(r, '/') > 0 then substr(r, strpos(r, '/')) else '' end path from u),
rules(verdict, h, p) as (values ('block', 'example.com', '/en/'), ('allow', 'com', '/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m as (select page_id, arg_max(h || p, length(h || p)) rule, arg_max(verdict, length(h || p)) verdict
  from s join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id)
select page_id, host, path, rule, coalesce(verdict, 'allow') verdict from s left join m using (page_id)
"""
