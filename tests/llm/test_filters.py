from __future__ import annotations

import random

import numpy as np
import pytest

from tallyforge.llm import hamming, langid, sharding, urlfilter
from tests.llm.cases import odd_docs

URLS = [None, "", "no scheme", "http://A.Example.COM/en/x?y#z", "https://www.example.com/en/", "http://www.example.com/fr", "http://example.com/en", "ftp://net/es/1", "x://sub.net/fr/2#f", "http://notexample.com/en/", "http://com", "a://b://c.net/es/", "http://É.com/en/", "http://.com/", "http://h.net?/es/"]


def plain(url: str | None, rules) -> tuple:
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        for c in "?#":
            rest = rest.split(c, 1)[0]
        host, _, tail = rest.partition("/")
        path = "/" + tail if "/" in rest else ""
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule = max(fits, default=(0, None, "allow"))
    return host, path, rule[1], rule[2]


def test_urls(spark):
    random.seed(3)
    rows = list(enumerate(URLS)) + [(100 + i, f"http://{random.choice(['a.', 'b.c.', ''])}{random.choice(['example.com', 'x.net', 'com', 'org'])}/{random.choice(['en', 'es', 'fr'])}/{i}") for i in range(300)]
    df = spark.createDataFrame(rows + rows[:5], "page_id long, url string").repartition(3)
    got = urlfilter.judge(df).collect()
    assert len(got) == len(rows) + 5
    urls = dict(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == plain(urls[r.page_id], urlfilter.RULES)
    assert urlfilter.judge(df.limit(0)).count() == 0


def test_cascade_is_exact(spark):
    random.seed(9)
    keys = [f"key{i}" for i in range(20_000)]
    listed = set(random.sample(keys, 700)) | {"outside"}
    df = spark.createDataFrame([(k,) for k in keys] * 2 + [(None,)], "key string")
    c = urlfilter.build(df, "key", listed)
    assert len(c.levels) >= 3
    assert all((k in c) == (k in listed) for k in keys)
    assert sum(len(b.bits) for b in c.levels) < 700 * 8
    empty = urlfilter.build(df, "key", [])
    assert not any(k in empty for k in keys[:500])


def test_jump_hash(spark):
    def jump(key: int, n: int) -> int:
        b, j = -1, 0
        while j < n:
            b = j
            key = (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
        return b

    keys = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 2000)
    for n in (1, 2, 8, 9, 1000):
        assert sharding.jump(keys, n).tolist() == [jump(int(k) % 2**64, n) for k in keys]
    a, b = sharding.jump(keys, 8), sharding.jump(keys, 9)
    assert set(b[a != b]) == {8} and 130 < (a != b).sum() < 320
    with pytest.raises(ValueError):
        sharding.jump(keys, 0)


def test_slots_have_no_gaps(spark):
    docs = odd_docs(spark)
    got = sharding.assign(docs.select("doc_id", "text"), "doc_id", 3).collect()
    assert len(got) == docs.count()
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r.grown_shard in (r.shard, 3) for r in got)
    assert sharding.assign(docs.limit(0), "doc_id", 3).count() == 0


@pytest.mark.parametrize("kind", ["random", "clusters", "same", "few"])
def test_top_k_by_brute_force(kind):
    rng = np.random.default_rng(1)
    n = 7 if kind == "few" else 1500
    codes = rng.integers(0, 2**63, n).astype(np.uint64)
    if kind == "clusters":
        codes = codes[:15][rng.integers(0, 15, n)] ^ np.uint64(1) << rng.integers(0, 63, n).astype(np.uint64)
    if kind == "same":
        codes[:] = 3
    ids = rng.permutation(n).astype(np.int64)
    row, found, distance = hamming.Index(codes, ids).search(codes[:60], 10)
    for q in range(min(60, n)):
        d = np.bitwise_count(codes ^ codes[q]).astype(int)
        best = np.lexsort((ids, d))[:10]
        assert sorted(zip(distance[row == q].tolist(), found[row == q].tolist(), strict=True)) == sorted(zip(d[best].tolist(), ids[best].tolist(), strict=True))


def test_top_k_of_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(hamming, "INDEX_BLOCK", 40)
    monkeypatch.setattr(hamming, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.standard_normal(64)], 0) for i in range(150)] + [(200 + i, [1.0] * 64, 0) for i in range(60)] + [(300, None, 0), (None, [1.0], 0), (350, [float("nan"), None], 0), (50, [1.0] * 64, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int").repartition(3)
    code = {}
    entries = []
    for i, v, _ in rows:
        if i is not None and v is not None:
            c = sum(1 << k for k, x in enumerate(v) if x is not None and x > 0)
            entries.append((i, c))
            code.setdefault(i, []).append(c)
    want = []
    for i, c in entries:
        if i % 50 == 0:
            near = sorted((bin(c ^ e).count("1"), j) for j, e in entries)[:10]
            want += [(i, r + 1, j, d) for r, (d, j) in enumerate(near)]
    got = [tuple(r) for r in hamming.top_k(df).collect()]
    assert sorted(got) == sorted(want)
    assert hamming.top_k(df.limit(0)).count() == 0


def test_language_id(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs)
    got = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 30 and sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    odd = odd_docs(spark)
    rows = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert rows[2].lang_pred == rows[3].lang_pred == rows[4].lang_pred == rows[6].lang_pred == "und"
    assert rows[1].lang_pred in {"en", "de", "fr", "es"}
    nothing = langid.train(odd.limit(0))
    assert {r.lang_pred for r in langid.identify(odd, nothing).collect()} == {"und"}
    one = langid.train(odd.where("lang = 'en'"))
    assert langid.identify(odd, one).count() == odd.count()


def test_labels_of_held_out_rows_teach_nothing(spark, sf):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    spoiled = docs.withColumn("lang", F.when(langid.fold() == 1, "xx").otherwise(F.col("lang")))
    a = {r.doc_id: r.lang_pred for r in langid.identify(docs, langid.train(docs)).collect()}
    assert a == {r.doc_id: r.lang_pred for r in langid.identify(spoiled, langid.train(spoiled)).collect()}


def test_shards_name_clashing_columns_and_keep_null_keys_apart(spark):
    rows = spark.createDataFrame([(None, 1), ("", 2), ("n", 3), (None, 4)] + [("hot", i) for i in range(500)], "k string, v long")
    out = sharding.assign(rows, "k", 8, order=["v"]).collect()
    assert len(out) == 504 and len({r.shard for r in out if r.k == "hot"}) == 1 and len({r.shard for r in out if r.k is None}) == 1
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert all(r.grown_shard in (r.shard, 8) for r in out)
    for name in ("shard", "slot", "grown_shard"):
        with pytest.raises(ValueError, match=name):
            sharding.assign(rows.withColumn(name, sharding.F.lit(1)), "k", 8)
