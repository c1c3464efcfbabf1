from __future__ import annotations

import re

from pyspark.sql import functions as F

from tallyforge.llm import langid

WORDS = {"sv": "och det som en på är av för med till", "pl": "nie jest się na do że jak ale tak co"}


def test_copies_dont_shrink_a_language(spark, monkeypatch):
    """A language of few texts beside many copies of one of them is sampled whole and learned."""
    own = spark.range(80).select(
        F.concat(F.lit("own-"), F.col("id")).alias("doc_id"),
        F.when(F.col("id") % 2 == 0, "sv").otherwise("pl").alias("lang"),
        F.concat_ws(" ", F.when(F.col("id") % 2 == 0, WORDS["sv"]).otherwise(WORDS["pl"]), F.repeat(F.lit("x"), F.col("id").cast("int"))).alias("text"),
    )
    copies = spark.range(60_000).select(F.concat(F.lit("copy-"), F.col("id")).alias("doc_id"), F.lit("sv").alias("lang"), F.lit("och " + WORDS["sv"]).alias("text"))
    docs = own.unionByName(copies)
    seen: list[list[str]] = []
    monkeypatch.setattr(langid, "fit", lambda x, langs, families, fit=langid.fit: seen.append(langs) or fit(x, langs, families))
    model = langid.train(docs)
    want = docs.where(langid.fold() != 1).groupBy("lang").agg(F.countDistinct("text").alias("n"))
    assert {v: seen[0].count(v) for v in WORDS} == {r.lang: r.n for r in want.collect()}
    got = langid.identify(own, model).join(own.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 80 and all(r.lang_pred == r.lang for r in got)


def test_the_sample_is_the_distinct_texts_of_least_hash(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_A_LANGUAGE", 5)
    rows = spark.range(3000).select(F.col("id").cast("string").alias("doc_id"), F.lit("sv").alias("lang"), F.concat(F.lit("ord "), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("text"))
    docs = rows.unionByName(rows)
    seen: list = []
    monkeypatch.setattr(langid, "fit", lambda x, langs, families: seen.append(x))
    langid.train(docs)
    least = rows.where(langid.fold() != 1).select("text", F.xxhash64("text").alias("h")).orderBy("h").limit(5).collect()
    assert all(re.fullmatch("ord [a-j]+", r.text) for r in least)
    x, np = seen[0], langid.np
    dense = np.zeros((len(x), langid.FEATURES), "float32")
    for i in range(len(x)):
        dense[i, x.bins[x.starts[i] : x.starts[i + 1]]] = x.values[x.starts[i] : x.starts[i + 1]]
    want = np.stack([langid.vector(langid.letters(r.text)) for r in least])
    assert (dense == want.astype("float32")).all()


def test_against_plain_machines(spark, sf):
    """Every prediction of op10 is what dense machines, fitted row by row on the same sample, say."""
    np = langid.np
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text", "lang", (langid.fold() == 1).alias("held_out")).collect()
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    taught = {(r.lang, r.text) for r in rows if not r.held_out and r.lang is not None and r.text is not None}
    sample = [(v, t) for v in sorted({v for v, _ in taught}) for t in sorted((t for w, t in taught if w == v), key=hashes.get)[: langid.SAMPLE_A_LANGUAGE] if langid.letters(t)]
    x = np.stack([np.append(langid.vector(langid.letters(t)), 1) for _, t in sample])

    def machine(part, y):
        w, a, rng = np.zeros(x.shape[1]), np.zeros(len(part)), np.random.default_rng(5)
        cost = np.where(y > 0, 10 * len(y) / (2 * (y > 0).sum()), 10 * len(y) / (2 * (y < 0).sum()))
        for _ in range(30):
            old = a.copy()
            for i in rng.permutation(len(part)):
                v = x[part[i]]
                new = max(0.0, a[i] - (y[i] * (v @ w) - 1 + a[i] / (2 * cost[i])) / (v @ v + 1 / (2 * cost[i])))
                w, a[i] = w + (new - a[i]) * y[i] * v, new
            if abs(a - old).max() < 1e-3:
                break
        return w

    lang = np.array([v for v, _ in sample])
    family = np.array([langid.FAMILIES.get(v, v) for v in lang])
    names = sorted(set(family))
    first = [machine(np.arange(len(x)), np.where(family == f, 1, -1)) for f in names]
    inner = {(a, b): machine(np.flatnonzero((lang == a) | (lang == b)), np.where(lang[(lang == a) | (lang == b)] == a, 1, -1)) for f in names for a in sorted(set(lang[family == f])) for b in sorted(set(lang[family == f])) if a < b}
    got = {(r.doc_id, r.held_out): r.lang_pred for r in langid.op10_language_id(spark, sf).collect()}
    wrong = 0
    for r in rows:
        raw = langid.letters(r.text)
        if not raw:
            assert got[(r.doc_id, r.held_out)] == langid.UND
            continue
        v = np.append(langid.vector(raw), 1)
        f = names[int(np.argmax([w @ v for w in first]))]
        wins = {a: sum((w @ v > 0) if p == a else (w @ v <= 0) for (p, q), w in inner.items() if a in (p, q)) for a in set(lang[family == f])}
        most = [a for a in sorted(wins) if wins[a] == max(wins.values())]
        wrong += got[(r.doc_id, r.held_out)] not in most
    assert wrong == 0
