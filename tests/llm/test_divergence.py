from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyforge.llm import divergence
from tests.llm.cases import odd_docs

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plainly(rows):
    """Rows (lang, source, part, item, value, rank) from (lang, source, text), term by term."""
    docs, counts, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
        sources[lang].add(source)
    out = []
    for lang, names in sources.items():
        kept = [t for t, d in docs[lang].items() if d >= 3]
        whole = Counter()
        for s in names:
            whole.update({t: counts[lang, s][t] for t in kept})

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 1) // (total + len(kept)) for t in kept}

        q = shares(whole)
        p = {s: shares(counts[lang, s]) for s in names}
        for s in names:
            parts = {
                "pair": [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in names if o != s],
                "term": [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]],
            }
            for part, found in parts.items():
                out += [(lang, s, part, item.decode(), -v, r) for r, (v, item) in enumerate(sorted(found), 1) if part == "pair" or r <= 200]
    return sorted(out)


def corpus(seed: int, sources: int):
    r = random.Random(seed)
    words = ["été", "Ete", "日本", "a", "B", "b", "😀x", "don't", "x_y"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = []
    for _ in range(250):
        source = r.choice(["hot"] * sources + [f"s{i}" for i in range(sources - 1)] + [None])
        rows.append((r.choice(["en", "en", "en", "de", None]), source, " ".join(r.choice(words[: 30 + 10 * len(source or "")]) for _ in range(r.randrange(0, 60)))))
    return rows + [("xx", "one", "alone"), ("yy", "one", ""), ("yy", "two", None), ("yy", None, "rare")]


@pytest.mark.parametrize(("block", "chunk", "run"), [(64, 4096, 16), (2, 16, 3), (1, 7, 1)])
def test_against_term_by_term(spark, block, chunk, run, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 100 if block < 64 else 200_000)
    rows = corpus(block, 5)
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    assert sorted(map(tuple, divergence.audit(df, block=block, chunk=chunk, run=run).collect())) == plainly(rows)


def test_only_the_greatest_terms(spark, monkeypatch):
    rows = [("en", s, f"{s} " + " ".join(f"t{chr(97 + i % 26)}{chr(97 + i // 26)}" * (1 + (i % 3 == 0)) for i in range(600) if s == "a" or i % 2)) for s in ("a", "b") for _ in range(3)]
    got = sorted(map(tuple, divergence.audit(spark.createDataFrame(rows, "lang string, source string, text string")).collect()))
    assert got == plainly(rows) and max(r[5] for r in got if r[2] == "term") == 200


def test_long_division_is_exact(spark):
    n = np.array([[0, 5, 10**9, 8_999_999_999_999_998]], np.int64)
    whole = np.array([[9_000_000_000_000_000]], np.int64)
    want = [1 + 10**9 * (int(x) + 1) // int(whole[0, 0]) for x in n[0]]
    assert divergence.shares(n, whole)[0].tolist() == want
    df = spark.createDataFrame([(int(x), int(whole[0, 0])) for x in n[0]], "n long, total long").coalesce(1)
    assert [r[0] for r in df.select(divergence.share("n", "total", "0L")).collect()] == want


def test_odd_rows(spark):
    docs = odd_docs(spark).withColumnRenamed("node", "g").withColumnRenamed("n_chars", "term")
    got = sorted(map(tuple, divergence.audit(docs).collect()))
    assert got == plainly([(r.lang, r.source, r.text) for r in docs.collect()])
    assert divergence.audit(docs.limit(0)).count() == 0
    long = [("en", s, "long Text, " * 300_000) for s in ("a", "a", "b")]
    assert sorted(map(tuple, divergence.audit(spark.createDataFrame(long, "lang string, source string, text string")).collect())) == plainly(long)
