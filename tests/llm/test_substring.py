from __future__ import annotations

import random
import re

import numpy as np
import pytest

from tallyforge.llm import substring
from tests.llm.cases import odd_docs


def plainly(rows, width):
    """(id, words, spans, kept) of each row, window by window as tuples of words."""
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least: dict = {}
    for i, w in split:
        for k in range(len(w) - width + 1):
            if i is not None:
                key = tuple(w[k : k + width])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - width + 1):
            if i is not None and least[tuple(w[k : k + width])] < i:
                gone |= set(range(k, k + width))
        starts = [k for k in sorted(gone) if k - 1 not in gone]
        ends = [k + 1 for k in sorted(gone) if k + 1 not in gone]
        out.append((i, len(w), list(zip(starts, ends, strict=True)), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def found(df, width):
    return sorted(((r.doc_id, r.n_words, [(s.start, s.end) for s in r.spans], r.kept) for r in substring.removals(df, width=width).collect()), key=repr)


def corpus(seed: int, n: int = 120):
    """Texts of few words, so that short windows repeat by chance, with passages shared by two to very many texts."""
    r = random.Random(seed)
    passages = [[f"p{k}w{r.randrange(9)}" for _ in range(r.randrange(3, 40))] for k in range(6)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(r.randrange(0, 6)):
            words += r.choice(passages[:1] * 5 + passages) if r.random() < 0.6 else [r.choice("abcdefg") for _ in range(r.randrange(0, 30))]
        rows.append((r.choice([i, i * 3 - 100, 7]) if seed % 2 else i, r.choice([" ", "\n", " \t ", "\x0b"]).join(words)))
    return rows + [(500, "a " * 3000), (501, "a " * 40), (502, None), (503, ""), (None, rows[3][1]), (None, "a " * 50)]


@pytest.mark.parametrize("width", [1, 3, 13])
@pytest.mark.parametrize("seed", [0, 1, 2])
def test_against_windows_as_tuples(spark, width, seed, monkeypatch):
    monkeypatch.setattr(substring, "GROUP", [1 << 20, 700, 64][seed])
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = found(df, width)
    assert got == plainly(rows, width)
    assert width > 3 or any(len(s) > 1 for _, _, s, _ in got)


def test_rolling_hash_is_the_polynomial():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    got = substring.rolled(words, 13, substring.BASE)
    for i in (0, 1, 200, 387):
        h = 0
        for w in words[i : i + 13].tolist():
            h = (h * substring.BASE + w) % 2**64
        h = ((h ^ h >> 32) * int(substring.SPREAD)) % 2**64
        assert int(got[i]) == h ^ h >> 29
    assert len(substring.rolled(words[:12], 13, substring.BASE)) == 0
    assert (substring.rolled(words[50:], 13, substring.BASE) == got[50:]).all()


def test_entries_come_back_and_are_judged():
    rng = np.random.default_rng(4)
    h = np.sort(rng.integers(0, 40, 300).astype(np.uint64) << np.uint64(58))
    c, doc = rng.integers(0, 3, 300).astype(np.uint16), rng.integers(-5, 2**40, 300)
    doc[::3] = 11
    assert all((a == b).all() for a, b in zip(substring.unpacked(substring.packed(h, c, doc)), (h, c, doc), strict=True))
    first, more = substring.judged(h, c, doc)
    least: dict = {}
    for k in zip(h.tolist(), c.tolist(), doc.tolist(), strict=True):
        least[k[:2]] = min(least.get(k[:2], k[2]), k[2])
    assert sorted((int(h[i]), int(c[i]), int(doc[i])) for i in first) == sorted((*k, v) for k, v in least.items())
    assert sorted((int(h[i]), int(c[i]), int(doc[i])) for i in more) == sorted({k for k in zip(h.tolist(), c.tolist(), doc.tolist(), strict=True) if k[2] > least[k[:2]]})


def test_odd_rows(spark):
    docs = odd_docs(spark)
    assert found(docs, 13) == plainly([(r.doc_id, r.text) for r in docs.collect()], 13)
    assert substring.removals(docs.limit(0)).count() == 0
    assert found(docs.withColumnRenamed("node", "h").withColumnRenamed("lang", "__lost"), 2) == plainly([(r.doc_id, r.text) for r in docs.collect()], 2)
    long = " ".join(f"w{i}" for i in range(300_000))
    got = {r.doc_id: r for r in substring.removals(spark.createDataFrame([(2, long), (1, "x " + long[:200_000])], "doc_id long, text string")).collect()}
    assert got[1].spans == [] and got[2].spans[0].start == 0 and len(got[2].spans) == 1 and got[2].n_words == 300_000


def test_vocabulary_forgets_between_texts(monkeypatch):
    monkeypatch.setattr(substring.Vocabulary, "MOST", 10)
    monkeypatch.setattr(substring, "SPLIT", 16)
    words = substring.Vocabulary()
    text = " ".join(f"word{i}" for i in range(50))
    a, _ = substring.windows(words.rows(text), words.columns, 5)
    words.rows("other " * 5)
    b, _ = substring.windows(words.rows("  " + text), words.columns, 5)
    assert (a == b).all() and len(a) == 46
