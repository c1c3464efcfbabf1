from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from tallyforge.llm import fim
from tests.llm.cases import odd_docs, texts

PATTERN = {"lines": r"[^\n]*\n|[^\n]+", "characters": r"(?s).", "words": r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+"}


def plainly(doc_id, text, units="lines", seed=7, rate=100, spm=50):
    """One text at a time, unit by unit."""
    text = text or ""
    if units == "words":
        parts = re.findall(r"[\x20\x09-\x0D]+(?=[^\x20\x09-\x0D])|[^\x20\x09-\x0D]+(?:[\x20\x09-\x0D]+|$)|[\x20\x09-\x0D]+$", text)
    else:
        parts = re.findall(PATTERN[units], text)
    assert "".join(parts) == text
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(parts)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < spm:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def many(k=120):
    random.seed(4)
    pool = ["a", "é", "日", "😀", "\n", "\n", "\n\n", " ", "\r\n", "word", "\x0b", "\x85", " "]
    out = ["".join(random.choices(pool, k=random.randrange(0, 90))) for _ in range(k)]
    return [*texts(), *out, "\n", "\n\n\n", "x\n", "\nx", "has <P> in it\nmore", "<M>", "line\n" * 9000, "<", None]


@pytest.mark.parametrize("units", ["lines", "characters", "words"])
@pytest.mark.parametrize("chunk", [1, 2, 7, 4096])
def test_against_unit_by_unit(spark, units, chunk):
    rows = [(i * 37 - 50, t) for i, t in enumerate(many(40 if chunk < 7 else 120)) if chunk > 2 or len(t or "") < 3000]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = sorted((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, bytes(r.output).decode()) for r in fim.transform(df, units=units, chunk=chunk, rate=80).collect())
    assert got == sorted(plainly(i, t, units, rate=80) for i, t in rows)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}


def test_only_owning_chunks_are_scanned_again(monkeypatch):
    buffer = np.frombuffer(b"ab\n" * 4000, np.uint8)
    chunks = fim.Chunks(buffer, np.array([0]), np.array([len(buffer)]), fim.UNITS["lines"], 100)
    seen = []
    of = chunks.boundaries
    monkeypatch.setattr(chunks, "boundaries", lambda k: seen.append(k) or of(k))
    assert chunks.places(np.array([1000, 3000])).tolist() == [3003, 9003] and seen == [30, 90]


def test_texts_come_back(spark):
    for form in ("psm", "spm"):
        assert fim.restored(form, fim.arranged(form, b"one", b"", b"three")) == b"onethree"
    with pytest.raises(ValueError):
        fim.restored("psm", b"<S>a<P>b<M>c")
    rows = list(enumerate(many()))
    got = fim.digests(fim.transform(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert {r.doc_id: r.restored_sha256 for r in got} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in rows}


def test_odd_rows(spark):
    docs = odd_docs(spark)
    got = fim.transform(docs).collect()
    want = [plainly(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, bytes(r.output).decode()) for r in got), key=repr) == sorted(want, key=repr)
    assert fim.digests(fim.transform(docs.limit(0))).count() == 0
    with pytest.raises(ValueError):
        fim.transform(docs, units="pages")
    long = "a long line\n" * 400_000
    one = fim.transform(spark.createDataFrame([(5, long)], "doc_id long, text string")).first()
    assert (one.n, bytes(one.output).decode()) == (plainly(5, long)[1], plainly(5, long)[5])
