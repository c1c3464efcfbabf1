from __future__ import annotations

import random

import numpy as np
import pytest

from tallyforge.llm import ngramjoin as nj
from tests.llm.cases import odd_docs


def shingles(text: str | None, width: int) -> frozenset:
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if len(words) >= width else frozenset([tuple(words)])


def brute(rows: list[tuple], width: int, percent: int) -> tuple[dict, int]:
    """Least id a row's links reach, by comparing all pairs."""
    sets, up = [shingles(t, width) for _, t in rows], list(range(len(rows)))

    def root(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    links = 0
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    links += 1
                    up[root(i)] = root(j)
    out: dict = {}
    for i, (d, _) in enumerate(rows):
        ids = [e for k, (e, _) in enumerate(rows) if root(k) == root(i) and e is not None]
        out[i] = min(ids) if ids and sets[i] else d
    return out, links


def edited(words: list[str], k: int, pool: list[str]) -> list[str]:
    words = list(words)
    for _ in range(k):
        i, how = random.randrange(len(words)), random.random()
        if how < 0.6:
            words[i] = random.choice(pool)
        elif how < 0.8:
            words.insert(i, random.choice(pool))
        else:
            del words[i]
    return words


def corpus(seed: int) -> list[tuple]:
    random.seed(seed)
    pool = [f"w{i}" for i in range(3000)]
    docs = []
    for size, copies, most in ((180, 90, 12), (60, 40, 4), (25, 30, 2), (9, 20, 1)):
        base = [random.choice(pool) for _ in range(size)]
        docs += [edited(base, random.randrange(most + 1), pool) for _ in range(copies)]
    walk = [random.choice(pool) for _ in range(150)]
    for _ in range(25):
        walk = edited(walk, 2, pool)
        docs.append(walk)
    passage = [random.choice(pool) for _ in range(60)]
    docs += [[random.choice(pool) for _ in range(20)] + passage + [random.choice(pool) for _ in range(20)] for _ in range(40)]
    docs += [docs[3]] * 20 + [[], ["a"], ["A"], ["a", "b", "c"], ["a", "b", "c", "d"], ["a", "b", "c", "d", "e"]]
    random.shuffle(docs)
    return [(i * 3 + 1, " ".join(d)) for i, d in enumerate(docs)]


@pytest.mark.parametrize(("width", "percent", "block"), [(4, 85, 1024), (4, 85, 25), (5, 80, 40)])
def test_groups_by_brute_force(spark, monkeypatch, width, percent, block):
    monkeypatch.setattr(nj, "BLOCK_MEMBERS", block)
    rows = corpus(width * block)
    want, links = brute(rows, width, percent)
    assert links > 200
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in nj.groups(df, width=width, percent=percent).collect()}
    assert len(got) == len(rows)
    for i, (d, t) in enumerate(rows):
        assert got[d].component_id == want[i]
        assert got[d].n_shingles == len(shingles(t, width))


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_linked_sets_share_what_they_need(percent):
    rng = np.random.default_rng(percent)
    linked = 0
    for trial in range(3000):
        n = int(rng.integers(1, 30 if trial % 2 else 400))
        s = rng.integers(0, 2**63, n).astype(np.uint64)
        d = int(rng.integers(0, n // 5 + 1))
        cut = int(rng.integers(0, d + 1))
        t = np.unique(np.concatenate([s[cut:], rng.integers(0, 2**63, d - cut).astype(np.uint64)]))
        s = np.unique(s)
        common = len(np.intersect1d(s, t))
        if len(t) and 100 * common >= percent * (len(s) + len(t) - common):
            linked += 1
            (a, need_a), (b, need_b) = nj.signatures(s, percent), nj.signatures(t, percent)
            assert len(np.intersect1d(a, b)) >= max(need_a, need_b, 1)
    assert linked > 500


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want, _ = brute(rows, 4, 85)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in nj.groups(docs).collect())
    assert got == sorted((str(d), len(shingles(t, 4)), str(want[i])) for i, (d, t) in enumerate(rows))
    assert nj.groups(docs.limit(0)).count() == 0
    alone = docs.where("doc_id in (2, 3)")
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in nj.groups(alone).collect()} == {(2, 0, 2), (3, 0, 3)}


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, k) for k in range(200, 230)] + [(1, 2), (2, 1), (3, 3)]
    got = {r.u: r.v for r in nj.components(spark.createDataFrame(edges, "a long, b long")).read().collect()}
    assert all(got[i] == 100 for i in range(101, 141)) and all(got[k] == 7 for k in range(200, 230)) and got[2] == 1


def test_rounds_see_few_edges_of_a_large_group(spark, monkeypatch):
    """All of 600 nodes have edges to six of twelve hubs, and the hubs make a path whose order isn't that of their ids."""
    seen = []

    class Counted(nj.Stored):
        def __init__(self, df, name):
            super().__init__(df, name)
            if name == "stars":
                seen.append(self.read().count())

    monkeypatch.setattr(nj, "Stored", Counted)
    rng = random.Random(3)
    hubs = rng.sample(range(100, 200), 12)
    edges = [(k, h) for k in range(1000, 1600) for h in rng.sample(hubs, 6)] + list(zip(hubs, hubs[1:], strict=False)) + [(9, 5), (7, 9), (7, 8)]
    got = {r.u: r.v for r in nj.components(spark.createDataFrame(edges, "a long, b long")).read().collect()}
    assert got == {k: min(hubs) for k in [*hubs, *range(1000, 1600)] if k != min(hubs)} | {k: 5 for k in (7, 8, 9)}
    assert sum(seen) < 600  # 3,614 edges


def test_a_link_runs_through_a_row_without_an_id(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join(words[3:] + ["a", "b", "c"]), " ".join(words[6:] + ["a", "b", "c", "d", "e", "f"])]
    ids = [1, None, 3]
    with_id = nj.groups(spark.createDataFrame(list(zip([1, 2, 3], texts, strict=True)), "doc_id long, text string"))
    without = nj.groups(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string"))
    want = {r.doc_id: r.component_id for r in with_id.collect()}
    assert want == {1: 1, 2: 1, 3: 1}
    assert {r.doc_id: r.component_id for r in without.collect()} == {1: 1, None: 1, 3: 1}


def test_components_that_dont_settle_are_an_error(spark):
    path = spark.range(40).selectExpr("id a", "id + 1 b")
    with pytest.raises(RuntimeError, match="settle"):
        nj.components(path, most_rounds=1)


def test_quoted_passages_dont_keep_unlike_texts_in_one_family(spark, monkeypatch):
    """All quote one passage and so share signatures, but only the three copies of each are alike."""
    rng = random.Random(5)
    pool = [f"w{i}" for i in range(3000)]
    passage = rng.choices(pool, k=90)
    texts = []
    for _ in range(30):
        own = rng.choices(pool, k=60)
        texts += [own[:30] + passage + own[30:] + extra for extra in ([], ["x"], ["y", "z"])]
    rows = [(i, " ".join(x)) for i, x in enumerate(texts)]
    monkeypatch.setattr(nj, "BLOCK_MEMBERS", 20)
    monkeypatch.setattr(nj, "MOST_SENT", 0)  # and the texts are shuffled
    monkeypatch.setattr(nj.Linker, "compare_blocks", lambda self, nodes: pytest.fail("nodes are compared with all of their family"))
    got = {r.doc_id: r.component_id for r in nj.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 3 for i in got} and len(got) == 90


@pytest.mark.parametrize("paired", [1, 4, 64])
def test_large_families_by_brute_force(spark, monkeypatch, paired):
    """Taken apart by pairs alone, by frequent signatures alone, and by both."""
    monkeypatch.setattr(nj, "BLOCK_MEMBERS", 12)
    monkeypatch.setattr(nj, "PAIRED", paired)
    rows = corpus(paired)
    want, _ = brute(rows, 4, 85)
    got = {r.doc_id: r.component_id for r in nj.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {d: want[i] for i, (d, _) in enumerate(rows)}


def test_sketches_of_linked_sets_differ_in_few_bits():
    rng = np.random.default_rng(9)
    for n in (1, 5, 200, 5000):
        s = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        t = np.unique(np.concatenate([s[n // 10 :], rng.integers(0, 2**63, n // 10).astype(np.uint64)]))
        bits = sum(int(x).bit_count() for x in (nj.sketch(s) ^ nj.sketch(t)).view(np.uint64))
        assert len(nj.sketch(s)) == nj.SKETCH and bits <= len(np.setxor1d(s, t))
        assert n != 200 or sum(int(x).bit_count() for x in (nj.sketch(s) ^ nj.sketch(~s)).view(np.uint64)) > 150
