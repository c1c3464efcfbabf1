from __future__ import annotations

import random

import corpus_pipeline
from tallyforge.llm import ngramjoin, stages
from tests.llm.test_ngramjoin import brute

SCHEMA = "doc_id long, text string, source string"
ONE, TWO, THREE = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")


def kept(spark, rows):
    return sorted(map(tuple, stages.one_of_each_group(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)


def test_rows_of_one_id_with_different_texts_stay(spark):
    assert kept(spark, [(1, ONE, "x"), (1, TWO, "y"), (2, THREE, "x")]) == sorted([(1, ONE, "x"), (1, TWO, "y"), (2, THREE, "x")], key=str)


def test_a_copy_goes_though_its_id_has_a_row_that_stays(spark):
    near = ONE + " end"
    assert kept(spark, [(1, ONE, "x"), (5, TWO, "y"), (5, near, "y")]) == sorted([(1, ONE, "x"), (5, TWO, "y")], key=str)


def test_repeated_rows_and_rows_without_an_id(spark):
    near = TWO + " end"
    rows = [(1, ONE, "x"), (1, ONE, "x"), (None, ONE, "z"), (None, TWO, "x"), (None, near, "x"), (None, "", "x"), (None, "", "x"), (3, THREE, "a"), (3, THREE, "b")]
    got = kept(spark, rows)
    assert [r for r in got if r[0] == 1] == [(1, ONE, "x")] and len([r for r in got if r[0] == 3]) == 1
    assert sorted((r[1] == "", r[1] in (TWO, near)) for r in got if r[0] is None) == [(False, True), (True, False), (True, False)]


def test_a_large_group_of_near_copies_has_few_edges_in_the_rounds(spark, monkeypatch):
    edges, rounds = [], []

    class Counted(ngramjoin.Stored):
        def __init__(self, df, name):
            super().__init__(df, name)
            if name in ("members", "stars"):
                (edges if name == "members" else rounds).append(self.read().distinct().count())

    monkeypatch.setattr(ngramjoin, "Stored", Counted)
    rng = random.Random(1)
    base, rows = ONE.split(), []
    for i in range(500):
        words = list(base)
        for _ in range(rng.randrange(1, 4)):
            words[rng.randrange(60)] = rng.choice(TWO.split())
        rows.append((i, " ".join(words), "x"))
    want, _ = brute([r[:2] for r in rows], 5, 80)
    assert kept(spark, rows) == sorted((r for r in rows if want[r[0]] == r[0]), key=str)
    assert sum(rounds) < sum(edges) / 2


def test_run_reads_what_each_stage_wrote(spark, tmp_path, monkeypatch):
    spark.range(5).write.parquet(str(tmp_path / "documents.parquet"))
    plans: list[str] = []

    def stage(spark, docs, sf_dir):
        plans.append(docs.inputFiles()[0])
        return docs.where("id > 0")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("first", stage), ("second", stage)])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 4 and "/tables/first-" in plans[1] and "/tables/second-" in out.inputFiles()[0]
