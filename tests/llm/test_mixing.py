from __future__ import annotations

import random
import re

import pytest

from tallyforge.llm import mixing
from tests.llm.cases import odd_docs


def water_fill(sizes: dict, weights=(3, 1, 2), share=1.5, laps=2) -> dict:
    """Targets by handing the excess out again until nobody is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, full = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set()
    while left > 1e-9 and len(full) < len(names):
        open_ = [s for s in names if s not in full]
        total, over = sum(weight[s] for s in open_), 0.0
        for s in open_:
            target[s] += left * weight[s] / total
            if target[s] >= laps * sizes[s]:
                over += target[s] - laps * sizes[s]
                target[s] = float(laps * sizes[s])
                full.add(s)
        left = over
    return target


@pytest.mark.parametrize("block", [16, 1024])
def test_targets_and_takes(spark, block):
    random.seed(block)
    rows = [(i, " ".join(["w"] * random.randrange(0, 90)), random.choice(["hot"] * 5 + ["a", "b", "é", None, "Z"])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = {r.doc_id: r for r in mixing.mix(df, block=block).collect()}
    again = {r.doc_id: r for r in mixing.mix(df.repartition(7), block=block).collect()}
    assert got == again and len(got) == len(rows)
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want, taken = water_fill(sizes), dict.fromkeys(sizes, 0)
    for i, t, s in rows:
        r = got[i]
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", t)) and r.source_size == sizes[s]
        assert abs(r.target - want[s]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        assert (r.taken > 0) == (r.first_slot is not None)
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.51


def test_schedule_is_even(spark):
    df = spark.createDataFrame([("a", 0, 3000, 3000.0, 3000), ("b", 1, 1000, 1000.0, 1000)], "source string, src int, source_size long, target double, quota long")
    got = mixing.schedule(df, 400, 10).collect()
    slots = sorted(r.slot for r in got if r.src == 0)
    assert abs(len([s for s in slots if s < 100]) - 75) <= 2 and abs(len([s for s in slots if s < 200]) - 150) <= 3
    by = {0: [], 1: []}
    for r in sorted(got, key=lambda r: r.slot):
        by[r.src].append(r.nth)
    assert by[0] == list(range(len(by[0]))) and by[1] == list(range(len(by[1])))


def test_odd_rows(spark):
    docs = odd_docs(spark)
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count() and all(0 <= r.taken <= 2 * r.size for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert {r.taken for r in mixing.mix(docs.where("doc_id in (2, 3)")).collect()} == {0}


def test_plan_is_native(spark):
    plan = mixing.mix(odd_docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_what_no_slot_takes_is_not_taken(spark, monkeypatch):
    rows = [(i, "w " * (40 + i % 9), "abc"[i % 3]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    whole = {r.doc_id: r.taken for r in mixing.mix(df, block=64).collect()}
    short = {r.doc_id: (r.taken, r.first_slot) for r in mixing.mix(df, block=64, slots=40).collect()}
    other = {r.doc_id: (r.taken, r.first_slot) for r in mixing.mix(df, block=64, slots=40, step=1_000_003).collect()}
    assert 0 < sum(t for t, _ in short.values()) <= 40 * 64 < sum(whole.values()) and all(s is None or s < 40 for _, s in short.values())
    assert {i for i, (t, _) in short.items() if t} != {i for i, (t, _) in other.items() if t}
    assert all(t <= whole[i] for i, (t, _) in short.items())
    monkeypatch.setattr(mixing, "ROUNDS", 10**9)
    with pytest.raises(ValueError, match="blocks"):
        mixing.mix(df)


@pytest.mark.parametrize("sizes", [[1, 1, 1, 5000], [1] * 40 + [9000], [3000, 1000, 10]])
def test_every_source_is_served_to_its_last_block(spark, sizes):
    rows = [("s", k, q, float(q), q) for k, q in enumerate(sizes)]
    df = spark.createDataFrame(rows, "source string, src int, source_size long, target double, quota long")
    blocks = [-(-q // 10) for q in sizes]
    got = mixing.schedule(df, mixing.ROUNDS * sum(blocks), 10).collect()
    assert sorted((r.src, r.nth) for r in got) == [(k, n) for k, b in enumerate(blocks) for n in range(b)]
    assert len({r.slot for r in got}) == len(got)


def test_one_source_holds_nearly_all(spark):
    rows = [(i, "w " * 50, "hot" if i % 200 else "rare") for i in range(1000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=128).collect()
    by = {}
    for r in got:
        by.setdefault(r.target, [0])[0] += r.taken
    assert all(abs(t - n) <= 0.51 for t, (n,) in by.items())


def test_stage_keeps_the_order_of_slots(spark):
    from tallyforge.llm import stages

    docs = spark.createDataFrame([(i, f"w{i} " * 400, "en", "abc"[i % 3], 1) for i in range(60)] + [(7, "another text " * 300, "en", "a", 1), (None, "nobody", "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in stages.mixed(docs).collect()]
    key = docs.where("doc_id is not null").withColumn("k", mixing.F.struct("doc_id", mixing.F.xxhash64("text").alias("h")))
    slots = {(r.k.doc_id, r.k.h): r.lap_slots or [] for r in mixing.mix(key, id_col="k").collect()}
    named = {(r.doc_id, r.text): slots[r.doc_id, r.k.h] for r in key.collect()}
    want = [row for _, row in sorted((s, row) for row, ss in named.items() for s in ss)]
    assert got == [*want, (None, "nobody")] and len({i for i, _ in got}) > 20
