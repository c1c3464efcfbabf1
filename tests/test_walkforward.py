"""The all-system walk-forward against raters on the games before each bucket, and against a plain loop over buckets."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest

from tallyforge.operators import baselines, walkforward
from tests.test_engine import GAMES


def season(spark, n: int, a_bucket: int = 3, seed: int = 5):
    """`n` games of ten teams, so many a bucket; the first buckets leave the teams in several components."""
    rng = random.Random(seed)
    strength = {f"T{k}": 4 * k for k in range(10)}
    day = pd.Timestamp("2020-01-05")
    rows = []
    for i in range(n):
        h, a = rng.sample(sorted(strength), 2)
        hp, ap = (max(0, int(24 + s / 2 + rng.gauss(0, 9))) for s in (strength[h] - strength[a], strength[a] - strength[h]))
        b = i // a_bucket
        rows.append((i, 2020, "regular", b + 1, b, "regular", (day + pd.Timedelta(days=7 * b, hours=i)).to_pydatetime(), rng.random() < 0.2, h, a, "fbs", "fbs", hp, ap + (hp == ap), True))
    return rows, spark.createDataFrame(rows, GAMES)


def test_ratings_as_of_each_bucket_are_those_of_its_games(spark):
    rows, g = season(spark, 45)
    got = walkforward.ratings_by_bucket(g, systems=("winpct", "home_team", "colley", "srs", "elo", "random_walker")).toPandas()
    assert sorted(got["as_of"].unique()) == list(range(15))
    for as_of in (0, 2, 14):
        seen = spark.createDataFrame([r for r in rows if r[4] <= as_of], GAMES)
        for name in sorted(got["system"].unique()):
            want = baselines.rater(name)(seen).toPandas().set_index("team")["rating"].sort_index()
            have = got[(got["system"] == name) & (got["as_of"] == as_of)].set_index("team")["rating"].sort_index()
            assert list(want.index) == list(have.index)
            assert np.allclose(want, have, atol=2e-6), (name, as_of)


def squeezed(m: float) -> float:
    return math.copysign(21 + ((abs(m) - 20) ** 0.8 - 1) / 0.8, m) if abs(m) > 21 else m


def plain_walk(rows, ratings):
    """The harness for one system, bucket by bucket; ratings: as_of -> team -> rating."""
    pool, out, buckets = [], {}, sorted({r[4] for r in rows})
    for b in buckets[1:]:
        train, test = [r for r in rows if r[4] < b], [r for r in rows if r[4] == b]
        if len(train) < 20 or test[0][3] < 2:
            continue
        now = ratings[b - 1]

        def line(r, now=now):
            return now.get(r[8], 0.0) - now.get(r[9], 0.0), 0.0 if r[7] else 1.0, float(r[12] - r[13])

        if len(pool) >= 40:
            orders = sorted({p[0] for p in pool})
            late = [p for p in pool if p[0] >= orders[-5]] if len(orders) > 5 else []
            used, source = (late, "out_of_sample_trailing_5") if len(late) >= 40 else (pool, "out_of_sample")
            points = [p[1:4] for p in used]
        else:
            points, source = [line(r) for r in train], "training_window"
        x = np.array([(1, d, s) for d, s, _ in points])
        coef = np.linalg.lstsq(x, np.array([m for _, _, m in points]), rcond=None)[0]
        orders = sorted({p[0] for p in pool})
        late = [p for p in pool if p[0] >= orders[-3]] if len(orders) > 3 else []
        errors = [p[4] for p in (late if len(late) >= 40 else pool)]
        sigma = max(15.3, math.sqrt(np.mean(np.square(errors)))) if len(errors) >= 40 else 15.3
        told = [squeezed(coef[0] + coef[1] * d + coef[2] * s) for d, s, _ in map(line, test)]
        out[b] = (len(train), source, len(points), sigma, float(np.mean([abs(p - line(r)[2]) for p, r in zip(told, test, strict=True)])))
        pool += [(b, *line(r), line(r)[2] - p) for p, r in zip(told, test, strict=True)]
    return out


@pytest.mark.parametrize("a_bucket", [3, 15])
def test_walk_is_that_of_a_plain_loop(spark, a_bucket):
    rows, g = season(spark, 150, a_bucket, seed=a_bucket)
    systems = ("colley", "winpct", "home_team")
    rated = walkforward.ratings_by_bucket(g, systems=systems).toPandas()
    got = walkforward.walk_forward(g, systems=systems).toPandas()
    sources = set()
    for name in systems:
        of = {k: dict(zip(p["team"], p["rating"], strict=True)) for k, p in rated[rated["system"] == name].groupby("as_of")}
        want, have = plain_walk(rows, of), got[got["system"] == name].set_index("bucket_order")
        assert sorted(want) == sorted(have.index)
        for b, (n_train, source, n_calib, sigma, mae) in want.items():
            r = have.loc[b]
            assert (r["n_train"], r["source"], r["n_calib"]) == (n_train, source, n_calib)
            assert abs(r["sigma"] - sigma) < 2e-5 and abs(r["mae"] - mae) < 2e-5
            sources.add(source)
    assert len(sources) >= 2


def test_orderings_predict_through_the_blend(spark):
    _, g = season(spark, 60)
    got = walkforward.walk_forward(g, None, ("l1", "l3", "resume", "schedule_odds")).toPandas()
    by = {k: p.drop(columns="system").sort_values("bucket_order").reset_index(drop=True) for k, p in got.groupby("system")}
    assert by["l3"].equals(by["resume"]) and by["l3"].equals(by["schedule_odds"]) and (by["l1"]["b"] == 0).all()
    with pytest.raises(KeyError):
        walkforward.ratings_by_bucket(g, systems=("nobody",))
    assert walkforward.walk_forward(g.limit(0), systems=("colley", "winpct")).count() == 0
