"""What tasks hold grows with the games of a season, not with its teams squared."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from tallyforge.functions import algebra
from tallyforge.operators import bootstrap, fitted, resume, variants
from tallyforge.plans.catalog import QUERIES
from tallyforge.sources import adapters
from tests.test_walkforward import season

TEAMS = 6_000


def held(f, *args) -> tuple:
    """What f returns, and the most MB that it held."""
    tracemalloc.start()
    out = f(*args)
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return out, most


def wide(n: int = TEAMS, each: int = 6, seed: int = 5) -> pd.DataFrame:
    """Rows of games as fitted.game_rows has them: every team meets `each` others at home."""
    rng = np.random.default_rng(seed)
    home = np.tile(np.arange(n), each)
    away = (home + rng.integers(1, n, len(home))) % n
    m = rng.integers(1, 40, len(home)) * rng.choice([-1.0, 1.0], len(home))
    y = 32 * np.tanh(m / 32) + 7 * np.sign(m)
    names = np.array([f"T{k:06}" for k in range(n)])
    return pd.DataFrame({"season": 1990, "bucket_order": np.arange(len(home)) % 9, "fold": np.arange(len(home)) % 5, "p": names[home], "q": names[away], "site": rng.integers(0, 2, len(home)).astype(float), "w": 1.0, "n": 1, "m": m, "y": y, "mm": m * m, "yy": y * y, "block": 0})


def stepped(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.assign(y=rows["m"] / 10, yy=rows["mm"] / 100)


def test_layers_of_many_teams_fit_in_a_task():
    rows = wide()
    got, most = held(fitted.layer_fits, rows, stepped(rows), False)
    assert len(got) == TEAMS and most < 100  # one matrix of both parts of the teams is 1152 MB


def test_sums_of_cells_are_those_of_meetings():
    rows = wide(40)
    cells = []
    for r in rows.itertuples():
        entries = [(r.p, 1.0), (r.q, -1.0), (fitted.SITE_ROW, r.site), (fitted.GAMES_ROW, 1.0), (fitted.MARGIN_ROW, r.m), (algebra.RESPONSE, r.y)]
        cells += [(r.bucket_order, r.fold, i, j, v * w, v * w, v * w) for i, v in entries for j, w in entries if i <= j]
    a, b = fitted.game_sums(rows), fitted.Sums(pd.DataFrame(cells, columns=["bucket_order", "fold", "i", "j", "a", "a2", "a0"]))
    for s in (a, b):
        s.grow(6)
    f, g = fitted.fit_games(a), fitted.fit_games(b)
    assert f["teams"] == g["teams"] and f["lambda"] == g["lambda"] and np.allclose(f["x"], g["x"], atol=1e-11)
    dense = np.linalg.solve(f["a"].toarray() + np.diag(f["lambda"] * f["free"]), f["b"])
    assert np.allclose(f["x"], dense, atol=1e-11)
    inverse = np.linalg.inv(f["a"].toarray() + np.diag(f["lambda"] * f["free"]))
    variances, edf, sigma2 = fitted.errors_of(a, f)
    assert abs(edf - np.trace(inverse @ f["a"].toarray())) < 1e-9 and np.allclose(variances, np.diag(fitted.covariance_of(a, f)), atol=1e-9)


#: Readers whose fits are made of rows of games and steps; before, of cells of dense matrices.
READERS = ["Q16_mid_p", "Q20_scalar_odds", "R36_contrast", "R17_efficiency_to_points", "R30_power_dispatch", "R24_season_accumulator", "J09_bridge_frame", "K07_poll_table", "M46_leave_one_out", "J07_promotion_frame", "J08_adjusted", "J10_ceiling_holder", "K01_headline_orderings", "K28_layer_rows", "K06_ratings_table"]


@pytest.mark.parametrize("name", READERS)
def test_readers_ship_no_cells_of_dense_matrices(spark, sf, name):
    assert "entries" not in QUERIES[name](spark, sf)._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("cap, bonus", [(18.0, 12.0), (float("inf"), 3.0)])
def test_records_side_by_side_are_those_of_one_team_at_a_time(spark, cap, bonus):
    _, g = season(spark, 90)
    p = variants.cell_ratings(g, ((cap, bonus),)).select("season", "cap", "bonus", "team", F.round("rating", 6).alias("rating"))
    s = resume.schedule(g, p).withColumns({"cap": F.lit(cap), "bonus": F.lit(bonus)})
    response = F.col("margin").cast("double") if np.isinf(cap) else cap * F.tanh(F.col("margin") / cap)
    s = resume.with_probability(s.withColumn("response", response + bonus * F.sign("margin")), p)
    want = resume.odds(s, ["team"]).select("team", "tail", "mid").join(resume.solved(s, ("team",)).select("team", "resume", "wins"), "team")
    want = want.join(resume.solved_by_margin(s, ("team", "cap", "bonus")).select("team", F.col("resume").alias("by_margin")), "team").toPandas().set_index("team").sort_index()
    got = variants.cell_records(adapters.sides(g).toPandas(), p.toPandas()).set_index("team").sort_index()
    assert len(got) == 10 and (got["wins"] == want["wins"]).all()
    for c in ("tail", "mid"):
        assert np.allclose(got[c], want[c], atol=1e-13)
    for c in ("resume", "by_margin"):
        assert (got[c].round(5) == want[c]).all()


#: Readers of the lever grid: no root of a cell is halved one team at a time.
GRIDS = ["C07_variant_set", "C08_agreement", "C10_lever_grid", "C14_manifest"]


@pytest.mark.parametrize("name", GRIDS)
def test_grid_halves_no_team_by_itself(spark, sf, monkeypatch, name):
    monkeypatch.setattr(variants, "stored", lambda df, name: df)
    assert "aggregate(sequence" not in QUERIES[name](spark, sf)._jdf.queryExecution().analyzed().toString()


def test_draws_of_many_teams_fit_in_a_task(monkeypatch):
    monkeypatch.setattr(bootstrap, "DRAWS_A_TASK", 4)
    rows = wide()
    job = pd.DataFrame({"game_id": np.arange(len(rows)), "home_team": rows["p"], "away_team": rows["q"], "site": rows["site"], "w": 1.0, "mu": rows["m"] / 4})
    factor = pd.DataFrame({"season": [1990], "scale": [0.5], "edge": [1.0], "lambda": [8.0]})
    got, most = held(bootstrap.simulate, job, factor, 0, 4, bootstrap.ORDERINGS)
    assert len(got) == 4 * TEAMS * 3 and most < 150  # the inverse alone is 288 MB
