"""The refitted lever grid against fits of its own cells, and Kendall's tau against all pairs."""

from __future__ import annotations

import itertools
import random

import duckdb
import numpy as np

from tallyforge.operators import fitted, resume, variants
from tests.test_walkforward import season


def test_cells_are_fits_of_their_own(spark):
    _, g = season(spark, 90)
    got = variants.cell_ratings(g).toPandas()
    assert len(got) == 24 * 10
    for cap, bonus in ((1.0, 12.0), (24.0, 0.0), (32.0, 7.0), (float("inf"), 3.0)):
        want = fitted.fits(g, cap=cap, bonus=bonus).toPandas().set_index("team").sort_index()
        have = got[(got["cap"] == cap) & (got["bonus"] == bonus)].set_index("team").sort_index()
        assert have["lambda"].iloc[0] == want["lambda"].iloc[0]
        assert np.allclose(have["rho"], want["rho"], atol=1e-8) and np.allclose(have["rating"], want["rating"], atol=1e-8)


def test_every_cell_places_every_team(spark):
    _, g = season(spark, 40)
    p = variants.placed(g).toPandas()
    assert p["cell"].nunique() == 72 and variants.HOUSE in set(p["cell"]) and set(variants.VARIANTS.values()) <= set(p["cell"])
    assert all(sorted(x["r"]) == list(range(1, 11)) for _, x in p.groupby("cell"))


def test_inversions_by_all_pairs():
    rng = random.Random(6)
    for n in (0, 1, 2, 3, 7, 64, 101):
        x = rng.sample(range(1000), n)
        assert variants.inversions(np.array(x)) == sum(a > b for a, b in itertools.combinations(x, 2))


def borders(places: int) -> list[float]:
    """Numbers whose decimals end in a 5 behind those that are kept, as ratings of six places do."""
    return [(k * 10 + 5) / 10 ** (places + 1) for k in range(-3000, 3000, 7)]


def test_variant_document_rounds_borders_as_its_sql(spark, monkeypatch):
    rows = [(1990, next(iter(variants.VARIANTS.values())), f"t{i}", x, 1) for i, x in enumerate(borders(4))]
    monkeypatch.setattr(variants, "placed", lambda games: spark.createDataFrame(rows, "season int, cell string, team string, rating double, r int"))
    monkeypatch.setattr(variants.A, "played", lambda spark, d: None)
    got = {r.team: r.rating for r in variants.variant_document(spark, "").collect()}
    assert got == {team: duckdb.execute("select round(?::double, 4)", [x]).fetchone()[0] for _, _, team, x, _ in rows}


def test_hindsight_rating_rounds_borders_as_its_sql(spark, monkeypatch):
    rows = [(1990, f"t{i}", 3, 7, x, 1) for i, x in enumerate(borders(5))]
    s = spark.createDataFrame(rows, "season int, team string, bucket_order int, game_id long, opp double, won int")
    monkeypatch.setattr(resume, "inputs", lambda spark, d: (None, None, s))
    got = {r.team: r.faced for r in resume.hindsight_rating(spark, "").collect()}
    assert got == {r[1]: duckdb.execute("select round(?::double, 5)", [r[4]]).fetchone()[0] for r in rows}
