"""Structural identities, brute-force oracles and edge cases of the engine's own operators."""

from __future__ import annotations

import hashlib
import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import algebra, config, solve
from tallyforge.functions.expr import phi
from tallyforge.operators import baselines, bootstrap, buckets, fitted, graph, metrics, plays, projection, quality, ranking, ratings, resume
from tallyforge.sources import adapters, sinks
from tallyforge.sources.archive import Archive, ArchiveError

GAMES = "game_id long, season int, season_type string, week int, bucket_order int, game_type string, start_date timestamp, neutral_site boolean, home_team string, away_team string, home_class string, away_class string, home_points int, away_points int, completed boolean"


def games(spark, rows):
    """rows: (home, away, home points, away points, neutral)."""
    day = pd.Timestamp("2020-09-01")
    made = [(i, 2020, "regular", i, i, "regular", (day + pd.Timedelta(days=7 * i)).to_pydatetime(), bool(n), h, a, "fbs", "fbs", hp, ap, hp != ap) for i, (h, a, hp, ap, n) in enumerate(rows)]
    return spark.createDataFrame(made, GAMES)


ROBIN = [("A", "B", 28, 7, 0), ("B", "C", 24, 10, 0), ("C", "A", 3, 30, 0), ("A", "D", 45, 0, 0), ("B", "D", 20, 17, 0), ("C", "D", 14, 10, 0)]


def test_phi_is_exact(spark):
    xs = [i / 10 for i in range(-120, 121)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", phi("x").alias("p")).collect()
    for r in got:
        want = 0.5 * math.erfc(-r.x / math.sqrt(2))
        assert abs(r.p - want) <= 1e-12 * max(want, 1e-300) + 1e-300


def test_distribution_of_wins_by_enumeration(spark):
    random.seed(2)
    for n in range(1, 9):
        ps = [random.random() for _ in range(n)]
        want = [0.0] * (n + 1)
        for outcome in itertools.product((0, 1), repeat=n):
            want[sum(outcome)] += math.prod(p if o else 1 - p for p, o in zip(ps, outcome, strict=True))
        t = spark.createDataFrame([(ps,)], "ps array<double>").withColumn("pmf", solve.pmf("ps"))
        row = t.select("pmf", *(solve.upper_tail("pmf", str(k)).alias(f"t{k}") for k in range(n + 2))).first()
        assert np.allclose(row.pmf, want)
        for k in range(n + 1):
            assert math.isclose(row[f"t{k}"], sum(want[k:]), abs_tol=1e-12)
        assert math.isclose(row["t0"], 1.0)


def test_root_reproduces_its_target(spark):
    sched = [{"game_id": i, "power": float(p), "site": float(s)} for i, (p, s) in enumerate([(3, 1), (-5, -1), (10, 0), (0, 1)])]
    t = spark.createDataFrame([(sched, 2.5)], "games array<struct<game_id:long,power:double,site:double>>, target double")
    q = t.select(solve.wins_root("target", "games", 2.5, 15.3).alias("q")).first().q
    wins = sum(0.5 * math.erfc(-(q - g["power"] + 2.5 * g["site"]) / 15.3 / math.sqrt(2)) for g in sched)
    assert math.isclose(wins, 2.5, abs_tol=1e-9)


def test_points_snapping_vector(spark):
    deltas = [0, 2, -2, 3, -3, 6, 7, 8, -7, 14, 1]
    got = spark.createDataFrame([(i, d) for i, d in enumerate(deltas)], "i int, d int").select("i", plays.snap_points("d").alias("p")).orderBy("i").collect()
    assert [int(r.p) for r in got] == [0, 2, -2, 3, -3, 7, 7, 7, -7, 7, 2]


def test_colley_and_share_on_a_round_robin(spark):
    g = games(spark, ROBIN)
    colley = {r.team: r.rating for r in baselines.colley(g).collect()}
    assert math.isclose(sum(colley.values()), 2.0)
    share = {r.team: r.rating for r in baselines.win_share(g).collect()}
    assert share["A"] == 1.0 and share["D"] == 0.0
    assert max(colley, key=colley.get) == "A" and min(colley, key=colley.get) == "D"


def test_elo_keeps_its_sum_and_order_matters_not_the_partitions(spark):
    g = games(spark, ROBIN)
    a = {r.team: r.rating for r in baselines.elo(g).collect()}
    b = {r.team: r.rating for r in baselines.elo(g.repartition(3)).collect()}
    assert a == b and math.isclose(sum(a.values()), 6000.0)


def test_two_islands_are_solvable(spark):
    g = games(spark, [("A", "B", 10, 3, 0), ("B", "A", 7, 14, 0), ("C", "D", 21, 0, 0), ("D", "C", 3, 9, 0)])
    fit = fitted.fits(g).toPandas()
    assert np.isfinite(fit["rating"]).all() and (fit["residual"] < 1e-8).all()
    assert fit["n_folds"].iloc[0] == 0 and fit["lambda"].iloc[0] == max(ratings.GRID_RESULTS)


def test_ridge_shrinks_and_recovers():
    rng = np.random.default_rng(0)
    z, truth = rng.standard_normal((200, 4)), np.array([1.0, -2.0, 3.0, 0.5])
    a, b = z.T @ z, z.T @ (z @ truth)
    assert np.allclose(algebra.ridge(a, b, np.zeros(4)), truth)
    assert np.abs(algebra.ridge(a, b, np.full(4, 1e9))).max() < 1e-3


def test_ties_have_four_meanings(spark):
    g = games(spark, [("A", "B", 7, 7, 0)])
    s = {r.team: r for r in adapters.sides(g).collect()}
    assert s["A"].won == s["B"].won == 0 and s["A"].tied == 1
    assert {r.team: r.rating for r in baselines.win_share(g).collect()} == {"A": 0.5, "B": 0.5}


def test_grid_is_a_triangle_and_live_is_its_diagonal(spark):
    cells = ranking.grid(games(spark, ROBIN)).toPandas()
    assert (cells["e"] <= cells["k"]).all()
    assert (cells["is_live"] == (cells["e"] == cells["k"])).all()
    with pytest.raises(ValueError):
        ranking.cell(games(spark, ROBIN), 3, 2)


def test_future_games_change_no_past_rating(spark):
    a = ratings.power_by_bucket(games(spark, ROBIN[:4])).toPandas()
    b = ratings.power_by_bucket(games(spark, ROBIN)).toPandas()
    b = b[b["as_of"] <= 3]
    assert a.sort_values(["as_of", "team"]).reset_index(drop=True).equals(b.sort_values(["as_of", "team"]).reset_index(drop=True))


def plain_ridge(rows, lam):
    """Ratings by stacked rows, the penalty as further observations."""
    teams = sorted({r[0] for r in rows} | {r[1] for r in rows})
    z, y = np.zeros((len(rows), len(teams) + 1)), np.zeros(len(rows))
    for i, (h, a, hp, ap, n) in enumerate(rows):
        z[i, teams.index(h)], z[i, teams.index(a)], z[i, -1] = 1, -1, 0 if n else 1
        y[i] = 32 * math.tanh((hp - ap) / 32) + 7 * np.sign(hp - ap)
    more = np.sqrt(lam) * np.eye(len(teams), len(teams) + 1)
    x = np.linalg.lstsq(np.vstack([z, more]), np.append(y, np.zeros(len(teams))), rcond=None)[0]
    return dict(zip(teams, x, strict=False))


def random_season(n, teams="ABCDEFGH", seed=3):
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        h, a = rng.sample(teams, 2)
        hp, ap = rng.randrange(50), rng.randrange(50)
        if hp != ap:
            out.append((h, a, hp, ap, rng.random() < 0.2))
    return out


def test_fits_as_of_every_bucket_are_fits_of_their_games(spark):
    rows = random_season(40)
    got = fitted.fits(games(spark, rows), every=True).toPandas()
    for as_of, part in got.groupby("as_of"):
        want = plain_ridge(rows[: as_of + 1], part["lambda"].iloc[0])
        assert sorted(part["team"]) == sorted(want)
        assert all(abs(want[t] - v) < 1e-8 for t, v in zip(part["team"], part["rho"], strict=True))
    for seen in (7, 25, 40):
        alone = fitted.power(games(spark, rows[:seen])).toPandas().set_index("team")["rating"]
        along = got[got["as_of"] == seen - 1].set_index("team")["rating"]
        if seen < 10:  # too few games to choose a penalty, so folds play no part
            assert np.allclose(alone.sort_index(), along.sort_index(), atol=1e-5)
        assert set(alone.index) == set(along.index)


def test_a_path_of_penalties_is_a_solve_each():
    rng = np.random.default_rng(1)
    z = rng.standard_normal((60, 12))
    a, b = z.T @ z, z.T @ rng.standard_normal(60)
    a[3] = a[:, 3] = 0  # a column that nothing is known of
    b[3] = 0
    penalties = np.outer(np.append(np.ones(11), 0), [0.5, 8.0, 256.0])
    x = algebra.ridge_path(a, b, penalties)
    for k in range(3):
        assert np.allclose(x[:, k], algebra.ridge(a, b, penalties[:, k]), atol=1e-9)


def test_blend_without_steps_is_results_alone(spark):
    g = games(spark, random_season(30))
    f = fitted.blend(fitted.layers(g, None)).toPandas().set_index("team").sort_index()
    l2 = fitted.fits(g).toPandas().set_index("team").sort_index()
    assert np.allclose(f["rating"], f["w2"] * l2["rho"], atol=1e-9) and (f["source"] == "training_window").all()


def test_blend_weights_have_not_seen_their_games(spark):
    """Once enough games were predicted, weights come from predictions by fits of the games before each."""
    rows = random_season(60)
    g = games(spark, rows)
    walk = fitted.blend(fitted.layers(g, None, every=True)).toPandas()
    fits = {k: p.set_index("team")["rho"] for k, p in fitted.fits(g, every=True).toPandas().groupby("as_of")}
    x, y = [], []
    for k in range(1, 60):
        h, a, hp, ap, n = rows[k]
        x.append((fits[k - 1].get(h, 0.0) - fits[k - 1].get(a, 0.0), 0.0 if n else 1.0))
        y.append(hp - ap)
        if k >= ratings.LEAST_GAMES:
            want = np.linalg.lstsq(np.array(x), np.array(y, float), rcond=None)[0]
            row = walk[walk["as_of"] == k].iloc[0]
            assert row["source"] == "out_of_sample" and abs(row["w2"] - want[0]) < 1e-7 and abs(row["home_field"] - want[1]) < 1e-7 and row["n_weights"] == k


def test_windows_and_universes_refuse_what_they_dont_know(spark):
    g = games(spark, ROBIN)
    assert buckets.window(g, 2020, "regular", 2).count() == 3 and buckets.window(g, 2020, "regular", 2, False).count() == 2
    with pytest.raises(KeyError):
        buckets.window(g, 2020, "postseason", 1)
    with pytest.raises(ValueError):
        buckets.load_games(g, "moon")
    with pytest.raises(ValueError):
        ratings.folds(g, 1)
    with pytest.raises(KeyError):
        baselines.rater("oracle")
    assert baselines.rater("Win-Pct") is baselines.win_share


def test_bridges_and_splits():
    path = pd.DataFrame({"season": 1, "game_id": [1, 2, 3], "a": ["A", "B", "C"], "b": ["B", "C", "D"]})
    assert graph.bridges_of(path)[["game_id", "smaller"]].values.tolist() == [[1, 1], [2, 2], [3, 1]]
    cycle = pd.DataFrame({"season": 1, "game_id": [1, 2, 3], "a": ["A", "B", "C"], "b": ["B", "C", "A"]})
    assert graph.bridges_of(cycle).empty
    twice = pd.DataFrame({"season": 1, "game_id": [1, 2], "a": ["A", "B"], "b": ["B", "A"]})
    assert graph.bridges_of(twice).empty


def test_bootstrap_draws_are_their_own(spark):
    g = games(spark, ROBIN)
    few = bootstrap.draws(g, 3).toPandas().sort_values(["draw", "team"]).reset_index(drop=True)
    more = bootstrap.draws(g, 60).toPandas()
    more = more[more["draw"] < 3].sort_values(["draw", "team"]).reset_index(drop=True)
    assert few.equals(more)


def test_a_draws_orderings_are_those_of_its_simulated_season(spark):
    rows = random_season(40)
    g = games(spark, rows)
    got = bootstrap.draws(g, 1, bootstrap.ORDERINGS).toPandas()
    mu = bootstrap.expected(g, bootstrap.prepared(g)).toPandas().sort_values("game_id")
    margin = mu["mu"].to_numpy() + adapters.SIGMA * bootstrap.normals(mu["game_id"].to_numpy(), 0)
    new = games(spark, [(h, a, 1 if m > 0 else 0, 0 if m > 0 else 1, n) for (h, a, _, _, n), m in zip(rows, margin, strict=True)])
    power = got[got["ordering"] == "power"][["team", "value"]]
    p = spark.createDataFrame([(2020, t, float(v)) for t, v in power.itertuples(index=False)], "season int, team string, rating double")
    s = resume.schedule(new, p).cache()
    tail = {r.team: r.tail for r in resume.odds(resume.with_probability(s, p.withColumn("rating", F.col("rating"))), ["season", "team"]).collect()}
    if p.count() < resume.REFERENCE_RANK:
        odds = got[got["ordering"] == "schedule_odds"].set_index("team")["value"]
        assert all(abs(tail[t] + odds[t]) < 1e-9 for t in tail)
    root = {r.team: r.resume for r in resume.solved(s).collect()}
    res = got[got["ordering"] == "resume"].set_index("team")["value"]
    assert all(abs(root[t] - res[t]) < 1e-4 for t in root)


def test_normal_numbers_are_normal():
    x = np.concatenate([bootstrap.normals(np.arange(1, 2001), k) for k in range(50)])
    assert abs(x.mean()) < 0.01 and abs(x.std() - 1) < 0.01 and abs((x**3).mean()) < 0.05 and abs((x**4).mean() - 3) < 0.1
    a, b = bootstrap.normals(np.arange(1, 2001), 1), bootstrap.normals(np.arange(1, 2001), 2)
    assert abs(np.corrcoef(a, b)[0, 1]) < 0.07 and abs(np.corrcoef(a[:-1], a[1:])[0, 1]) < 0.07


def test_phi_of_arrays():
    x = np.linspace(-12, 12, 481)
    want = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in x])
    assert np.allclose(algebra.phi(x), want, rtol=1e-12, atol=0)


def test_graph_as_of_every_bucket(spark):
    g = games(spark, [("A", "B", 1, 0, 0), ("C", "D", 1, 0, 0), ("B", "C", 1, 0, 0), ("B", "A", 1, 0, 0), ("E", "F", 1, 0, 0)])
    e = graph.edges(g)
    ids = {(r.as_of, r.team): (r.id, r.n) for r in graph.component_ids(e).collect()}
    assert ids[(0, "B")] == (0, 2) and ids[(1, "C")] == (1, 2) and ids[(2, "D")] == (0, 4) and ids[(4, "F")] == (1, 2) and (0, "C") not in ids
    cut = {(r.as_of, r.game_id): r.smaller for r in graph.walked(e, graph.bridges_by_bucket, graph.BRIDGE_SCHEMA).collect()}
    assert cut == {(0, 0): 1, (1, 0): 1, (1, 1): 1, (2, 0): 1, (2, 1): 1, (2, 2): 2, (3, 1): 1, (3, 2): 2, (4, 1): 1, (4, 2): 2, (4, 4): 1}
    hops = {(r.as_of, r.team): r.hops for r in graph.walked(e, graph.distances_of, "team string, hops int").collect()}
    assert hops[(1, "D")] == -1 and hops[(2, "D")] == 3 and hops[(4, "E")] == -1


def test_student_matches_known_values():
    assert abs(metrics.student_cdf(np.array([0.0, 1.895, -2.998]), 7)[1] - 0.95) < 1e-3
    assert abs(metrics.student_cdf(np.array([0.0]), 7)[0] - 0.5) < 1e-12


def test_config_overlay_and_recipes():
    assert config.overlay(config.DEFAULTS, {"margin": {"c": 1.0}})["margin"]["win_bonus"] == 7.0
    with pytest.raises(KeyError):
        config.overlay(config.DEFAULTS, {"margin": {"d": 1.0}})
    with pytest.raises(config.RecipeError):
        config.Recipe("x", "y", {"resume": {"sigma": 1.0}}).resolve()
    assert config.resolved_hash({"a": float("inf")}) == config.resolved_hash({"a": "uncapped"})
    assert config.clamp("margin.c", 1e9) == 64.0
    with pytest.raises(ValueError):
        config.clamp("poll.ordering", "fame")


def test_archive_is_append_only(spark, tmp_path):
    a = Archive(str(tmp_path))
    name = a.write("games", {"year": "2020"}, b'{"season": 1, "n": 2}')
    a.write("games", {"year": "2020"}, b'{"season": 1, "n": 3}')
    assert a.verify(spark) == 2
    assert [r.n for r in a.bodies(spark, "games", "season int, n int").collect()] == [3]
    assert a.bodies(spark, "teams", "season int").count() == 0
    with pytest.raises(ArchiveError):
        a.write("games", {}, b"", url="https://x/?api_key=1")
    (tmp_path / name).write_bytes(b"changed")
    with pytest.raises(ArchiveError):
        a.verify(spark)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, 0.1 + 0.2, None), (1, float("inf"), "x")], "k int, v double, s string")
    root = sinks.write_canonical(df, str(tmp_path / "csv"), ["k"]).first()
    text = "".join(p.read_text() for p in sorted((tmp_path / "csv").glob("part-*")))
    assert text == "k,v,s\n1,,x\n2,0.3,\n" and root["rows"] == 3
    assert root["digest"] == hashlib.sha256("".join(hashlib.sha256(line.encode()).hexdigest() for line in text.splitlines()).encode()).hexdigest()
    assert "DO NOTHING" in sinks.upsert_sql("published_polls", ["season", "poll", "team_id", "rank"])
    assert sinks.upsert_sql("teams", ["team_id", "name"]).endswith("DO UPDATE SET name = EXCLUDED.name")
    sinks.write_all(df, str(tmp_path), "t", ["k"])
    assert spark.read.parquet(f"{tmp_path}/t.parquet").count() == 2
    got = sinks.release(str(tmp_path))
    assert not sinks.verify_release(str(tmp_path), got)
    assert sinks.write_documents(df, str(tmp_path / "docs"), ["k"], ["v"]) == 2
    assert sinks.load_jdbc(df, "teams", None) is False


def test_leakage_names_the_culprit(spark):
    g = games(spark, ROBIN)
    assert quality.audit(fitted.power, g, quality.READS, ["season", "team"], ["rating"])["same"]
    cut = [c for c in quality.READS if c != "home_points"]
    assert "home_points" in quality.audit(fitted.power, g, cut, ["season", "team"], ["rating"])["missing"]
    assert quality.banned(["our_epa", "EPA_home", "points"]) == ["EPA_home"]


def test_digest_ignores_partitions(spark):
    g = games(spark, ROBIN)
    a = quality.frame_digest(g, ["home_team"], ["game_id"]).first()
    assert a == quality.frame_digest(g.repartition(5), ["home_team"], ["game_id"]).first()
    assert a != quality.frame_digest(g.withColumn("home_team", F.lower("home_team")), ["home_team"], ["game_id"]).first()


def test_digest_is_a_tree_of_ordered_rows(spark, monkeypatch):
    from tallyforge.sources import digest

    monkeypatch.setattr(digest, "FAN", 3)

    def plain(values):
        level = [hashlib.sha256("".join(f"{len(str(v).encode())}:{v}" if v is not None else "n" for v in r).encode()).hexdigest() for r in values]
        while len(level) > 1:
            level = [hashlib.sha256("".join(level[i : i + 3]).encode()).hexdigest() for i in range(0, len(level), 3)]
        return level[0] if level else hashlib.sha256(b"").hexdigest()

    def root(values):
        return quality.frame_digest(spark.createDataFrame(values, "k int, a string, b int").repartition(4), ["a", "b"], ["k"]).first()["digest"]

    for n in (0, 1, 2, 3, 4, 10, 29):
        assert root([(i, f"é{i}", None if i % 3 else i) for i in range(n)]) == plain([(i, f"é{i}", None if i % 3 else i) for i in range(n)])
    base = [(1, "x", 5), (2, "y", 7), (3, "z", 9)]
    swapped, cancelling, shifted = [(1, "y", 7), (2, "x", 5), (3, "z", 9)], [(1, "x", 6), (2, "y", 6), (3, "z", 9)], [(1, "x5", None), (2, "y", 7), (3, "z", 9)]
    assert len({root(v) for v in (base, swapped, cancelling, shifted)}) == 4
    twice = [(1, "x", 5), (1, "w", 5), (1, None, 5)]
    assert root(twice) == root(twice[::-1])


def test_empty_tables(spark):
    g = games(spark, ROBIN).limit(0)
    for build in (fitted.power, baselines.win_share, baselines.colley, baselines.elo, fitted.fits, fitted.power_by_bucket, ranking.grid):
        assert build(g).count() == 0


def test_stream_restates_touched_seasons(spark, tmp_path):
    from tallyforge.streaming import weekly

    games(spark, ROBIN).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(GAMES).parquet(str(tmp_path / "in"))
    q = weekly.restate(stream, str(tmp_path / "store"), fitted.power, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).toPandas()
    assert sorted(got["team"]) == ["A", "B", "C", "D"]


def test_bridge_frame_reads_the_power_that_predicts(spark, sf):
    got = {r.game_id: r.delta for r in projection.bridge_frame(spark, sf).collect()}
    assert got and got == {r.game_id: r.delta for r in metrics.rating_delta(spark, sf).collect()}
