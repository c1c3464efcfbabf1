"""Baseline raters (A*): each takes games and returns (season, team, rating)."""

from __future__ import annotations

import importlib.util
import math
import tomllib
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import algebra as al
from tallyforge.functions.ridge_sql import dense, gradients
from tallyforge.operators import fitted
from tallyforge.operators import ratings as R
from tallyforge.operators import resume as Q
from tallyforge.plans.registry import query, rule
from tallyforge.sources import adapters as A

COLLEY_PRIOR = 2.0
SRS_CAP, SRS_FLOOR = 24.0, 7.0
ELO = {"k": 25.0, "home": 65.0, "fbs": 1500.0, "other": 1200.0, "scale": 2.2}
WALK_P, WALK_ROUNDS, WALK_TOLERANCE = 0.75, 10_000, 1e-12
ADJUST_ROUNDS = 12

RATING = "season int, team string, rating double"
CLIPPED = f"greatest(-{SRS_CAP}, least({SRS_CAP}, sign(margin) * greatest(abs(margin), {SRS_FLOOR})))"
RATER_VIEWS = {
    "meet": f"select s.season, t.i, o.i j, count(*) n, sum(won) won, sum(lost) lost, sum(tied) tied, sum({CLIPPED}) clipped from sides s join fit_teams t on t.season = s.season and t.team = s.team join fit_teams o on o.season = s.season and o.team = s.opponent group by all",
    "meet_of": "select season, i, sum(n) n, sum(won) won, sum(lost) lost, sum(clipped) clipped from meet group by season, i",
    "colley_a": dense(f"select season, i, i j, n + {COLLEY_PRIOR} v from meet_of union all select season, i, j, -n from meet"),
    "colley_sys": "select season, a, b, list_transform(b, lambda v, i: a[i][i]) d, list_transform(b, lambda v: 0::double) f from colley_a join (select season, list(1 + (won - lost) / 2::double order by i) b from meet_of group by season) using (season)",
    **gradients("colley_x", "colley_sys", "season", 60),
    "srs_a": dense("select season, i, i j, n v from meet_of union all select season, i, j, -n from meet"),
    "srs_sys": "select season, a, b, list_transform(b, lambda v: 1::double) d, list_transform(b, lambda v: 0::double) f from srs_a join (select season, list(clipped::double order by i) b from meet_of group by season) using (season)",
    **gradients("srs_x", "srs_sys", "season", 90),
    "elo_games": f"select season, row_number() over (partition by season order by start_date, game_id) g, h.i hi, a.i ai, h.n, case when neutral_site then 0.0 else {ELO['home']} end home, home_points - away_points margin from played p join fit_teams h using (season) join fit_teams a using (season) where h.team = home_team and a.team = away_team",
    "elo_steps": f"""select season, 0::bigint g, list_transform(range(0, n), lambda k: {ELO['fbs']}::double) r from (select distinct season, n from fit_teams)
      union all select season, g, list_transform(r, lambda v, i: case when i = hi then v + moved when i = ai then v - moved else v end) from (
        select *, {ELO['k']} * ln(abs(margin) + 1.0) * {ELO['scale']} / ((case when margin < 0 then y - x else x - y end) * 0.001 + {ELO['scale']}) * (case when margin > 0 then 1.0 when margin < 0 then 0.0 else 0.5 end - 1 / (1 + pow(10::double, (y - x) / 400))) moved from (
          select e.*, s.r, s.r[hi] + home x, s.r[ai] y from elo_steps s join elo_games e on e.season = s.season and e.g = s.g + 1))""",
    "flow": f"select season, i, j, {WALK_P} * won + {1 - WALK_P} * lost + 0.5 * tied v from meet",
    "walker_a": dense("select season, i, j, v / m v from (select f.season, f.i, f.j, f.v, o.n m from flow f join meet_of o on o.season = f.season and o.i = f.j) union all select season, j, j, 1 - sum(v / m) from (select f.season, f.j, f.v, o.n m from flow f join meet_of o on o.season = f.season and o.i = f.j) group by season, j"),
    "walker_steps": "select season, 0 it, a, list_transform(range(0, n), lambda k: 1::double / n) v from walker_a union all select season, it + 1, a, list_transform(u, lambda z: z / list_sum(u)) from (select season, it, a, list_transform(a, lambda r: list_dot_product(r, v)) u from walker_steps where it < 400)",
    "rate_colley": "select season, team, x[i] rating from colley_x join fit_teams using (season)",
    "rate_srs": "select season, team, x[i] rating from srs_x join fit_teams using (season)",
    "rate_elo": "select season, team, r[i] rating from (select season, arg_max(r, g) r from elo_steps group by season) join fit_teams using (season)",
    "rate_walker": "select season, team, v[i] * n rating from walker_steps join fit_teams using (season) where it = 400",
}
A.VIEWS.update(RATER_VIEWS)
A.MATERIALIZED.update(k for k in RATER_VIEWS if not k.startswith("rate_"))


def win_share(games: DataFrame) -> DataFrame:
    s = A.sides(games)
    return s.groupBy("season", "team").agg(((F.sum("won") + 0.5 * F.sum("tied")) / F.count("*")).alias("rating"))


@query("A01_win_share", "select season, team, round((sum(won) + 0.5 * sum(tied)) / count(*), 6) rating from sides group by season, team")
def win_share_rows(spark: SparkSession, d: str) -> DataFrame:
    return win_share(A.played(spark, d)).withColumn("rating", F.round("rating", 6))


def constant(games: DataFrame) -> DataFrame:
    return A.sides(games).select("season", "team").distinct().withColumn("rating", F.lit(0.0))


@query("A02_home_team", "select distinct season, team, 0.0::double rating from sides")
def home_team(spark: SparkSession, d: str) -> DataFrame:
    return constant(A.played(spark, d))


def meetings(games: DataFrame) -> DataFrame:
    """(season, team, opponent, n, won, lost, margin): what raters need of a season, one row a pair that met and way."""
    s = A.sides(games)
    clipped = F.greatest(F.lit(-SRS_CAP), F.least(F.lit(SRS_CAP), F.sign("margin") * F.greatest(F.abs("margin"), F.lit(SRS_FLOOR))))
    return s.groupBy("season", "team", "opponent").agg(F.count("*").alias("n"), F.sum("won").alias("won"), F.sum("lost").alias("lost"), F.sum("tied").alias("tied"), F.sum(F.when(F.col("margin") == 0, 0.0).otherwise(clipped)).alias("clipped"))


def per_season(games: DataFrame, solve: Callable[[int, pd.DataFrame], np.ndarray]) -> DataFrame:
    """Rates each season by a solver over its pairs, two rows a pair that met: what a task holds are these, however many games there are."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        teams = sorted(set(pdf["team"]))
        at = {t: i for i, t in enumerate(teams)}
        pdf = pdf.assign(i=pdf["team"].map(at), j=pdf["opponent"].map(at)).sort_values(["i", "j"])
        return pd.DataFrame({"season": pdf["season"].iloc[0], "team": teams, "rating": solve(len(teams), pdf)})

    return meetings(games).groupBy("season").applyInPandas(one, RATING)


def met(n: int, p: pd.DataFrame) -> al.Gram:
    """Games of each team, less those with each opponent: the matrix that Colley and SRS share."""
    half = p[p["i"] < p["j"]]
    return al.Gram(np.bincount(p["i"], p["n"], n), np.zeros((n, 0)), np.zeros((0, 0)), half["i"].to_numpy(), half["j"].to_numpy(), -half["n"].to_numpy(float))


def colley(games: DataFrame) -> DataFrame:
    def solve(n: int, p: pd.DataFrame) -> np.ndarray:
        return al.ridge(met(n, p), 1 + np.bincount(p["i"], (p["won"] - p["lost"]) / 2, n), np.full(n, COLLEY_PRIOR))

    return per_season(games, solve)


@query("A03_colley", "select season, team, round(rating, 6) rating from rate_colley")
def colley_rows(spark: SparkSession, d: str) -> DataFrame:
    return colley(A.played(spark, d)).withColumn("rating", F.round("rating", 6))


def pieces(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of each node the least node that it hangs together with."""
    label = np.arange(n)
    while True:
        low, after = np.minimum(label[i], label[j]), label.copy()
        np.minimum.at(after, i, low)
        np.minimum.at(after, j, low)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def srs(games: DataFrame) -> DataFrame:
    """Capped margins and schedule in one singular system, solved with least norm: in each piece of the schedule ratings add up to nought."""

    def solve(n: int, p: pd.DataFrame) -> np.ndarray:
        x = al.ridge(met(n, p), np.bincount(p["i"], p["clipped"], n), np.zeros(n))
        piece = pieces(n, p["i"].to_numpy(), p["j"].to_numpy())
        return x - (np.bincount(piece, x, n) / np.maximum(np.bincount(piece, minlength=n), 1))[piece]

    return per_season(games, solve)


@query("A04_srs", "select season, team, round(rating, 6) rating from rate_srs")
def srs_rows(spark: SparkSession, d: str) -> DataFrame:
    return srs(A.played(spark, d)).withColumn("rating", F.round("rating", 6))


def mov_multiplier(difference: float, winner: float, loser: float, scale: float = ELO["scale"]) -> float:
    """Diminishing returns of the margin, times a correction for favourites winning by more."""
    return math.log(abs(difference) + 1) * scale / ((winner - loser) * 0.001 + scale)


MULTIPLIER = f"ln(abs(home_points - away_points) + 1.0) * {ELO['scale']} / ((hr - ar) * 0.001 + {ELO['scale']})"


@query("A06_mov_multiplier", f"select game_id, round({MULTIPLIER}, 6) m from (select *, 1500 + week hr, 1500 - week ar from played)")
def mov_multiplier_rows(spark: SparkSession, d: str) -> DataFrame:
    g = A.played(spark, d).selectExpr("*", "1500 + week hr", "1500 - week ar")
    return g.select("game_id", F.round(F.expr(MULTIPLIER), 6).alias("m"))


def elo_game(now: dict[str, float], g) -> None:
    """Moves both sides' ratings by one game."""
    for team, kind in ((g.home_team, g.home_class), (g.away_team, g.away_class)):
        now.setdefault(team, ELO["fbs"] if kind == "fbs" else ELO["other"])
    home, away = now[g.home_team] + (0.0 if g.neutral_site else ELO["home"]), now[g.away_team]
    expected = 1 / (1 + 10 ** ((away - home) / 400))
    result = 1.0 if g.home_points > g.away_points else 0.0 if g.home_points < g.away_points else 0.5
    winner, loser = (away, home) if result == 0.0 else (home, away)
    change = ELO["k"] * mov_multiplier(g.home_points - g.away_points, winner, loser) * (result - expected)
    now[g.home_team] += change
    now[g.away_team] -= change


def elo(games: DataFrame) -> DataFrame:
    """Ratings after a season's games in the order of (start, game): an ordered fold, so one task a season, fed six columns."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        now: dict[str, float] = {}
        for g in pdf.sort_values(["start_date", "game_id"]).itertuples(index=False):
            elo_game(now, g)
        teams = sorted(now)
        return pd.DataFrame({"season": pdf["season"].iloc[0], "team": teams, "rating": [now[t] for t in teams]})

    return games.select("season", "start_date", "game_id", "home_team", "away_team", "home_class", "away_class", "neutral_site", "home_points", "away_points").groupBy("season").applyInPandas(one, RATING)


@query("A05_elo", "select season, team, round(rating, 6) rating from rate_elo")
def elo_rows(spark: SparkSession, d: str) -> DataFrame:
    return elo(A.played(spark, d)).withColumn("rating", F.round("rating", 6))


def random_walker(games: DataFrame) -> DataFrame:
    """Share of votes of a walker who moves to a game's winner with probability WALK_P; times the number of teams."""

    def solve(n: int, p: pd.DataFrame) -> np.ndarray:
        i, j = p["i"].to_numpy(), p["j"].to_numpy()
        played = np.bincount(i, p["n"], n)
        move = (WALK_P * p["won"] + (1 - WALK_P) * p["lost"] + 0.5 * p["tied"]).to_numpy() / np.where(played == 0, 1, played)[j]
        stay = 1 - np.bincount(j, move, n)
        v = np.full(n, 1 / n)
        for _ in range(WALK_ROUNDS):
            after = np.bincount(i, move * v[j], n) + stay * v
            after /= after.sum()
            done = np.abs(after - v).max() < WALK_TOLERANCE
            v = after
            if done:
                break
        return v * n

    return per_season(games, solve)


@query("A07_random_walker", "select season, team, round(rating, 6) rating from rate_walker")
def random_walker_rows(spark: SparkSession, d: str) -> DataFrame:
    return random_walker(A.played(spark, d)).withColumn("rating", F.round("rating", 6))


def results_rater(games: DataFrame) -> DataFrame:
    return fitted.power(games)


def efficiency_rater(games: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """Net efficiency on the scale of points; zero without steps."""
    return fitted.layers(games, steps).select("season", "team", (F.col("k") * F.col("net")).alias("rating"))


def power_rater(games: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    return R.power_of(games, "L3", steps)


def resume_rater(games: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """The quality at which a team's expected wins are its wins."""
    return Q.solved(Q.schedule(games, R.power_of(games, "L3", steps))).select("season", "team", F.col("resume").alias("rating"))


def odds_rater(games: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """How improbable a team's record was, as minus the logarithm of its chance."""
    p = R.power_of(games, "L3", steps)
    return Q.odds(Q.with_probability(Q.schedule(games, p), p), ["season", "team"]).select("season", "team", F.col("key").alias("rating"))


def adjusted_margin(games: DataFrame, rounds: int = ADJUST_ROUNDS) -> DataFrame:
    """Mean of capped margin plus the opponent's rating, centred; so many rounds from zero."""
    s = A.sides(games).select("season", "team", "opponent", F.greatest(F.lit(-A.MARGIN_CAP), F.least(F.lit(A.MARGIN_CAP), F.col("margin"))).alias("m"))
    pairs = s.groupBy("season", "team", "opponent").agg(F.sum("m").alias("m"), F.count("*").alias("n"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        teams = sorted(set(pdf["team"]))
        at = {t: i for i, t in enumerate(teams)}
        i, j = pdf["team"].map(at).to_numpy(), pdf["opponent"].map(at).to_numpy()
        total, count = np.bincount(i, pdf["m"], len(teams)), np.bincount(i, pdf["n"], len(teams))
        r = np.zeros(len(teams))
        for _ in range(rounds):
            r = (total + np.bincount(i, pdf["n"].to_numpy() * r[j], len(teams))) / count
            r = r - r.mean()
        return pd.DataFrame({"season": pdf["season"].iloc[0], "team": teams, "rating": r})

    return pairs.groupBy("season").applyInPandas(one, RATING)


def _adjusted_sql() -> str:
    steps = [f"s0 as (select season, team, opponent, greatest(-{A.MARGIN_CAP}, least({A.MARGIN_CAP}, margin)) m from sides)", "r0 as (select distinct season, team, 0.0::double r from s0)"]
    for k in range(1, ADJUST_ROUNDS + 1):
        steps.append(f"u{k} as (select s.season, s.team, avg(m + r) r from s0 s join r{k - 1} o on o.season = s.season and o.team = s.opponent group by 1, 2)")
        steps.append(f"r{k} as materialized (select season, team, r - avg(r) over (partition by season) r from u{k})")
    return f"with {', '.join(steps)} select season, team, round(r, 6) rating from r{ADJUST_ROUNDS}"


@query("A11_adjusted_margin", _adjusted_sql())
def adjusted_margin_rows(spark: SparkSession, d: str) -> DataFrame:
    return adjusted_margin(A.played(spark, d)).withColumn("rating", F.round("rating", 6))


Rater = Callable[..., DataFrame]
RATERS: dict[str, Rater] = {
    "winpct": win_share, "home_team": constant, "colley": colley, "srs": srs, "elo": elo, "random_walker": random_walker,
    "l1": efficiency_rater, "l2": results_rater, "l3": power_rater, "resume": resume_rater, "schedule_odds": odds_rater,
}
#: Raters that also take the steps of the games (fitted.contest_steps).
WITH_STEPS = (efficiency_rater, power_rater, resume_rater, odds_rater)
#: Other names of raters (fixed values).
ALIASES = {"win_pct": "winpct", "record": "winpct", "home": "home_team", "simple": "srs", "walker": "random_walker", "results": "l2", "power": "l3", "odds": "schedule_odds", "l4": "resume", "poll": "schedule_odds"}
#: Orderings that predict through another rater's ratings.
PREDICTS_BY = {"resume": "l3", "schedule_odds": "l3"}


def rater(name: str) -> Rater:
    key = name.strip().lower().replace("-", "_")
    key = ALIASES.get(key, key)
    if key not in RATERS:
        raise KeyError(f"unknown rater {name!r}; there are {sorted(RATERS)} and {sorted(ALIASES)}")
    return RATERS[key]


def load_challenger(path: str) -> Rater | dict:
    """A user's rater: a .py file with rate(games) -> (season, team, rating), or a .toml file of parameters laid over the defaults."""
    p = Path(path)
    if p.suffix == ".toml":
        return tomllib.loads(p.read_text())
    if p.suffix != ".py":
        raise ValueError(f"a challenger is a .py or .toml file, not {p.name}")
    spec = importlib.util.spec_from_file_location(p.stem, p)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if not callable(getattr(module, "rate", None)):
        raise ValueError(f"{p.name} has no rate(games)")
    return module.rate


@rule("A08_rater_registry")
def rater_registry(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(k, PREDICTS_BY.get(k, k)) for k in RATERS], "rater string, predicts_by string")


@rule("A09_alias_resolution")
def alias_resolution(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(sorted(ALIASES.items()), "alias string, rater string")


PROTOCOL = {
    "winpct": "select season, team, (sum(won) + 0.5 * sum(tied)) / count(*) rating from sides group by season, team", "home_team": "select distinct season, team, 0.0::double rating from sides", "colley": "from rate_colley", "srs": "from rate_srs",
    "elo": "from rate_elo", "random_walker": "from rate_walker", "l1": "select season, team, k * net rating from blend_s", "l2": "from power", "l3": "select season, team, round(rating, 6) rating from blend_s",
    "resume": "select season, team, resume rating from res", "schedule_odds": "select season, team, key rating from odds",
}


@query("A12_rater_protocol", Q.BISECTION.rstrip() + ", " + Q.SEASON_ODDS.strip().removeprefix("with recursive ") + " select rater, season, team, round(rating, 6) rating from (" + " union all ".join(f"select '{k}' rater, * from ({v})" for k, v in PROTOCOL.items()) + ")")
def rater_protocol(spark: SparkSession, d: str) -> DataFrame:
    """Every rater over the same games, those that take steps with them."""
    g, steps = A.played(spark, d), fitted.contest_steps(spark, d)
    rows = [(f(g, steps) if f in WITH_STEPS else f(g)).select(F.lit(name).alias("rater"), "season", "team", F.round(F.col("rating").cast("double"), 6).alias("rating")) for name, f in RATERS.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
