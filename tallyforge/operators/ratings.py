"""Margins, weights, designs, ridge fits and the ratings that they make (R*)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions import algebra as al
from tallyforge.functions.expr import compress_sql, response_sql
from tallyforge.functions.ridge_sql import gradients
from tallyforge.operators import fitted
from tallyforge.operators.fitted import FOLDS, GRID_EFFICIENCY, GRID_RESULTS, LEAST_GAMES, MARGIN, SITE, TYPE_WEIGHT, entry, folds, game_design, power_by_bucket, predicted, weighted
from tallyforge.plans.registry import query
from tallyforge.sources import adapters as A

__all__ = ["GRID_EFFICIENCY", "GRID_RESULTS", "folds", "game_design", "power_by_bucket", "weighted"]

RECENCY = 0.97


@query("R01_tanh_compression", f"select game_id, round({compress_sql(MARGIN, 32.0)}, 6) compressed, cast({compress_sql(MARGIN, float('inf'))} as double) uncapped from contests")
def tanh_compression(spark: SparkSession, d: str) -> DataFrame:
    g = A.contests(spark, d)
    return g.select("game_id", F.round(F.expr(compress_sql(MARGIN, 32.0)), 6).alias("compressed"), F.expr(compress_sql(MARGIN, float("inf"))).cast("double").alias("uncapped"))


@query("R02_margin_response", f"select game_id, round({response_sql(MARGIN)}, 6) s from contests")
def margin_response(spark: SparkSession, d: str) -> DataFrame:
    return A.contests(spark, d).select("game_id", F.round(F.expr(response_sql(MARGIN)), 6).alias("s"))


def compress_prediction_sql(m: str, threshold: float = 21.0, alpha: float = 0.8) -> str:
    """Predictions beyond the threshold grow by a power law from there on, with the same slope at the threshold."""
    over = f"(abs({m}) - {threshold - 1!r})"
    return f"(case when abs({m}) > {threshold!r} then sign({m}) * ({threshold!r} + (pow(cast({over} as double), {alpha!r}) - 1) / {alpha!r}) else {m} end)"


@query("R03_prediction_compression", f"select game_id, round({compress_prediction_sql(MARGIN)}, 6) m from contests")
def prediction_compression(spark: SparkSession, d: str) -> DataFrame:
    return A.contests(spark, d).select("game_id", F.round(F.expr(compress_prediction_sql(MARGIN)), 6).alias("m"))


@query(
    "R04_game_weights",
    f"select game_id, round({TYPE_WEIGHT} * pow(cast({RECENCY} as double), floor((epoch(max(start_date) over (partition by season)) - epoch(start_date)) / 604800)), 6) w from played",
)
def game_weights(spark: SparkSession, d: str) -> DataFrame:
    return weighted(A.played(spark, d), RECENCY).select("game_id", F.round("w", 6).alias("w"))


@query("R05_game_design", f"select game_id, i, cast(v as double) v from (select game_id, home_team i, 1 v from played union all select game_id, away_team, -1 from played union all select game_id, '~site', {SITE} from played where not neutral_site)")
def game_design_rows(spark: SparkSession, d: str) -> DataFrame:
    e = game_design(A.played(spark, d)).select(F.col("row_id").alias("game_id"), F.explode("entries").alias("e")).where(F.col("e.v") != 0).where(~F.col("e.i").isin(al.RESPONSE, fitted.MARGIN_ROW, fitted.GAMES_ROW))
    return e.select("game_id", "e.i", "e.v")


HOME = "concat('P', cast(game_id % 23 as varchar(9)))"
AWAY = "concat('P', cast((game_id * 5 + segment + 1) % 23 as varchar(9)))"
STEP_TEAMS = f"select *, case when offense_is_home then h else a end offense, case when offense_is_home then a else h end defense from (select *, {HOME} h, {AWAY} a from steps) where h <> a"


def step_teams(steps: DataFrame) -> DataFrame:
    s = steps.withColumns({"h": F.expr(HOME.replace("varchar(9)", "string")), "a": F.expr(AWAY.replace("varchar(9)", "string"))}).where("h <> a")
    return s.withColumns({"offense": F.expr("case when offense_is_home then h else a end"), "defense": F.expr("case when offense_is_home then a else h end")})


def step_design(steps: DataFrame, response: str) -> DataFrame:
    """Four entries a step: offence, defence, site 1 or -1, intercept; the response as a fifth."""
    s = step_teams(steps)
    entries = F.array(
        entry(F.concat(F.lit("o:"), "offense"), F.lit(1.0)), entry(F.concat(F.lit("d:"), "defense"), F.lit(1.0)), entry("~site", F.when(F.col("offense_is_home"), 1.0).otherwise(-1.0)), entry("~one", F.lit(1.0)), entry(al.RESPONSE, F.col(response)),
    )
    return s.select(F.concat_ws(":", "game_id", "play_index").alias("row_id"), F.lit(1.0).alias("w"), "play_type", entries.alias("entries"))


@query("R06_step_design", f"with t as ({STEP_TEAMS}) select game_id, play_index, i, v from (select game_id, play_index, 'o:' || offense i, 1.0::double v from t union all select game_id, play_index, 'd:' || defense, 1.0 from t union all select game_id, play_index, '~site', case when offense_is_home then 1.0 else -1.0 end from t union all select game_id, play_index, '~one', 1.0 from t)")
def step_design_rows(spark: SparkSession, d: str) -> DataFrame:
    e = step_design(A.steps(spark, d), "points_scored").select(F.split("row_id", ":").alias("k"), F.explode("entries").alias("e")).where(f"e.i <> '{al.RESPONSE}'")
    return e.select(F.col("k")[0].cast("long").alias("game_id"), F.col("k")[1].cast("int").alias("play_index"), "e.i", "e.v")


ENTRIES = f"""e as (select season, game_id, {TYPE_WEIGHT} w, unnest([home_team, away_team, '~site', '~y']) i, unnest([1.0::double, -1.0, {SITE}, {response_sql(MARGIN)}]) v from played)"""


@query("R07_normal_equations", f"with {ENTRIES} select p.season, p.i, q.i j, round(sum(p.w * p.v * q.v), 6) a, round(sum(p.w * p.w * p.v * q.v), 6) a2 from e p join e q on p.game_id = q.game_id and p.i <= q.i group by 1, 2, 3")
def normal_equations(spark: SparkSession, d: str) -> DataFrame:
    """The weighted Gram matrix of every season, response included, in one aggregation."""
    g = al.gram(game_design(A.played(spark, d)), ["season"])
    beside = [fitted.MARGIN_ROW, fitted.GAMES_ROW]  # what only the scale of points needs
    return g.where(~F.col("i").isin(beside) & ~F.col("j").isin(beside)).select("season", "i", "j", F.round("a", 6).alias("a"), F.round("a2", 6).alias("a2"))


@query("R12_group_folds", f"select game_id, season, cast((dense_rank() over (partition by season order by game_id) - 1) % {FOLDS} as int) fold from played")
def group_folds(spark: SparkSession, d: str) -> DataFrame:
    return folds(A.played(spark, d)).select("game_id", "season", "fold")


#: Sandwich errors of whole seasons: the columns of the inverse come from one system each.
ERROR_VIEWS = {
    "err_cell": "select e.season, e.i, f.i j, sum(e.w * e.w * e.v * f.v) a2 from fs_ent e join fs_ent f using (rid) group by all",
    "err_map": "select season, i, map(list(j), list(a2)) m from err_cell group by all",
    "err_square": "select season, list(r order by i) a2 from (select k.season, k.i, list_transform(range(1, n + 2), lambda j: coalesce(m[j], 0)) r from (select *, unnest(range(1, n + 2)) i from fs_best) k left join err_map using (season, i)) group by season",
    "err_unit": "select season, unit, n, a, list_transform(a, lambda v, i: case when i = unit then 1.0 else 0.0 end::double) b, d, f from (select *, unnest(range(1, n + 2)) unit from fs_best)",
    **gradients("err_inverse", "err_unit", "season, unit", 70),
    "err_half": "select season, unit, x, list_transform(a2, lambda r: list_dot_product(r, x)) t from err_inverse join err_square using (season)",
    "err_edf": "select season, sum(list_dot_product(a[unit], x)) edf from err_inverse join fs_best using (season) group by season",
    "err_sigma": "select season, any_value(edf) edf, sum(w * pow(y - (x[hi] - x[ai] + site * x[r.n + 1]), 2)) / greatest(sum(w) - any_value(edf), 1) sigma2 from fit_games r join fs_x x using (season) join err_edf using (season) group by season",
    "err_team": "select season, team, i, sqrt(greatest(sigma2 * list_dot_product(x, t), 0)) se, edf, sigma2, x, t from err_half join err_sigma using (season) join fit_teams t2 using (season) where unit = t2.i",
}
A.VIEWS.update(ERROR_VIEWS)
A.MATERIALIZED.update(ERROR_VIEWS)


@query("R08_ridge_solve", "select season, team, round(rho, 6) rating, true solved from fit_season")
def ridge_solve(spark: SparkSession, d: str) -> DataFrame:
    """The solution of every season's normal equations, and whether it solves them."""
    return fitted.fits(A.played(spark, d)).select("season", "team", F.round("rho", 6).alias("rating"), (F.col("residual") < 1e-6).alias("solved"))


@query("R09_ridge_ratings", 'select season, team, round(rho, 6) rating, lam "lambda" from fit_season', **{"lambda": "double"})
def ridge_ratings(spark: SparkSession, d: str) -> DataFrame:
    return fitted.fits(A.played(spark, d)).select("season", "team", F.round("rho", 6).alias("rating"), "lambda")


@query("R10_sandwich_covariance", "select season, team, round(se, 6) se, round(edf, 6) edf, round(sigma2, 5) sigma2 from err_team")
def sandwich(spark: SparkSession, d: str) -> DataFrame:
    f = fitted.fits(A.played(spark, d), errors=True)
    return f.select("season", "team", F.round("se", 6).alias("se"), F.round("edf", 6).alias("edf"), F.round("sigma2", 5).alias("sigma2"))


@query("R11_difference_se", "select p.season, p.team a, q.team b, round(sqrt(greatest(p.sigma2 * (list_dot_product(p.x, p.t) + list_dot_product(q.x, q.t) - 2 * list_dot_product(q.x, p.t)), 0)), 6) se from err_team p join err_team q on q.season = p.season and p.team < q.team")
def difference_se(spark: SparkSession, d: str) -> DataFrame:
    """Standard error of the difference of each pair of a season's teams, from the covariance matrix."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        sums = fitted.game_sums(pdf)
        sums.grow(int(sums.buckets[-1]))
        f = fitted.fit_games(sums)
        k = len(f["teams"])
        v = fitted.covariance_of(sums, f)[:k, :k]
        i, j = np.triu_indices(k, 1)
        return pd.DataFrame({"season": pdf["season"].iloc[0], "a": np.array(f["teams"])[i], "b": np.array(f["teams"])[j], "se": np.round(np.sqrt(np.maximum(v[i, i] + v[j, j] - 2 * v[i, j], 0)), 6)})

    return fitted.bucket_sums(A.played(spark, d), every=False).groupBy("season").applyInPandas(one, "season int, a string, b string, se double")


@query("R13_lambda_selection", f'select season, lam "lambda", {FOLDS} n_folds from fs_lam', **{"lambda": "double"})
def lambda_selection(spark: SparkSession, d: str) -> DataFrame:
    return fitted.fits(A.played(spark, d)).groupBy("season").agg(F.first("lambda").alias("lambda"), F.first("n_folds").alias("n_folds"))


@query("R19_results_fit", f'select season, as_of, team, round(rho, 6) rating, lam "lambda", {FOLDS} n_folds, cast(rows as bigint) n_games, round(x[n + 1], 6) home_field from fit_season join fs_x using (season, as_of, lam) join fs_n using (season, as_of)', **{"lambda": "double"})
def results_fit(spark: SparkSession, d: str) -> DataFrame:
    return fitted.fits(A.played(spark, d)).select("season", "as_of", "team", F.round("rho", 6).alias("rating"), "lambda", "n_folds", "n_games", F.round("home_field", 6).alias("home_field"))


@query("R37_se_lookup", "select season, team, round(se, 6) se from err_team")
def se_lookup(spark: SparkSession, d: str) -> DataFrame:
    return fitted.fits(A.played(spark, d), errors=True).select("season", "team", F.round("se", 6).alias("se"))


def season_layers(spark: SparkSession, d: str) -> DataFrame:
    """Both layers of every whole season."""
    return fitted.layers(A.played(spark, d), fitted.contest_steps(spark, d))


@query("R14_efficiency_fit", "select season, team, round(offense, 6) offense, round(defense, 6) defense, round(net, 6) net, coalesce(lam, 325) efficiency_lambda from effect_s", efficiency_lambda="double")
def efficiency_rows(spark: SparkSession, d: str) -> DataFrame:
    """Offence and defence of every team from the values of its snaps, by one cross-validated ridge over two columns a team."""
    return season_layers(spark, d).select("season", "team", *(F.round(c, 6).alias(c) for c in ("offense", "defense", "net")), "efficiency_lambda")


PREDICTED = f"""select p.*, {MARGIN} margin, {SITE} site, coalesce(h.rating, 0) hr, coalesce(a.rating, 0) ar, coalesce(h.rating, 0) - coalesce(a.rating, 0) delta
  from played p left join season_power h on h.season = p.season and h.team = home_team left join season_power a on a.season = p.season and a.team = away_team"""


def base(spark: SparkSession, d: str) -> DataFrame:
    """Games predicted by Power from all of their season's games and steps."""
    g = A.played(spark, d)
    return predicted(g, season_power(spark, d, g))


def register_ols(name: str, y: str, xs: list[str], labels: list[str], where: str = "true", by: str = "season", doc: str = "") -> None:
    ols = al.Ols(y, xs)
    columns = ", ".join(f"round({c}, 6) {label}" for c, label in zip(ols.coefficients, labels, strict=True))

    @query(name, f"with g as ({PREDICTED}), s as (select {by}, count(*) n, {ols.select} from g where {where} group by {by}) select {by}, n, {columns} from s")
    def run(spark: SparkSession, d: str) -> DataFrame:
        sums = ols.aggregate(base(spark, d).where(where), [by], [F.count("*").alias("n")])
        return sums.select(by, "n", *(F.round(F.expr(c), 6).alias(label) for c, label in zip(ols.coefficients, labels, strict=True)))

    run.__doc__ = doc


def efficiency_games(spark: SparkSession, d: str) -> DataFrame:
    """Games with the difference of their sides' net efficiencies."""
    g = A.played(spark, d)
    return predicted(g, season_layers(spark, d).select("season", "team", F.col("net").alias("rating")))


_K = al.Ols("m", ["1", "dn", "site"])


@query("R15_k_scale", f"with s as (select season, count(*) n, {_K.select} from (select * replace (round(dn, 9) as dn) from terms_s) group by season) select season, n, {', '.join(f'round({c}, 5) {label}' for c, label in zip(_K.coefficients, 'akc', strict=True))} from s")
def k_scale(spark: SparkSession, d: str) -> DataFrame:
    """margin ~ a + k * (difference of net efficiencies) + c * site, from sums; null where no efficiency differs by 1e-9."""
    rows = efficiency_games(spark, d).withColumns({"m": F.col("margin"), "dn": F.round("delta", 9)})
    s = _K.aggregate(rows, ["season"], [F.count("*").alias("n")])
    return s.select("season", "n", *(F.round(F.expr(c), 5).alias(label) for c, label in zip(_K.coefficients, "akc", strict=True)))


@query("R23_blend_weights", "select season, round(w.x[1], 6) w1, round(w.x[2], 6) w2, round(w.x[3], 6) h, n from weight_s w join own_s using (season, as_of)")
def blend_weights(spark: SparkSession, d: str) -> DataFrame:
    """margin ~ w1 * (scaled efficiency) + w2 * (results) + h * site, no intercept, over the fit's own games."""
    f = fitted.blend(season_layers(spark, d)).groupBy("season").agg(*(F.round(F.first(c), 6).alias(n) for c, n in (("w1", "w1"), ("w2", "w2"), ("home_field", "h"))), F.first("n_weights").alias("n"))
    return f


@query("R28_points_scale", f"select season, round(b, 6) b, round(h, 6) h from (select season, {fitted.TWO_BY_TWO} b, (s00 * t1 - s01 * t0) / (s00 * s11 - s01 * s01) h from fs_moments)")
def points_scale(spark: SparkSession, d: str) -> DataFrame:
    """margin ~ b * (difference of results) + h * site, no intercept."""
    return fitted.fits(A.played(spark, d)).groupBy("season").agg(F.round(F.first("scale"), 6).alias("b"), F.round(F.first("points_edge"), 6).alias("h"))


register_ols("R31_affine", f"margin - {A.HOME_EDGE} * site", ["1", "delta"], ["a", "b"], doc="The site's coefficient is given and taken off first.")


@query("R16_net_differential", "select rid game_id, round(dn, 6) delta from terms_s", game_id="bigint")
def net_differential(spark: SparkSession, d: str) -> DataFrame:
    return efficiency_games(spark, d).select("game_id", F.round("delta", 6).alias("delta"))


@query("R17_efficiency_to_points", "select season, team, round(k * net, 6) points from blend_s")
def efficiency_to_points(spark: SparkSession, d: str) -> DataFrame:
    return season_layers(spark, d).select("season", "team", F.round(F.col("k") * F.col("net"), 6).alias("points"))


@query("R18_neutral_efficiency", "select distinct team, 0.0::double net from sides")
def neutral_efficiency(spark: SparkSession, d: str) -> DataFrame:
    """Without steps every team's efficiency is zero."""
    none = spark.createDataFrame([], "team string, net double")
    teams = A.sides(A.played(spark, d)).select("team").distinct()
    return teams.join(none, "team", "left").select("team", F.coalesce("net", F.lit(0.0)).alias("net"))


@query("R20_home_and_home", f"with m as (select home_team h, away_team a, sum({MARGIN}) s, count(*) n from played where not neutral_site group by 1, 2) select round(sum(m.s) / sum(m.n), 10) home_field, cast(sum(m.n) as bigint) n from m semi join m r on r.h = m.a and r.a = m.h")
def home_and_home(spark: SparkSession, d: str) -> DataFrame:
    """Mean margin over all non-neutral games whose teams also met at the other's place."""
    m = A.played(spark, d).where("not neutral_site").groupBy(F.col("home_team").alias("h"), F.col("away_team").alias("a")).agg(F.sum(F.expr(MARGIN)).alias("s"), F.count("*").alias("n"))
    back = m.select(F.col("a").alias("h"), F.col("h").alias("a"))
    return m.join(back, ["h", "a"], "left_semi").agg(F.round(F.sum("s") / F.sum("n"), 10).alias("home_field"), F.sum("n").alias("n"))


@query(
    "R21_pair_estimate",
    f"""with l as (select season, home_team h, away_team a, arg_max({MARGIN}, game_id) m from played where not neutral_site group by 1, 2, 3), p as (select x.season, (x.m + y.m) / 2.0 half from l x join l y on x.season = y.season and x.h = y.a and x.a = y.h and x.h < x.a)
    select count(*) n, round(avg(half), 6) mean, round(stddev_samp(half) / sqrt(count(*)), 6) se, round(median(half), 6) median from p""",
)
def pair_estimate(spark: SparkSession, d: str) -> DataFrame:
    """The venue's worth a pair that met at both places in a season: the halves' mean, its error and the median."""
    last = A.played(spark, d).where("not neutral_site").groupBy("season", F.col("home_team").alias("h"), F.col("away_team").alias("a")).agg(F.max_by(F.expr(MARGIN), "game_id").alias("m"))
    other = last.select("season", F.col("a").alias("h"), F.col("h").alias("a"), F.col("m").alias("back"))
    half = last.join(other, ["season", "h", "a"]).where("h < a").select(((F.col("m") + F.col("back")) / 2).alias("half"))
    return half.agg(F.count("*").alias("n"), F.round(F.avg("half"), 6).alias("mean"), F.round(F.stddev_samp("half") / F.sqrt(F.count("*")), 6).alias("se"), F.round(F.median("half"), 6).alias("median"))


def blend_walk(spark: SparkSession, d: str) -> DataFrame:
    """Layer 3 as of every bucket."""
    return fitted.blend(fitted.layers(A.played(spark, d), fitted.contest_steps(spark, d), every=True))


def as_of_rows(walk: DataFrame, *columns: str) -> DataFrame:
    return walk.groupBy("season", "as_of").agg(*(F.first(c).alias(c) for c in columns))


@query("R22_sigma_estimator", "select season, as_of, round(sigma, 5) sigma, sigma_source, n_residuals from weights_b")
def sigma_estimator(spark: SparkSession, d: str) -> DataFrame:
    """Root mean square error of the predictions made before their games; the configured value where they are few or it is larger."""
    return as_of_rows(blend_walk(spark, d), "sigma", "sigma_source", "n_residuals").withColumn("sigma", F.round("sigma", 5))


@query("R24_season_accumulator", 'select season, as_of, round(w1, 5) w1, round(w2, 5) w2, round(home_field, 5) home_field, source, n_weights from weights_b')
def season_accumulator(spark: SparkSession, d: str) -> DataFrame:
    """Blend weights as of every bucket, from the games predicted so far."""
    w = as_of_rows(blend_walk(spark, d), "w1", "w2", "home_field", "source", "n_weights")
    return w.withColumns({c: F.round(c, 5) for c in ("w1", "w2", "home_field")})


def blended(games: DataFrame, steps: DataFrame | None) -> DataFrame:
    """Layer 3 of every whole season: (season, team, rating), w1 * k * net + w2 * rho over the union of teams."""
    return fitted.blend(fitted.layers(games, steps)).select("season", "team", "rating", "w1", "w2", F.col("home_field").alias("h"))


@query("R25_power_fit", "select season, team, round(rating, 6) rating, round(w1, 6) w1, round(w2, 6) w2 from blend_s")
def power_fit(spark: SparkSession, d: str) -> DataFrame:
    f = blended(A.played(spark, d), fitted.contest_steps(spark, d))
    return f.select("season", "team", *(F.round(c, 6).alias(c) for c in ("rating", "w1", "w2")))


@query("R26_power_walk", "select season, as_of, team, round(rating, 4) rating from blend_b")
def power_walk(spark: SparkSession, d: str) -> DataFrame:
    """Layer 3 as of every bucket, its weights from games that were predicted before they were seen; all buckets in one plan."""
    return blend_walk(spark, d).select("season", "as_of", "team", F.round("rating", 4).alias("rating"))


LAST = "qualify as_of = max(as_of) over (partition by season)"


@query("R27_power_source", f"select season, as_of, team, round(rating, 4) rating, round(w2, 5) se_scale, sigma_source, round(sigma, 5) sigma from blend_b join weights_b using (season, as_of) {LAST}")
def power_source(spark: SparkSession, d: str) -> DataFrame:
    """The walk's last Power of every season with what readers need beside it."""
    w = blend_walk(spark, d).withColumn("last", F.max("as_of").over(Window.partitionBy("season"))).where("as_of = last")
    return w.select("season", "as_of", "team", F.round("rating", 4).alias("rating"), F.round("w2", 5).alias("se_scale"), "sigma_source", F.round("sigma", 5).alias("sigma"))


@query("R29_results_to_power", "select season, team, rating power from power")
def results_to_power(spark: SparkSession, d: str) -> DataFrame:
    return fitted.power(A.played(spark, d)).withColumnRenamed("rating", "power")


def power_of(games: DataFrame, source: str = "L2", steps: DataFrame | None = None) -> DataFrame:
    """(season, team, rating) by layer: the blend where it is asked for and there are steps (fitted.contest_steps), else results in points."""
    if source not in ("L2", "L3"):
        raise ValueError(f"unknown power source {source!r}")
    if source == "L3" and steps is not None:
        return blended(games, steps).select("season", "team", F.round("rating", 6).alias("rating"))
    return fitted.power(games)


def season_power(spark: SparkSession, d: str, games: DataFrame | None = None, source: str = "L3") -> DataFrame:
    """(season, team, rating): the Power that readers take unless they are told another source."""
    games = A.played(spark, d) if games is None else games
    return power_of(games, source, fitted.contest_steps(spark, d) if source == "L3" else None)


@query("R30_power_dispatch", "select source, season, team, rating from (select 'L3 without steps' source, season, team, rating from power union all select 'L3', season, team, round(rating, 6) from blend_s)")
def power_dispatch(spark: SparkSession, d: str) -> DataFrame:
    g = A.played(spark, d)
    both = {"L3 without steps": power_of(g, "L3", None), "L3": power_of(g, "L3", fitted.contest_steps(spark, d))}
    rows = [f.select(F.lit(name).alias("source"), "season", "team", "rating") for name, f in both.items()]
    return rows[0].unionByName(rows[1])


_POOLED = al.Ols("margin", ["1", "delta", "site"])
_POOLED_RSS = f"(yy - ({' + '.join(f'{c} * t{i}' for i, c in enumerate(_POOLED.coefficients))}))"


@query("R32_pooled_ols", f"with g as ({PREDICTED}), s as (select count(*) n, sum(margin) sy, {_POOLED.select} from g) select n, {', '.join(f'round({c}, 6) b{i}' for i, c in enumerate(_POOLED.coefficients))}, round(sqrt({_POOLED_RSS} / greatest(n - 3, 1)), 6) sd, round(1 - {_POOLED_RSS} / (yy - sy * sy / n), 6) r2 from s")
def pooled_ols(spark: SparkSession, d: str) -> DataFrame:
    """One fit over all seasons, with its residual deviation and R squared, from one row of sums."""
    s = _POOLED.aggregate(base(spark, d), [], [F.count("*").alias("n"), F.sum("margin").alias("sy")])
    rss = F.expr(_POOLED_RSS)
    return s.select("n", *(F.round(F.expr(c), 6).alias(f"b{i}") for i, c in enumerate(_POOLED.coefficients)), F.round(F.sqrt(rss / F.greatest(F.col("n") - 3, F.lit(1))), 6).alias("sd"), F.round(1 - rss / (F.col("yy") - F.col("sy") * F.col("sy") / F.col("n")), 6).alias("r2"))


BRIDGE = "(cast(home_class = 'fbs' as int) - cast(away_class = 'fbs' as int))"
_CROSS = al.Ols("margin", ["1", "delta", "bridge"])
CROSS = f"""select c.*, {MARGIN} margin, {BRIDGE} bridge, coalesce(h.rating, 0) - coalesce(a.rating, 0) delta from contests c left join season_power h on h.season = c.season and h.team = home_team left join season_power a on a.season = c.season and a.team = away_team where completed"""


@query("R33_cross_division", f"with g as ({CROSS}), s as (select season, count(*) n, count(case when bridge <> 0 then 1 end) n_bridge, {_CROSS.select} from g group by season) select season, n, n_bridge, case when n_bridge >= {LEAST_GAMES} then round(-({_CROSS.coefficients[2]}), 6) end gap, case when n_bridge >= {LEAST_GAMES} then 'measured' else 'unmeasured' end status from s")
def cross_division(spark: SparkSession, d: str) -> DataFrame:
    """What the lower class is worth less, from games across classes; unmeasured with too few of them."""
    g = A.contests(spark, d).where("completed")
    rows = predicted(g, season_power(spark, d)).withColumn("bridge", F.expr(BRIDGE))
    s = _CROSS.aggregate(rows, ["season"], [F.count("*").alias("n"), F.count(F.when(F.col("bridge") != 0, 1)).alias("n_bridge")])
    enough = F.col("n_bridge") >= LEAST_GAMES
    return s.select("season", "n", "n_bridge", F.when(enough, F.round(-F.expr(_CROSS.coefficients[2]), 6)).alias("gap"), F.when(enough, "measured").otherwise("unmeasured").alias("status"))


register_ols("R34_error_attribution", "margin - delta", ["1", "hr", "site"], ["b0", "b_home", "b_site"], doc="The error on its contributions.")
register_ols("R35_variance_polynomial", "pow(cast(margin - delta as double), 2)", ["1", "abs(delta)"], ["v0", "v1"], doc="Squared error on the size of the prediction.")
register_ols("R36_contrast", "delta", ["1", "site"], ["mean", "site_effect"], doc="How far the site goes along with the contrast.")
