"""Orderings by record against the exact schedule: root solves and Poisson-binomial tails (Q*)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions.expr import compress_sql, phi_sql, response_sql, rounded
from tallyforge.functions.solve import BOUND, HALVINGS, log_key_sql, pmf, upper_tail, wins_root
from tallyforge.operators import ratings as R
from tallyforge.plans.registry import query
from tallyforge.sources import adapters as A

EDGE, SIGMA = A.HOME_EDGE, A.SIGMA
CAP, WIN_BONUS = 32.0, 7.0
NODES, WEIGHTS = np.polynomial.hermite.hermgauss(20)
REFERENCE_RANK = 25

SCHEDULE = "select s.*, coalesce(p.rating, 0) opp from sides s left join season_power p on p.season = s.season and p.team = s.opponent"
Q_REF = f"""select season, coalesce(max(case when r = {REFERENCE_RANK} then rating end), min(rating)) q_ref from (select season, rating, row_number() over (partition by season order by rating desc, team) r from season_power) group by season"""


def schedule(games: DataFrame, ratings: DataFrame) -> DataFrame:
    """Two rows a game: a team, its opponent's Power (0 where it has none), the site, the outcome."""
    p = ratings.select("season", F.col("team").alias("opponent"), F.col("rating").alias("opp"))
    return A.sides(games).join(p, ["season", "opponent"], "left").withColumn("opp", F.coalesce("opp", F.lit(0.0)))


def reference_quality(ratings: DataFrame, rank: int = REFERENCE_RANK) -> DataFrame:
    """(season, q_ref): the rating at a rank of the pool by (-rating, team); the last one's where the pool is shorter."""
    r = ratings.withColumn("r", F.row_number().over(Window.partitionBy("season").orderBy(F.desc("rating"), "team")))
    return r.groupBy("season").agg(F.coalesce(F.max(F.when(F.col("r") == rank, F.col("rating"))), F.min("rating")).alias("q_ref"))


def inputs(spark: SparkSession, d: str, source: str = "L3") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Games, Power of whole seasons by its source, and the schedules that meet it."""
    g = A.played(spark, d)
    p = R.season_power(spark, d, g, source)
    return g, p, schedule(g, p)


@query("Q01_schedule_with_margin", f"select season, game_id, team, opponent, site, won, round(opp, 6) opp, round({response_sql('margin')}, 6) s from ({SCHEDULE})")
def schedule_with_margin(spark: SparkSession, d: str) -> DataFrame:
    s = inputs(spark, d)[2]
    return s.select("season", "game_id", "team", "opponent", "site", "won", F.round("opp", 6).alias("opp"), F.round(F.expr(response_sql("margin")), 6).alias("s"))


AWAY_BY_NOT = "case when side = 'home' then won else 1 - lost end"


@query("Q02_schedule_margin_free", "select season, game_id, team, site, case when side = 'home' then cast(margin > 0 as int) else cast(not (margin < 0) as int) end won from sides_of_all where team_class = 'fbs' and opponent_class = 'fbs'")
def schedule_margin_free(spark: SparkSession, d: str) -> DataFrame:
    """A tie is the away side's win: it wins wherever the home side didn't."""
    g = A.contests(spark, d).where("home_class = 'fbs' and away_class = 'fbs'")
    return A.sides(g).select("season", "game_id", "team", "site", F.expr(AWAY_BY_NOT).alias("won"))


WIN_P = phi_sql("z")
WITH_Z = f"select s.*, q_ref, (q_ref - opp + {EDGE} * site) / {SIGMA} z from ({SCHEDULE}) s join ({Q_REF}) using (season)"


def with_probability(s: DataFrame, ratings: DataFrame) -> DataFrame:
    """The chance that a team of reference quality wins each game of each schedule."""
    q = F.broadcast(reference_quality(ratings))
    return s.join(q, "season").withColumn("z", (F.col("q_ref") - F.col("opp") + EDGE * F.col("site")) / SIGMA).withColumn("p", F.expr(WIN_P))


@query("Q03_expected_wins", f"select season, team, round(sum({WIN_P}), 6) expected from ({WITH_Z}) group by season, team")
def expected_wins(spark: SparkSession, d: str) -> DataFrame:
    _, p, s = inputs(spark, d)
    return with_probability(s, p).groupBy("season", "team").agg(F.round(F.sum("p"), 6).alias("expected"))


def quadrature_sql(mean: str) -> str:
    """Expectation of the compressed margin of a normal margin, by 20 nodes, and the bonus for winning."""
    terms = " + ".join(f"{float(w / np.sqrt(np.pi))!r} * {compress_sql(f'{mean} + {float(np.sqrt(2) * SIGMA * x)!r}', CAP)}" for x, w in zip(NODES, WEIGHTS, strict=True))
    return f"({terms})"


@query("Q04_expected_margin", f"select season, team, round(sum({quadrature_sql(f'z * {SIGMA}')} + {WIN_BONUS} * (2 * {WIN_P} - 1)), 5) expected from ({WITH_Z}) group by season, team")
def expected_margin(spark: SparkSession, d: str) -> DataFrame:
    _, p, s = inputs(spark, d)
    e = F.expr(f"{quadrature_sql(f'z * {SIGMA}')} + {WIN_BONUS} * (2 * p - 1)")
    return with_probability(s, p).groupBy("season", "team").agg(F.round(F.sum(e), 5).alias("expected"))


def solved(s: DataFrame, by: tuple[str, ...] = ("season", "team")) -> DataFrame:
    """(by, wins, losses, resume, saturated): the quality whose expected wins are the wins.

    The schedule of a team is a sorted array of a few games, so the sums don't depend on the partitioning; teams without
    losses or wins end at a bound and are marked.
    """
    games = F.sort_array(F.collect_list(F.struct("game_id", F.col("opp").alias("power"), F.col("site").cast("double").alias("site"))))
    t = s.groupBy(*by).agg(games.alias("games"), F.sum("won").cast("double").alias("target"), F.sum("won").alias("wins"), F.sum("lost").alias("losses"))
    t = t.withColumn("root", wins_root("target", "games", EDGE, SIGMA))
    saturated = F.when(F.col("root") > BOUND - 1e-9, 1).when(F.col("root") < -BOUND + 1e-9, -1).otherwise(0)
    resume = F.when(saturated != 0, saturated * BOUND).otherwise(F.col("root"))
    return t.select(*by, "wins", "losses", F.round(resume, 5).alias("resume"), saturated.alias("saturated"))


def margin_of(mean: str, cap: str) -> str:
    """Expected compressed margin of a normal margin about `mean`, for a cap that is a column; infinity compresses nothing."""
    terms = " + ".join(f"{float(w / np.sqrt(np.pi))!r} * tanh(({mean} + {float(np.sqrt(2) * SIGMA * x)!r}) / {cap})" for x, w in zip(NODES, WEIGHTS, strict=True))
    return f"(case when {cap} > 1e300 then {mean} else {cap} * ({terms}) end)"


def solved_by_margin(s: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by, wins, resume): the quality whose expected responses are the responses, for rows with opp, site and response; `by` has cap and bonus."""
    games = F.sort_array(F.collect_list(F.struct("game_id", F.col("opp").alias("power"), F.col("site").cast("double").alias("site"))))
    t = s.groupBy(*by).agg(games.alias("games"), F.round(F.sum("response"), 9).alias("target"), F.sum("won").alias("wins"))
    each = f"transform(games, g -> (s.lo + s.hi) / 2 - g.power + {EDGE!r} * g.site)"
    value = f"aggregate({each}, 0D, (acc, d) -> acc + {margin_of('d', 'cap')} + bonus * (2 * {phi_sql(f'(d / {SIGMA!r})')} - 1))"
    step = f"(s, i) -> case when {value} < target then named_struct('lo', (s.lo + s.hi) / 2, 'hi', s.hi) else named_struct('lo', s.lo, 'hi', (s.lo + s.hi) / 2) end"
    root = F.expr(f"aggregate(sequence(1, {HALVINGS}), named_struct('lo', -{BOUND}D, 'hi', {BOUND}D), {step}, s -> (s.lo + s.hi) / 2)")
    return t.select(*by, "wins", F.round(F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), root)), 5).alias("resume"))


BISECTION = f"""with recursive sched as materialized ({SCHEDULE}), t as materialized (select season, team, cast(sum(won) as double) target, sum(won) wins, sum(lost) losses from sched group by 1, 2),
  b as (select season, team, 0 i, -{BOUND}::double lo, {BOUND}::double hi, target from t
    union all select season, team, i + 1, case when w < target then mid else lo end, case when w < target then hi else mid end, target from (
      select season, team, i, lo, hi, mid, target, sum({WIN_P}) w from (select b.*, (lo + hi) / 2 mid, ((lo + hi) / 2 - opp + {EDGE} * site) / {SIGMA} z from b join sched using (season, team) where i < {HALVINGS}) group by all)),
  r as (select season, team, (lo + hi) / 2 root from b where i = {HALVINGS}),
  res as (select season, team, cast(wins as bigint) wins, cast(losses as bigint) losses, case when root > {BOUND} - 1e-9 then 1 when root < -{BOUND} + 1e-9 then -1 else 0 end saturated,
    round(case when root > {BOUND} - 1e-9 then {BOUND} when root < -{BOUND} + 1e-9 then -{BOUND} else root end, 5) resume from r join t using (season, team))
"""


@query("Q05_bisection", BISECTION + "select season, team, resume, saturated from res")
def bisection(spark: SparkSession, d: str) -> DataFrame:
    return solved(inputs(spark, d)[2]).select("season", "team", "resume", "saturated")


@query("Q08_resume_fit", BISECTION + "select season, team, wins, losses, resume from res")
def resume_fit(spark: SparkSession, d: str) -> DataFrame:
    return solved(inputs(spark, d)[2]).select("season", "team", "wins", "losses", "resume")


@query("Q09_resume_table", BISECTION + "select season, team, resume, cast(row_number() over (partition by season order by resume desc, wins desc, team) as int) rank from res")
def resume_table(spark: SparkSession, d: str) -> DataFrame:
    r = solved(inputs(spark, d)[2])
    return r.select("season", "team", "resume", F.row_number().over(Window.partitionBy("season").orderBy(F.desc("resume"), F.desc("wins"), "team")).alias("rank"))


@query("Q06_scalar_wins", f"select game_id, round({WIN_P}, 6) p from (select game_id, cast(home_points - away_points as double) / {SIGMA} z from contests)")
def scalar_wins(spark: SparkSession, d: str) -> DataFrame:
    """The inner term of the wins solver, game by game."""
    return A.contests(spark, d).select("game_id", F.expr(f"cast(home_points - away_points as double) / {SIGMA}").alias("z")).select("game_id", F.round(F.expr(WIN_P), 6).alias("p"))


@query("Q07_scalar_margin", f"select game_id, round({quadrature_sql('m')}, 5) e from (select game_id, cast(home_points - away_points as double) m from contests)")
def scalar_margin(spark: SparkSession, d: str) -> DataFrame:
    return A.contests(spark, d).select("game_id", F.expr("cast(home_points - away_points as double)").alias("m")).select("game_id", F.round(F.expr(quadrature_sql("m")), 5).alias("e"))


@query("Q10_hindsight_rating", f"select season, team, bucket_order through, round(sum(faced) over w, 5) faced, sum(won) over w wins from (select s.season, team, bucket_order, sum(opp) faced, sum(won) won from ({SCHEDULE}) s group by 1, 2, 3) window w as (partition by season, team order by bucket_order)", wins="bigint")
def hindsight_rating(spark: SparkSession, d: str) -> DataFrame:
    """The record through each of a team's buckets met with the Power of the whole season."""
    met = F.sort_array(F.collect_list(F.struct("game_id", "opp")))  # in order, so that the sum doesn't depend on the partitioning
    faced = F.aggregate(met, F.lit(0.0), lambda total, x: total + x["opp"])
    s = inputs(spark, d)[2].groupBy("season", "team", "bucket_order").agg(faced.alias("faced"), F.sum("won").alias("won"))
    so_far = Window.partitionBy("season", "team").orderBy("bucket_order")
    return s.select("season", "team", F.col("bucket_order").alias("through"), rounded(F.sum("faced").over(so_far), 5).alias("faced"), F.sum("won").over(so_far).alias("wins"))


@query("Q11_team_class", "select team, min(team_class) team_class from sides_of_all group by team")
def team_class(spark: SparkSession, d: str) -> DataFrame:
    """The highest class a team was seen in; class names sort from the highest."""
    return A.sides(A.contests(spark, d)).groupBy("team").agg(F.min("team_class").alias("team_class"))


@query("Q12_reference_quality", f"select season, round(q_ref, 6) q_ref, n pool from ({Q_REF}) join (select season, count(*) n from season_power group by 1) using (season)")
def reference_quality_rows(spark: SparkSession, d: str) -> DataFrame:
    p = inputs(spark, d)[1]
    return reference_quality(p).join(p.groupBy("season").agg(F.count("*").alias("pool")), "season").select("season", F.round("q_ref", 6).alias("q_ref"), "pool")


@query("Q13_win_probabilities", f"select season, game_id, team, round({WIN_P}, 6) p from ({WITH_Z})")
def win_probabilities(spark: SparkSession, d: str) -> DataFrame:
    _, p, s = inputs(spark, d)
    return with_probability(s, p).select("season", "game_id", "team", F.round("p", 6).alias("p"))


def odds(s: DataFrame, by: list[str]) -> DataFrame:
    """(by, wins, losses, n, expected, pmf, tail, mid, key) from rows with p, won, lost and game_id.

    The exact distribution of a reference team's wins on each schedule; tail is its chance of at least the wins.
    """
    t = s.groupBy(*by).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("game_id", "p"))), lambda x: x["p"]).alias("ps"), F.sum("won").cast("int").alias("wins"), F.sum("lost").cast("int").alias("losses"), F.count("*").cast("int").alias("n"),
    )
    t = t.withColumn("pmf", pmf("ps")).withColumn("tail", upper_tail("pmf", "wins"))
    t = t.withColumns({"expected": F.expr("aggregate(ps, 0D, (a, x) -> a + x)"), "mid": F.expr("tail - 0.5 * pmf[wins]"), "key": F.expr(log_key_sql("tail"))})
    return t.drop("ps")


def odds_sql(rows: str, by: str) -> str:
    """CTEs ending in `odds`, over rows (by, game_id, p, won, lost)."""
    return f"""recursive pr as materialized ({rows}),
    o as materialized (select {by}, game_id, p, row_number() over (partition by {by} order by game_id) step_no from pr),
    st as (select {by}, cast(sum(won) as bigint) wins, sum(lost) losses, count(*) n, sum(p) expected from pr group by {by}),
    conv as (select {by}, 0::bigint step_no, [1.0::double] acc from st
      union all select {by}, o.step_no, list_transform(range(1, len(acc) + 2), lambda i: coalesce(acc[i], 0) * (1 - p) + case when i > 1 then coalesce(acc[i - 1], 0) else 0 end * p) from conv c join o using ({by}) where o.step_no = c.step_no + 1),
    odds as (select {by}, cast(wins as int) wins, cast(losses as int) losses, cast(n as int) n, expected, acc pmf, list_sum(acc[wins + 1:]) tail, list_sum(acc[wins + 1:]) - 0.5 * acc[wins + 1] mid, {log_key_sql('list_sum(acc[wins + 1:])')} as key
      from conv join st using ({by}) where step_no = n)"""


SEASON_ODDS = "with " + odds_sql(f"select season, team, game_id, {WIN_P} p, won, lost from ({WITH_Z})", "season, team") + " "


def season_odds(spark: SparkSession, d: str) -> DataFrame:
    _, p, s = inputs(spark, d)
    return odds(with_probability(s, p), ["season", "team"])


@query("Q14_win_distribution", SEASON_ODDS + "select season, team, k - 1 w, round(pmf[k], 6) p from (select season, team, pmf, unnest(range(1, n + 2)) k from odds)", w="int")
def win_distribution(spark: SparkSession, d: str) -> DataFrame:
    t = season_odds(spark, d).select("season", "team", F.posexplode("pmf").alias("w", "p"))
    return t.select("season", "team", "w", F.round("p", 6).alias("p"))


for _name, _column in (("Q15_upper_tail", "tail"), ("Q16_mid_p", "mid"), ("Q17_log_key", "key")):

    @query(_name, SEASON_ODDS + f"select season, team, round({_column}, 6) {_column} from odds")
    def one_column(spark: SparkSession, d: str, _column: str = _column) -> DataFrame:
        return season_odds(spark, d).select("season", "team", F.round(_column, 6).alias(_column))


def ranked(t: DataFrame, by: list[str]) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.round("tail", 12), F.round("mid", 12), "team"))


@query("Q18_odds_fit", SEASON_ODDS + "select season, team, wins, losses, round(expected, 6) expected, round(tail, 6) tail, round(mid, 6) mid from odds")
def odds_fit(spark: SparkSession, d: str) -> DataFrame:
    t = season_odds(spark, d)
    return t.select("season", "team", "wins", "losses", *(F.round(c, 6).alias(c) for c in ("expected", "tail", "mid")))


@query("Q19_schedule_odds", SEASON_ODDS + "select season, team, wins, losses, round(expected, 6) expected, round(tail, 6) tail, round(key, 5) as key, cast(row_number() over (partition by season order by round(tail, 12), round(mid, 12), team) as int) rank from odds")
def schedule_odds(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: teams of a season from the least probable record on."""
    t = season_odds(spark, d)
    return t.select("season", "team", "wins", "losses", F.round("expected", 6).alias("expected"), F.round("tail", 6).alias("tail"), F.round("key", 5).alias("key"), ranked(t, ["season"]).alias("rank"))


@query("Q20_scalar_odds", SEASON_ODDS + "select season, max(round(tail, 6)) most, min(round(tail, 6)) least, count(*) teams from odds group by season")
def scalar_odds(spark: SparkSession, d: str) -> DataFrame:
    return season_odds(spark, d).groupBy("season").agg(F.max(F.round("tail", 6)).alias("most"), F.min(F.round("tail", 6)).alias("least"), F.count("*").alias("teams"))


@query("Q21_surprise", SEASON_ODDS + "select season, team, round(wins - expected, 6) surprise, round(-rating, 6) gap from odds join season_power using (season, team)")
def surprise(spark: SparkSession, d: str) -> DataFrame:
    """Wins above expectation, and how far the Power lies below nought."""
    t = season_odds(spark, d).join(inputs(spark, d)[1], ["season", "team"])
    return t.select("season", "team", F.round(F.col("wins") - F.col("expected"), 6).alias("surprise"), F.round(-F.col("rating"), 6).alias("gap"))


@query("Q22_sigma_provenance", f"select season, coalesce(case when n >= 700 then sd end, {SIGMA}) sigma, case when n >= 700 then 'power' else 'config' end source from (select season, count(*) n, round(stddev_samp(margin), 6) sd from sides where side = 'home' group by season)")
def sigma_provenance(spark: SparkSession, d: str, least: int = 700) -> DataFrame:
    s = A.sides(A.played(spark, d)).where("side = 'home'").groupBy("season").agg(F.count("*").alias("n"), F.round(F.stddev_samp("margin"), 6).alias("sd"))
    own = F.when(F.col("n") >= least, F.col("sd"))
    return s.select("season", F.coalesce(own, F.lit(SIGMA)).alias("sigma"), F.when(own.isNotNull(), "power").otherwise("config").alias("source"))
