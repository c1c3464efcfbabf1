"""Back-test metrics, walk-forward evaluation and gates (M*)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions.algebra import Ols
from tallyforge.functions.expr import phi_sql
from tallyforge.operators import baselines as B
from tallyforge.operators import ratings as R
from tallyforge.operators import fitted
from tallyforge.plans.registry import query, rule
from tallyforge.sources import adapters as A

BINS = 10
COUNTED = 20
LEAST_TRAIN = 20
TRAIL = 5
LEAST_CALIBRATION = 40
Z95 = 1.96

# Predictions of every game by the ratings of the bucket before it: predicted margin m, chance p, outcome y.
WALK = f"""walk as materialized (select g.season, g.bucket_order, g.game_id, g.home_team, g.away_team, g.neutral_site, {R.MARGIN} actual, coalesce(h.rating, 0) hr, coalesce(a.rating, 0) ar,
  coalesce(h.rating, 0) - coalesce(a.rating, 0) + {A.HOME_EDGE} * {R.SITE} predicted from played g
  left join cum h on h.season = g.season and h.as_of = g.bucket_order - 1 and h.team = home_team left join cum a on a.season = g.season and a.as_of = g.bucket_order - 1 and a.team = away_team where g.bucket_order > 0)"""
SCORED = f"""with cum as materialized (select * from power_as_of), {WALK}, sc as (select *, case when actual > 0 then 1 else 0 end y, round({phi_sql('z')}, 9) p from (select *, predicted / cast({A.SIGMA} as double) z from walk))
"""


def walk(games: DataFrame) -> DataFrame:
    """Each game predicted by Power as of the bucket before; all buckets in one plan."""
    p = fitted.power_by_bucket(games)
    g = games.where("bucket_order > 0").withColumn("as_of", F.col("bucket_order") - 1)
    for side, short in (("home", "hr"), ("away", "ar")):
        g = g.join(p.select("season", "as_of", F.col("team").alias(f"{side}_team"), F.col("rating").alias(short)), ["season", "as_of", f"{side}_team"], "left").withColumn(short, F.coalesce(short, F.lit(0.0)))
    g = g.withColumns({"actual": F.expr(R.MARGIN), "predicted": F.col("hr") - F.col("ar") + A.HOME_EDGE * F.expr(R.SITE)})
    return g.select("season", "bucket_order", "game_id", "home_team", "away_team", "neutral_site", "actual", "hr", "ar", "predicted")


def scored(spark: SparkSession, d: str) -> DataFrame:
    w = walk(A.played(spark, d)).withColumn("z", F.expr(f"predicted / cast({A.SIGMA} as double)"))
    return w.withColumns({"y": F.expr("case when actual > 0 then 1 else 0 end"), "p": F.round(F.expr(phi_sql("z")), 9)})


METRICS = {
    "su": "avg(case when predicted = 0 then cast(0.5 as double) when sign(predicted) = sign(actual) then 1 else 0 end)",
    "mae": "avg(abs(predicted - actual))",
    "rmse": "sqrt(avg(pow(cast(predicted - actual as double), 2)))",
    "brier": "avg(pow(cast(p - y as double), 2))",
    "logloss": "avg(-(y * ln(greatest(1e-9, least(1 - 1e-9, p))) + (1 - y) * ln(greatest(1e-9, least(1 - 1e-9, 1 - p)))))",
}


def measured(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *(F.round(F.expr(f"cast({v} as double)"), 6).alias(k) for k, v in METRICS.items()))


MEASURES = ", ".join(f"round(cast({v} as double), 6) {k}" for k, v in METRICS.items())


@query("M01_win_chance", SCORED + f"select game_id, round({phi_sql('z')}, 6) p from sc")
def win_chance(spark: SparkSession, d: str) -> DataFrame:
    """Rounded once, from the chance itself: what `scored` rounds to nine places may lie on the border of six."""
    return scored(spark, d).select("game_id", F.round(F.expr(phi_sql("z")), 6).alias("p"))


for _name, _keys in (("M02_straight_up", ("su",)), ("M03_errors", ("mae", "rmse")), ("M04_brier", ("brier",)), ("M05_log_loss", ("logloss",)), ("M10_summary", tuple(METRICS))):

    @query(_name, SCORED + "select season, count(*) n, " + ", ".join(f"round(cast({METRICS[k]} as double), 6) {k}" for k in _keys) + " from sc group by season")
    def metric_rows(spark: SparkSession, d: str, _keys: tuple[str, ...] = _keys) -> DataFrame:
        return measured(scored(spark, d), "season").select("season", "n", *_keys)


BIN = f"cast(least({BINS - 1}, floor(p * {BINS})) as int)"


def calibration(rows: DataFrame) -> DataFrame:
    """Equal-width bins, the last closed; empty ones present with nulls; counted from COUNTED games on."""
    bins = rows.sparkSession.range(BINS).select(F.col("id").cast("int").alias("bin"))
    got = rows.groupBy(F.expr(BIN).alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("predicted"), F.round(F.avg("y"), 6).alias("observed"))
    return bins.join(got, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "predicted", "observed", (F.coalesce("n", F.lit(0)) >= COUNTED).alias("counted"))


CALIBRATION = f"(select cast(b.bin as int) bin, coalesce(n, 0) n, predicted, observed, coalesce(n, 0) >= {COUNTED} counted from (select unnest(range({BINS})) bin) b left join (select {BIN} bin, count(*) n, round(avg(p), 6) predicted, round(avg(y), 6) observed from sc group by 1) using (bin))"


@query("M06_calibration", SCORED + f"select * from {CALIBRATION}")
def calibration_rows(spark: SparkSession, d: str) -> DataFrame:
    return calibration(scored(spark, d))


@query("M07_calibration_deviation", SCORED + f"select round(max(abs(observed - predicted)), 5) most from {CALIBRATION} where counted")
def calibration_deviation(spark: SparkSession, d: str) -> DataFrame:
    return calibration(scored(spark, d)).where("counted").agg(F.round(F.max(F.abs(F.col("observed") - F.col("predicted"))), 5).alias("most"))


VIOLATED = "case when (case when margin > 0 then hr else ar end) < (case when margin > 0 then ar else hr end) then 1 else 0 end"


@query("M08_violations", f"select season, count(*) n, cast(sum({VIOLATED}) as bigint) violations from ({R.PREDICTED}) group by season")
def violations(spark: SparkSession, d: str) -> DataFrame:
    """Games whose winner is rated below the loser."""
    return R.base(spark, d).groupBy("season").agg(F.count("*").alias("n"), F.sum(F.expr(VIOLATED)).alias("violations"))


RANKS = f"ranks as (select season, as_of, team, row_number() over (partition by season, as_of order by rating desc, team) r from (select * from power_as_of))"


def bucket_ranks(games: DataFrame) -> DataFrame:
    w = Window.partitionBy("season", "as_of").orderBy(F.desc("rating"), "team")
    return fitted.power_by_bucket(games).withColumn("r", F.row_number().over(w))


@query("M09_rank_churn", f"with {RANKS} select a.season, a.as_of, round(avg(abs(a.r - b.r)), 6) churn, count(*) n from ranks a join ranks b on b.season = a.season and b.team = a.team and b.as_of = a.as_of - 1 group by 1, 2")
def rank_churn(spark: SparkSession, d: str) -> DataFrame:
    """Mean change of rank since the bucket before."""
    r = bucket_ranks(A.played(spark, d))
    before = r.select("season", (F.col("as_of") + 1).alias("as_of"), "team", F.col("r").alias("was"))
    return r.join(before, ["season", "as_of", "team"]).groupBy("season", "as_of").agg(F.round(F.avg(F.abs(F.col("r") - F.col("was"))), 6).alias("churn"), F.count("*").alias("n"))


@rule("M11_violation_rivals")
def violation_rivals(spark: SparkSession, d: str) -> DataFrame:
    """Whom each rater's violations are held against: all scored ones but itself and the constant."""
    names = [n for n in B.RATERS if n != "home_team"]
    return spark.createDataFrame([(a, b) for a in names for b in names if a != b], "system string, rival string")


CALIBRATE = Ols("actual", ["1", "hr - ar", R.SITE])
TRAINED = f"""tr as (select season, bucket_order, count(*) n, {CALIBRATE.select} from walk group by 1, 2),
  co as (select b.season, b.bucket_order, sum(t.n) n, {", ".join(f"sum(t.{k}) {k}" for k in CALIBRATE.sums)} from (select distinct season, bucket_order from walk) b join tr t on t.season = b.season and t.bucket_order < b.bucket_order and t.bucket_order >= b.bucket_order - {TRAIL} group by 1, 2),
  fit as (select season, bucket_order, {", ".join(f"{c} c{i}" for i, c in enumerate(CALIBRATE.coefficients))} from co where n >= {LEAST_CALIBRATION})"""


def calibrated(games: DataFrame) -> DataFrame:
    """Predictions by coefficients fitted on the trailing buckets' own out-of-sample predictions; raw ones where these are too few."""
    w = walk(games)
    sums = CALIBRATE.aggregate(w, ["season", "bucket_order"], [F.count("*").alias("n")])
    past = Window.partitionBy("season").orderBy("bucket_order").rangeBetween(-TRAIL, -1)
    rolled = sums.select("season", "bucket_order", *(F.sum(c).over(past).alias(c) for c in ("n", *CALIBRATE.sums))).where(F.col("n") >= LEAST_CALIBRATION)
    fit = rolled.select("season", "bucket_order", *(F.expr(c).alias(f"c{i}") for i, c in enumerate(CALIBRATE.coefficients)))
    j = w.join(fit, ["season", "bucket_order"], "left")
    own = F.expr(f"c0 + c1 * (hr - ar) + c2 * {R.SITE}")
    return j.withColumns({"raw": F.col("predicted"), "trained": own.isNotNull(), "predicted": F.coalesce(own, F.col("predicted"))})


@query(
    "M14_walk_forward",
    f"with cum as materialized (select * from power_as_of), {WALK}, {TRAINED}, pr as (select w.*, coalesce(c0 + c1 * (hr - ar) + c2 * {R.SITE}, predicted) m, c0 is not null trained from walk w left join fit using (season, bucket_order)) "
    "select season, trained, count(*) n, round(avg(abs(m - actual)), 5) mae, round(sqrt(avg(pow(cast(m - actual as double), 2))), 5) rmse from pr group by 1, 2",
)
def walk_forward(spark: SparkSession, d: str) -> DataFrame:
    c = calibrated(A.played(spark, d))
    miss = F.col("predicted") - F.col("actual")
    return c.groupBy("season", "trained").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(miss)), 5).alias("mae"), F.round(F.sqrt(F.avg(F.pow(miss, 2))), 5).alias("rmse"))


R.register_ols("M15_in_sample_calibration", "margin", ["1", "delta", "site"], ["a", "b", "h"])


@query("M16_calibration_pool", f"with cum as materialized (select * from power_as_of), {WALK}, {TRAINED} select season, bucket_order, round(c0, 5) a, round(c1, 5) b, round(c2, 5) h from fit")
def calibration_pool(spark: SparkSession, d: str) -> DataFrame:
    w = walk(A.played(spark, d))
    sums = CALIBRATE.aggregate(w, ["season", "bucket_order"], [F.count("*").alias("n")])
    past = Window.partitionBy("season").orderBy("bucket_order").rangeBetween(-TRAIL, -1)
    rolled = sums.select("season", "bucket_order", *(F.sum(c).over(past).alias(c) for c in ("n", *CALIBRATE.sums))).where(F.col("n") >= LEAST_CALIBRATION)
    return rolled.select("season", "bucket_order", *(F.round(F.expr(c), 5).alias(n) for c, n in zip(CALIBRATE.coefficients, ("a", "b", "h"), strict=True)))


@query("M17_prediction", f"select game_id, round({R.compress_prediction_sql('m')}, 6) m from (select game_id, 1.5 + 1.1037519 * delta + 2.0 * site m from ({R.PREDICTED}))")
def prediction(spark: SparkSession, d: str) -> DataFrame:
    m = R.base(spark, d).select("game_id", F.expr("1.5D + 1.1037519D * delta + 2.0D * site").alias("m"))
    return m.select("game_id", F.round(F.expr(R.compress_prediction_sql("m")), 6).alias("m"))


@query("M18_rating_delta", f"select game_id, round(delta, 6) delta from ({R.CROSS})")
def rating_delta(spark: SparkSession, d: str) -> DataFrame:
    g = A.contests(spark, d).where("completed")
    return R.predicted(g, R.season_power(spark, d)).select("game_id", F.round("delta", 6).alias("delta"))


@query("M19_winner_loser", "select game_id, case when home_points > away_points then home_team else away_team end winner, case when home_points > away_points then away_team else home_team end loser from contests where completed")
def winner_loser(spark: SparkSession, d: str) -> DataFrame:
    home = F.col("home_points") > F.col("away_points")
    return A.contests(spark, d).where("completed").select("game_id", F.when(home, F.col("home_team")).otherwise(F.col("away_team")).alias("winner"), F.when(home, F.col("away_team")).otherwise(F.col("home_team")).alias("loser"))


@query("M20_pooled_rate", f"select round(sum(v) / sum(n), 6) rate, cast(sum(n) as bigint) n from (select season, count(*) n, sum({VIOLATED}) v from ({R.PREDICTED}) group by season)")
def pooled_rate(spark: SparkSession, d: str) -> DataFrame:
    s = R.base(spark, d).groupBy("season").agg(F.count("*").alias("n"), F.sum(F.expr(VIOLATED)).alias("v"))
    return s.agg(F.round(F.sum("v") / F.sum("n"), 6).alias("rate"), F.sum("n").alias("n"))


SPLIT = "case when season <= 1997 then 'tune' when season <= 1999 then 'validate' when season <= 2000 then 'holdout' else 'unassigned' end"


@query("M21_split_label", f"select {SPLIT} split, count(*) n, count(distinct season) seasons from played group by 1")
def split_label(spark: SparkSession, d: str) -> DataFrame:
    return A.played(spark, d).groupBy(F.expr(SPLIT).alias("split")).agg(F.count("*").alias("n"), F.countDistinct("season").alias("seasons"))


TWO_RANKS = "two as (select p.season, p.team, p.rating x, w.v y from power p join (select season, team, round((sum(won) + 0.5 * sum(tied)) / count(*), 6) v from sides group by 1, 2) w using (season, team))"


def two_ratings(spark: SparkSession, d: str) -> DataFrame:
    g = A.played(spark, d)
    return fitted.power(g).withColumnRenamed("rating", "x").join(B.win_share(g).select("season", "team", F.round("rating", 6).alias("y")), ["season", "team"])


@query(
    "M28_rank_movement",
    f"""with {TWO_RANKS}, pr as (select a.season, sign(a.x - b.x) * sign(a.y - b.y) c, a.x = b.x tx, a.y = b.y ty from two a join two b on a.season = b.season and a.team < b.team)
    select season, round(sum(c) / sqrt(cast(count(case when not tx then 1 end) as double) * count(case when not ty then 1 end)), 6) tau, count(*) pairs from pr group by season""",
)
def rank_movement(spark: SparkSession, d: str) -> DataFrame:
    """Kendall's tau-b of two orders: pairs of a season's teams, which a league bounds."""
    t = two_ratings(spark, d)
    o = t.select("season", F.col("team").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    pr = t.join(o, "season").where("team < other")
    c = F.sum(F.sign(F.col("x") - F.col("ox")) * F.sign(F.col("y") - F.col("oy")))
    return pr.groupBy("season").agg(F.round(c / F.sqrt(F.count(F.when(F.col("x") != F.col("ox"), 1)).cast("double") * F.count(F.when(F.col("y") != F.col("oy"), 1))), 6).alias("tau"), F.count("*").alias("pairs"))


WILSON = "(p + {z2} / (2 * n) {sign} {z} * sqrt(p * (1 - p) / n + {z2} / (4 * n * n))) / (1 + {z2} / n)"


def wilson(sign: str) -> str:
    return WILSON.format(z=f"cast({Z95} as double)", z2=f"cast({Z95 * Z95!r} as double)", sign=sign)


@query("M29_wilson_interval", f"select season, round(greatest(0, {wilson('-')}), 6) lo, round(least(1, {wilson('+')}), 6) hi from (select season, cast(count(*) as double) n, avg(case when margin > 0 then 1.0 else 0.0 end) p from sides where side = 'home' group by season)")
def wilson_interval(spark: SparkSession, d: str) -> DataFrame:
    s = A.sides(A.played(spark, d)).where("side = 'home'").groupBy("season").agg(F.count("*").cast("double").alias("n"), F.avg(F.when(F.col("margin") > 0, 1.0).otherwise(0.0)).alias("p"))
    return s.select("season", F.round(F.greatest(F.lit(0.0), F.expr(wilson("-"))), 6).alias("lo"), F.round(F.least(F.lit(1.0), F.expr(wilson("+"))), 6).alias("hi"))


def student_cdf(t: np.ndarray, df: float) -> np.ndarray:
    """Student's distribution function by the continued fraction of the incomplete beta function."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    front = np.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * np.log(x) + b * np.log1p(-np.minimum(x, 1 - 1e-16)))

    def fraction(x: np.ndarray, a: float, b: float) -> np.ndarray:
        f, c, e = np.ones_like(x), np.ones_like(x), np.zeros_like(x)
        for i in range(200):
            m = i // 2
            num = np.ones_like(x) if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            e = 1 / np.where(np.abs(1 + num * e) < 1e-300, 1e-300, 1 + num * e)
            c = np.where(np.abs(1 + num / c) < 1e-300, 1e-300, 1 + num / c)
            f = f * c * e
        return f - 1

    low = x < (a + 1) / (a + b + 2)
    tail = np.where(low, front * fraction(np.where(low, x, 0.5), a, b) / a, 1 - front * fraction(np.where(low, 0.5, 1 - x), b, a) / b)
    tail = np.where(t == 0, 1.0, tail)
    return np.where(t > 0, 1 - tail / 2, tail / 2)


@query("M30_student_chance")
def student_chance(spark: SparkSession, d: str, df: float = 7.0) -> DataFrame:
    """Win chances under a Student distribution of the same variance; df must be above 2."""
    if df <= 2:
        raise ValueError("the variance needs more than two degrees of freedom")
    scale = A.SIGMA * math.sqrt((df - 2) / df)

    @F.pandas_udf("double")
    def chance(m: pd.Series) -> pd.Series:
        return pd.Series(student_cdf(m.to_numpy(float) / scale, df))

    return walk(A.played(spark, d)).select("game_id", F.round(chance("predicted"), 6).alias("p"))


@query("M31_paired_brier", SCORED + ", q as (select season, pow(p - y, 2) - pow(cast(0.5 - y as double), 2) e from sc) select season, round(avg(e), 6) mean, round(stddev_samp(e) / sqrt(count(*)), 6) se, avg(e) <= stddev_samp(e) / sqrt(count(*)) is_within from q group by season")
def paired_brier(spark: SparkSession, d: str) -> DataFrame:
    e = F.pow(F.col("p") - F.col("y"), 2) - F.pow(0.5 - F.col("y"), 2)
    s = scored(spark, d).withColumn("e", e)
    se = F.stddev_samp("e") / F.sqrt(F.count("*"))
    return s.groupBy("season").agg(F.round(F.avg("e"), 6).alias("mean"), F.round(se, 6).alias("se"), (F.avg("e") <= se).alias("is_within"))


BETTER = "case when (actual > 0) = (h.r < a.r) then 1.0 else 0.0 end"


@query("M32_forward_accuracy", f"with {RANKS}, cum as materialized (select * from power_as_of), {WALK} select w.season, count(*) n, round(avg({BETTER}), 6) accuracy from walk w join ranks h on h.season = w.season and h.as_of = w.bucket_order - 1 and h.team = home_team join ranks a on a.season = w.season and a.as_of = w.bucket_order - 1 and a.team = away_team group by 1")
def forward_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """How often the better ranked of two ranked teams wins next."""
    g = A.played(spark, d)
    r = bucket_ranks(g)
    w = walk(g).withColumn("as_of", F.col("bucket_order") - 1)
    for side, short in (("home", "h"), ("away", "a")):
        w = w.join(r.select("season", "as_of", F.col("team").alias(f"{side}_team"), F.col("r").alias(short)), ["season", "as_of", f"{side}_team"])
    right = F.when((F.col("actual") > 0) == (F.col("h") < F.col("a")), 1.0).otherwise(0.0)
    return w.groupBy("season").agg(F.count("*").alias("n"), F.round(F.avg(right), 6).alias("accuracy"))


FINAL = "fin as (select season, team, row_number() over (partition by season order by rating desc, team) r from power)"


def final_ranks(games: DataFrame) -> DataFrame:
    return fitted.power(games).withColumn("r", F.row_number().over(Window.partitionBy("season").orderBy(F.desc("rating"), "team")))


@query("M33_rank_violations", f"with {FINAL} select s.season, count(*) n, cast(sum(cast(w.r > l.r as int)) as bigint) violations from sides s join fin w on w.season = s.season and w.team = s.team join fin l on l.season = s.season and l.team = s.opponent where s.won = 1 group by 1")
def rank_violations(spark: SparkSession, d: str) -> DataFrame:
    g = A.played(spark, d)
    r = final_ranks(g)
    s = A.sides(g).where("won = 1").join(r.select("season", "team", F.col("r").alias("w")), ["season", "team"]).join(r.select("season", F.col("team").alias("opponent"), F.col("r").alias("l")), ["season", "opponent"])
    return s.groupBy("season").agg(F.count("*").alias("n"), F.sum((F.col("w") > F.col("l")).cast("int")).alias("violations"))


@query("M34_retro_convergence", f"with {RANKS}, {FINAL} select k.season, k.as_of, round(avg(abs(k.r - f.r)), 6) mean, max(abs(k.r - f.r)) most, count(case when k.r <= 25 and f.r > 25 then 1 end) left_top from ranks k join fin f on f.season = k.season and f.team = k.team group by 1, 2", most="int")
def retro_convergence(spark: SparkSession, d: str) -> DataFrame:
    g = A.played(spark, d)
    j = bucket_ranks(g).join(final_ranks(g).select("season", "team", F.col("r").alias("f")), ["season", "team"])
    gap = F.abs(F.col("r") - F.col("f"))
    return j.groupBy("season", "as_of").agg(F.round(F.avg(gap), 6).alias("mean"), F.max(gap).alias("most"), F.count(F.when((F.col("r") <= 25) & (F.col("f") > 25), 1)).alias("left_top"))


@query("M35_unbeaten", "select season, count(*) teams, cast(sum(w) as bigint) wins from (select season, team, bucket_order b, sum(won) over (partition by season, team order by bucket_order, game_id) w, sum(lost) over (partition by season, team order by bucket_order, game_id) l from sides) where l = 0 and w > 0 group by season")
def unbeaten(spark: SparkSession, d: str) -> DataFrame:
    """Team-games after which a team had won some and lost none."""
    upto = Window.partitionBy("season", "team").orderBy("bucket_order", "game_id")
    s = A.sides(A.played(spark, d)).select("season", F.sum("won").over(upto).alias("w"), F.sum("lost").over(upto).alias("l"))
    return s.where("l = 0 and w > 0").groupBy("season").agg(F.count("*").alias("teams"), F.sum("w").alias("wins"))


@query("M36_head_to_head", f"select season, home_team, away_team, count(*) n, round(avg(delta), 6) delta, round(avg({phi_sql('z')}), 6) p from (select *, delta / {A.SIGMA} z from ({R.PREDICTED})) group by 1, 2, 3")
def head_to_head(spark: SparkSession, d: str) -> DataFrame:
    b = R.base(spark, d).withColumn("z", F.expr(f"delta / {A.SIGMA}"))
    return b.groupBy("season", "home_team", "away_team").agg(F.count("*").alias("n"), F.round(F.avg("delta"), 6).alias("delta"), F.round(F.avg(F.expr(phi_sql("z"))), 6).alias("p"))


@query("M37_bridge_inventory", "select season, count(*) games, count(case when home_class <> away_class then 1 end) bridges, count(case when home_class <> away_class and neutral_site then 1 end) neutral from contests group by season")
def bridge_inventory(spark: SparkSession, d: str) -> DataFrame:
    cross = F.col("home_class") != F.col("away_class")
    return A.contests(spark, d).groupBy("season").agg(F.count("*").alias("games"), F.count(F.when(cross, 1)).alias("bridges"), F.count(F.when(cross & F.col("neutral_site"), 1)).alias("neutral"))


@query("M39_universe_sensitivity", "select u, season, count(*) n, round(avg(home_points - away_points), 6) edge from (select 'all' u, * from contests union all select 'model', * from contests where home_class in ('fbs', 'fcs') or away_class in ('fbs', 'fcs') union all select 'fbs_vs_fbs', * from contests where home_class = 'fbs' and away_class = 'fbs') where completed group by 1, 2")
def universe_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    from tallyforge.operators.buckets import UNIVERSES

    fits = F.filter(F.array(*(F.when(F.expr(w), F.lit(u)) for u, w in UNIVERSES.items())), lambda x: x.isNotNull())
    g = A.contests(spark, d).where("completed").withColumn("u", F.explode(fits))
    return g.groupBy("u", "season").agg(F.count("*").alias("n"), F.round(F.avg(F.col("home_points") - F.col("away_points")), 6).alias("edge"))


@query("M41_chain_accuracy", f"with x as (select *, delta + {A.HOME_EDGE} * site m from ({R.PREDICTED})) select season, count(case when m <> 0 then 1 end) n, round(avg(case when m <> 0 then case when sign(m) = sign(margin) then 1.0 else 0.0 end end), 6) accuracy, round(avg(abs(m - margin)), 6) mae from x group by season")
def chain_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Straight-up accuracy where the prediction isn't a tie."""
    x = R.base(spark, d).withColumn("m", F.col("delta") + A.HOME_EDGE * F.col("site"))
    some = F.col("m") != 0
    return x.groupBy("season").agg(F.count(F.when(some, 1)).alias("n"), F.round(F.avg(F.when(some, F.when(F.sign("m") == F.sign("margin"), 1.0).otherwise(0.0))), 6).alias("accuracy"), F.round(F.avg(F.abs(F.col("m") - F.col("margin"))), 6).alias("mae"))


@query("M42_chain_matrix", SCORED + "select season, cut, count(*) n, round(avg(abs(predicted - actual)), 6) mae from (select *, unnest(['all', case when bucket_order < 5 then 'early' else 'late' end]) cut from sc) group by 1, 2")
def chain_matrix(spark: SparkSession, d: str) -> DataFrame:
    cut = F.explode(F.array(F.lit("all"), F.when(F.col("bucket_order") < 5, "early").otherwise("late")))
    return scored(spark, d).withColumn("cut", cut).groupBy("season", "cut").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("predicted") - F.col("actual"))), 6).alias("mae"))


@query("M43_chain_pooled", SCORED + "select round(sum(e) / sum(n), 6) mae, cast(sum(n) as bigint) n from (select season, sum(abs(predicted - actual)) e, count(*) n from sc group by season)")
def chain_pooled(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d).groupBy("season").agg(F.sum(F.abs(F.col("predicted") - F.col("actual"))).alias("e"), F.count("*").alias("n"))
    return s.agg(F.round(F.sum("e") / F.sum("n"), 6).alias("mae"), F.sum("n").alias("n"))


TOP = f"with {TWO_RANKS}, rk as (select season, team, row_number() over (partition by season order by x desc, team) a, row_number() over (partition by season order by y desc, team) b from two) "


@query("M44_top_rank_metrics", TOP + "select season, count(case when a <= 25 and b <= 25 then 1 end) overlap, round(avg(case when a <= 25 then abs(least(a, 26) - least(b, 26)) end), 6) censored, round(avg(abs(a - b)), 6) mean, round(corr(a, b), 6) spearman from rk group by season")
def top_rank_metrics(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("season")
    t = two_ratings(spark, d).withColumns({"a": F.row_number().over(w.orderBy(F.desc("x"), "team")), "b": F.row_number().over(w.orderBy(F.desc("y"), "team"))})
    cut = F.abs(F.least("a", F.lit(26)) - F.least("b", F.lit(26)))
    return t.groupBy("season").agg(F.count(F.when((F.col("a") <= 25) & (F.col("b") <= 25), 1)).alias("overlap"), F.round(F.avg(F.when(F.col("a") <= 25, cut)), 6).alias("censored"), F.round(F.avg(F.abs(F.col("a") - F.col("b"))), 6).alias("mean"), F.round(F.corr("a", "b"), 6).alias("spearman"))


R.register_ols("M45_early_season", "margin", ["1", "delta"], ["a", "b"], where="bucket_order < 10")
_LOO = Ols("margin", ["1", "delta", "site"])


@query("M46_leave_one_out", f"with g as ({R.PREDICTED}), s as (select season, count(*) n, {_LOO.select} from g group by season), l as (select h.season held, sum(s.n) n, {', '.join(f'sum(s.{k}) {k}' for k in _LOO.sums)} from (select season from s) h join s on s.season <> h.season group by 1) select held, cast(n as bigint) n, {', '.join(f'round({c}, 6) b{i}' for i, c in enumerate(_LOO.coefficients))} from l")
def leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    """A fit without each season: all sums less its own, one pass over the games."""
    s = _LOO.aggregate(R.base(spark, d), ["season"], [F.count("*").alias("n")])
    whole = Window.partitionBy()
    rest = s.select(F.col("season").alias("held"), *((F.sum(k).over(whole) - F.col(k)).alias(k) for k in ("n", *_LOO.sums)))
    return rest.select("held", "n", *(F.round(F.expr(c), 6).alias(f"b{i}") for i, c in enumerate(_LOO.coefficients)))


@query("M47_ordering_cells", TOP + "select season, team, a by_power, b by_share, abs(a - b) gap from rk", by_power="int", by_share="int", gap="int")
def ordering_cells(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("season")
    t = two_ratings(spark, d).withColumns({"by_power": F.row_number().over(w.orderBy(F.desc("x"), "team")), "by_share": F.row_number().over(w.orderBy(F.desc("y"), "team"))})
    return t.select("season", "team", "by_power", "by_share", F.abs(F.col("by_power") - F.col("by_share")).alias("gap"))
