"""Preseason forecast: designs, carried ratings, calendars, grading (J*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions.algebra import Ols
from tallyforge.functions.expr import phi_sql
from tallyforge.operators import metrics as M
from tallyforge.operators import ratings as R
from tallyforge.operators import fitted
from tallyforge.plans.registry import query
from tallyforge.sources import adapters as A

MEMORY, HFA_FACTOR, MEAN_REVERSION = 0.2, 1.5, 0.6
LOCKED_SEASONS = (2001,)

# Offseason attributes of teams, from the supplier and customer tables.
OFF = "off as (select 'T' || lpad(cast(s_suppkey as varchar), 6, '0') team, case when s_suppkey % 7 = 0 then null else s_acctbal end usage, s_nationkey portal, case when s_suppkey % 4 = 0 then null else s_suppkey % 2 end coach_change from supplier)"
DESIGN = f"""{OFF}, st as (select avg(usage) mu, avg(portal) mp, stddev_samp(portal) sp, avg(coach_change) mc from off),
  ds as (select team, coalesce(usage, mu) - mu usage, (portal - mp) / sp portal, coalesce(coach_change, mc) coach, cast(usage is null as int) usage_imputed, cast(coach_change is null as int) coach_imputed from off, st)"""


def offseason(spark: SparkSession, d: str) -> DataFrame:
    s = A.table(spark, d, "supplier")
    return s.select(A.code("s_suppkey").alias("team"), F.when(F.col("s_suppkey") % 7 != 0, F.col("s_acctbal")).alias("usage"), F.col("s_nationkey").alias("portal"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_suppkey") % 2).alias("coach_change"))


def design(off: DataFrame) -> DataFrame:
    """Terms centred by the mean of what is known, portal flow standardised, gaps filled with the mean and flagged."""
    stats = off.agg(F.avg("usage").alias("mu"), F.avg("portal").alias("mp"), F.stddev_samp("portal").alias("sp"), F.avg("coach_change").alias("mc"))
    x = off.join(F.broadcast(stats))
    return x.select(
        "team", (F.coalesce("usage", "mu") - F.col("mu")).alias("usage"), ((F.col("portal") - F.col("mp")) / F.col("sp")).alias("portal"), F.coalesce("coach_change", "mc").alias("coach"),
        F.col("usage").isNull().cast("int").alias("usage_imputed"), F.col("coach_change").isNull().cast("int").alias("coach_imputed"),
    )


@query("J01_projection_design", f"with {DESIGN} select team, round(usage, 6) usage, round(portal, 6) portal, round(coach, 6) coach, usage_imputed, coach_imputed from ds")
def projection_design(spark: SparkSession, d: str) -> DataFrame:
    return design(offseason(spark, d)).select("team", *(F.round(c, 6).alias(c) for c in ("usage", "portal", "coach")), "usage_imputed", "coach_imputed")


TERMS = {"usage": 0.0007, "portal": 1.3, "coach": -1.1}
INTERCEPT = 2.5
PROJECTED = f"{DESIGN}, pj as (select *, usage * 0.0007 c_usage, portal * 1.3 c_portal, coach * -1.1 c_coach, {INTERCEPT} + usage * 0.0007 + portal * 1.3 + coach * -1.1 projected from ds)"


def projected(spark: SparkSession, d: str) -> DataFrame:
    x = design(offseason(spark, d))
    x = x.withColumns({f"c_{k}": F.col(k) * F.lit(v) for k, v in TERMS.items()})
    return x.withColumn("projected", F.lit(INTERCEPT) + F.col("c_usage") + F.col("c_portal") + F.col("c_coach"))


@query("J02_predict", f"with {PROJECTED} select team, round(projected, 6) projected from pj")
def predict(spark: SparkSession, d: str) -> DataFrame:
    return projected(spark, d).select("team", F.round("projected", 6).alias("projected"))


@query("J03_contributions", f"with {PROJECTED} select team, round(c_usage, 6) c_usage, round(c_portal, 6) c_portal, round(c_coach, 6) c_coach from pj")
def contributions(spark: SparkSession, d: str) -> DataFrame:
    return projected(spark, d).select("team", *(F.round(f"c_{k}", 6).alias(f"c_{k}") for k in TERMS))


@query("J04_conditional_rank", f"with {PROJECTED} select team, case when usage_imputed = 0 then cast(sum(1 - usage_imputed) over (order by round(projected, 9) desc, team) as bigint) end rank from pj")
def conditional_rank(spark: SparkSession, d: str) -> DataFrame:
    """Only teams whose usage is known are ranked, among the others' order."""
    order = Window.orderBy(F.desc(F.round("projected", 9)), "team")
    p = projected(spark, d)
    return p.select("team", F.when(F.col("usage_imputed") == 0, F.sum(1 - F.col("usage_imputed")).over(order).cast("long")).alias("rank"))


BLEND = f"""bl as (select coalesce(a.season, b.season + 1) season, coalesce(a.team, b.team) team, case when a.rating is null then b.rating when b.rating is null then a.rating else {1 - MEMORY} * a.rating + {MEMORY} * b.rating end carried
  from power a full join power b on b.season + 1 = a.season and b.team = a.team)"""


def memory_blend(p: DataFrame, memory: float = MEMORY) -> DataFrame:
    """This season's rating with a part of the last one's; either alone where the other is missing."""
    older = p.select((F.col("season") + 1).cast("int").alias("season"), "team", F.col("rating").alias("older"))
    both = p.join(older, ["season", "team"], "full")
    return both.select("season", "team", F.when(F.col("rating").isNull(), F.col("older")).when(F.col("older").isNull(), F.col("rating")).otherwise((1 - memory) * F.col("rating") + memory * F.col("older")).alias("carried"))


@query("J05_memory_blend", f"with {BLEND} select season, team, round(carried, 6) carried from bl")
def memory_blend_rows(spark: SparkSession, d: str) -> DataFrame:
    return memory_blend(fitted.power(A.played(spark, d))).withColumn("carried", F.round("carried", 6))


GAP, BUMP = -6.0, 2.0
ADJUST = f"case team_class when 'fbs' then carried when 'fcs' then least(carried + {GAP} + {BUMP}, 10.0) else carried + {GAP} end"
ADJUST_LABEL = "case team_class when 'fbs' then 'as_is' when 'fcs' then 'promoted' else 'gap' end"
ALL_POWER = "apw as (select season, team, min(team_class) team_class, any_value(round(f.rating, 6)) carried from fit_everyone f join sides_of_all s using (season, team) where completed group by 1, 2)"


def all_power(spark: SparkSession, d: str) -> DataFrame:
    """(season, team, team_class, carried): Power of the teams of all classes, from all completed games."""
    g = A.contests(spark, d).where("completed")
    classes = A.sides(g).groupBy("season", "team").agg(F.min("team_class").alias("team_class"))
    return classes.join(fitted.power(g), ["season", "team"]).select("season", "team", "team_class", F.col("rating").alias("carried"))


@query("J06_carried_ratings", f"with {ALL_POWER} select season + 1 season, team, round({ADJUST}, 6) rating from apw")
def carried_ratings(spark: SparkSession, d: str) -> DataFrame:
    return all_power(spark, d).select((F.col("season") + 1).alias("season"), "team", F.round(F.expr(ADJUST), 6).alias("rating"))


@query("J08_adjusted", f"with {ALL_POWER} select season, team, {ADJUST_LABEL} how, round({ADJUST} - carried, 6) change from apw")
def adjusted(spark: SparkSession, d: str) -> DataFrame:
    """As they are, promoted with the gap and a bump under a ceiling, or with the gap."""
    return all_power(spark, d).select("season", "team", F.expr(ADJUST_LABEL).alias("how"), F.round(F.expr(f"{ADJUST} - carried"), 6).alias("change"))


@query("J07_promotion_frame", f"with {ALL_POWER}, n as (select distinct season, team from sides anti join (select season + 1 season, team from sides where bucket_order < 10) p using (season, team)) select s.season, s.team, count(*) games, round(avg(s.margin), 6) margin, round(avg(coalesce(o.carried, 0)), 4) faced from sides s semi join n using (season, team) left join apw o on o.season = s.season - 1 and o.team = s.opponent group by 1, 2")
def promotion_frame(spark: SparkSession, d: str) -> DataFrame:
    """Teams that the last season's first weeks lacked, against opponents rated by the last season."""
    s = A.sides(A.played(spark, d))
    last = s.where("bucket_order < 10").select((F.col("season") + 1).cast("int").alias("season"), "team").distinct()
    new = s.select("season", "team").distinct().join(last, ["season", "team"], "left_anti")
    prior = all_power(spark, d).select((F.col("season") + 1).cast("int").alias("season"), F.col("team").alias("opponent"), "carried")
    j = s.join(new, ["season", "team"], "left_semi").join(prior, ["season", "opponent"], "left")
    return j.groupBy("season", "team").agg(F.count("*").alias("games"), F.round(F.avg("margin"), 6).alias("margin"), F.round(F.avg(F.coalesce("carried", F.lit(0.0))), 4).alias("faced"))


@query("J09_bridge_frame", f"select game_id, bridge, round(delta, 6) delta, margin from ({R.CROSS})")
def bridge_frame(spark: SparkSession, d: str) -> DataFrame:
    g = A.contests(spark, d).where("completed")
    return R.predicted(g, R.season_power(spark, d)).select("game_id", F.expr(R.BRIDGE).alias("bridge"), F.round("delta", 6).alias("delta"), "margin")


@query("J10_ceiling_holder", f"with {ALL_POWER} select season, team, carried ceiling from (select *, row_number() over (partition by season order by carried desc, team) r from apw where team_class <> 'fbs') where r = 1")
def ceiling_holder(spark: SparkSession, d: str) -> DataFrame:
    p = all_power(spark, d).where("team_class <> 'fbs'").withColumn("r", F.row_number().over(Window.partitionBy("season").orderBy(F.desc("carried"), "team")))
    return p.where("r = 1").select("season", "team", F.col("carried").alias("ceiling"))


RECEIPTS = f"rc as (select s.season, s.game_id, s.team, s.opponent, s.margin, round(coalesce(a.carried, 0) - coalesce(b.carried, 0), 6) expected from sides_of_all s left join apw a on a.season = s.season and a.team = s.team left join apw b on b.season = s.season and b.team = s.opponent where s.completed and s.team_class <> 'fbs' and s.opponent_class = 'fbs')"


def receipt_rows(spark: SparkSession, d: str) -> DataFrame:
    p = all_power(spark, d).select("season", "team", "carried")
    s = A.sides(A.contests(spark, d).where("completed")).where("team_class <> 'fbs' and opponent_class = 'fbs'")
    j = s.join(p, ["season", "team"], "left").join(p.select("season", F.col("team").alias("opponent"), F.col("carried").alias("other")), ["season", "opponent"], "left")
    return j.select("season", "game_id", "team", "opponent", "margin", F.round(F.coalesce("carried", F.lit(0.0)) - F.coalesce("other", F.lit(0.0)), 6).alias("expected"))


@query("J11_receipts", f"with {ALL_POWER}, {RECEIPTS} select game_id, team, opponent, expected, round(margin - expected, 6) miss from rc")
def receipts(spark: SparkSession, d: str) -> DataFrame:
    return receipt_rows(spark, d).select("game_id", "team", "opponent", "expected", F.round(F.col("margin") - F.col("expected"), 6).alias("miss"))


@query("J12_season_receipts", f"with {ALL_POWER}, {RECEIPTS} select season, team, count(*) n, round(max(margin - expected), 6) best, round(min(margin - expected), 6) worst from rc group by 1, 2")
def season_receipts(spark: SparkSession, d: str) -> DataFrame:
    miss = F.col("margin") - F.col("expected")
    return receipt_rows(spark, d).groupBy("season", "team").agg(F.count("*").alias("n"), F.round(F.max(miss), 6).alias("best"), F.round(F.min(miss), 6).alias("worst"))


@query("J13_projection_sigma", f"select season, round(sqrt({A.SIGMA * A.SIGMA!r} + 2 * var_samp(rating)), 6) sigma from power group by season")
def projection_sigma(spark: SparkSession, d: str) -> DataFrame:
    return fitted.power(A.played(spark, d)).groupBy("season").agg(F.round(F.sqrt(F.lit(A.SIGMA * A.SIGMA) + 2 * F.var_samp("rating")), 6).alias("sigma"))


CALENDAR = f"cal as (select s.season, s.team, s.game_id, s.opponent, s.site, coalesce(t.rating, 0) own, coalesce(o.rating, 0) opp, o.rating is not null rated from sides s left join power t on t.season = s.season - 1 and t.team = s.team left join power o on o.season = s.season - 1 and o.team = s.opponent)"
CHANCE = f"(own - opp + {HFA_FACTOR * A.HOME_EDGE} * site) / {A.SIGMA}"


def calendar(spark: SparkSession, d: str) -> DataFrame:
    """Every side's games with both ratings of the season before."""
    g = A.played(spark, d)
    p = fitted.power(g).select((F.col("season") + 1).cast("int").alias("season"), "team", "rating")
    s = A.sides(g).join(p.withColumnRenamed("rating", "own"), ["season", "team"], "left").join(p.select("season", F.col("team").alias("opponent"), F.col("rating").alias("opp")), ["season", "opponent"], "left")
    zero = F.lit(0.0)
    s = s.withColumns({"rated": F.col("opp").isNotNull(), "own": F.coalesce("own", zero), "opp": F.coalesce("opp", zero)})
    return s.withColumn("z", F.expr(CHANCE)).withColumn("p", F.expr(phi_sql("z")))


@query("J14_expected_wins", f"with {CALENDAR} select season, team, round(sum({phi_sql('z')}), 6) wins, count(*) games, bool_and(rated) all_rated from (select *, {CHANCE} z from cal) group by 1, 2")
def expected_wins(spark: SparkSession, d: str) -> DataFrame:
    return calendar(spark, d).groupBy("season", "team").agg(F.round(F.sum("p"), 6).alias("wins"), F.count("*").alias("games"), F.bool_and("rated").alias("all_rated"))


@query("J15_rating_resolver", f"with {PROJECTED}, c as (select avg(rating) m from power where season = 2000) select p.team, round(coalesce(j.projected, 2.5 + {MEAN_REVERSION} * (p.rating - m)), 6) rating from power p cross join c left join (select * from pj where usage_imputed = 0) j using (team) where p.season = 2000")
def rating_resolver(spark: SparkSession, d: str, season: int = 2000) -> DataFrame:
    """Projected where it can be, else the last rating drawn to its centre."""
    p = fitted.power(A.played(spark, d)).where(F.col("season") == season)
    c = p.agg(F.avg("rating").alias("m"))
    j = projected(spark, d).where("usage_imputed = 0").select("team", "projected")
    return p.join(F.broadcast(c)).join(j, "team", "left").select("team", F.round(F.coalesce("projected", INTERCEPT + MEAN_REVERSION * (F.col("rating") - F.col("m"))), 6).alias("rating"))


@query("J16_schedule_strength", f"with {CALENDAR}, t as (select season, team, count(*) games, round(sum(opp), 6) / count(*) strength, count(case when site = 1 then 1 end) home from cal group by 1, 2) select season, team, games, strength, home, case when games >= 10 then cast(row_number() over (partition by season, games >= 10 order by strength desc, team) as int) end rank from t")
def schedule_strength(spark: SparkSession, d: str, least: int = 10) -> DataFrame:
    t = calendar(spark, d).groupBy("season", "team").agg(F.count("*").alias("games"), (F.round(F.sum("opp"), 6) / F.count("*")).alias("strength"), F.count(F.when(F.col("site") == 1, 1)).alias("home"))
    w = Window.partitionBy("season", F.col("games") >= least).orderBy(F.desc("strength"), "team")
    return t.withColumn("rank", F.when(F.col("games") >= least, F.row_number().over(w)))


@query("J17_wins_against_calendar", f"with {CALENDAR}, md as (select season, arg_min(team, (strength, team)) team from (select season, team, avg(opp) strength from cal group by 1, 2) group by season) select p.season, p.team, round(sum({phi_sql('z')}), 5) wins from (select p.season, p.team, (p.rating - c.opp + 0.5 * c.site) / {A.SIGMA} z from power p join md on md.season = p.season join cal c on c.season = md.season and c.team = md.team) p group by 1, 2")
def wins_against_calendar(spark: SparkSession, d: str) -> DataFrame:
    """What each team would win on the easiest team's calendar, which is one short list a season."""
    c = calendar(spark, d)
    g = A.played(spark, d)
    easiest = c.groupBy("season", "team").agg(F.avg("opp").alias("strength")).groupBy("season").agg(F.min(F.struct("strength", "team")).alias("x")).select("season", F.col("x.team").alias("team"))
    games = c.join(easiest, ["season", "team"], "left_semi").select("season", "opp", "site")
    j = fitted.power(g).join(F.broadcast(games), "season").withColumn("z", F.expr(f"(rating - opp + 0.5D * site) / {A.SIGMA}"))
    return j.groupBy("season", "team").agg(F.round(F.sum(F.expr(phi_sql("z"))), 5).alias("wins"))


@query("J18_inversion", f"with {CALENDAR}, w as (select season, team, round(sum({phi_sql('z')}), 6) wins from (select *, {CHANCE} z from cal) group by 1, 2), r as (select p.season + 1 season, p.team, row_number() over (partition by p.season order by p.rating desc, p.team) r from power p) select season, max(case when r = 1 then wins end) first_wins, max(wins) most_wins, coalesce(max(case when r = 1 then wins end) < max(wins), false) inverted from w join r using (season, team) where r <= 25 group by season")
def inversion(spark: SparkSession, d: str) -> DataFrame:
    """Whether the first ranked isn't the one with most projected wins."""
    w = calendar(spark, d).groupBy("season", "team").agg(F.round(F.sum("p"), 6).alias("wins"))
    r = M.final_ranks(A.played(spark, d)).select((F.col("season") + 1).cast("int").alias("season"), "team", "r")
    first = F.max(F.when(F.col("r") == 1, F.col("wins")))
    return w.join(r, ["season", "team"]).where("r <= 25").groupBy("season").agg(first.alias("first_wins"), F.max("wins").alias("most_wins"), F.coalesce(first < F.max("wins"), F.lit(False)).alias("inverted"))


GRADE = f"with {M.RANKS}, {M.FINAL}, gd as (select coalesce(k.season, f.season) season, coalesce(k.team, f.team) team, k.r live_rank, f.r hindsight_rank, f.r - k.r delta from (select * from ranks where as_of = 10) k full join fin f on f.season = k.season and f.team = k.team) "


def graded(spark: SparkSession, d: str, bucket: int = 10) -> DataFrame:
    g = A.played(spark, d)
    live = M.bucket_ranks(g).where(F.col("as_of") == bucket).select("season", "team", F.col("r").alias("live_rank"))
    return live.join(M.final_ranks(g).select("season", "team", F.col("r").alias("hindsight_rank")), ["season", "team"], "full").withColumn("delta", F.col("hindsight_rank") - F.col("live_rank"))


@query("J19_grade_week", GRADE + "select * from gd", live_rank="int", hindsight_rank="int", delta="int")
def grade_week(spark: SparkSession, d: str) -> DataFrame:
    return graded(spark, d).select("season", "team", "live_rank", "hindsight_rank", "delta")


@query("J20_suspect_term", f"with {PROJECTED} select team, case when greatest(abs(c_usage), abs(c_portal), abs(c_coach)) = abs(c_usage) then 'usage' when greatest(abs(c_usage), abs(c_portal), abs(c_coach)) = abs(c_portal) then 'portal' else 'coach' end term from pj")
def suspect_term(spark: SparkSession, d: str) -> DataFrame:
    """The term with the largest contribution, the first of equals."""
    most = F.greatest(*(F.abs(f"c_{k}") for k in TERMS))
    pick = F.coalesce(*(F.when(F.abs(f"c_{k}") == most, F.lit(k)) for k in TERMS))
    return projected(spark, d).select("team", pick.alias("term"))


@query("J21_grade_season", f"with {M.RANKS}, {M.FINAL} select k.season, k.as_of, count(*) n, round(avg(f.r - k.r), 6) bias, round(stddev_samp(f.r - k.r), 6) spread from ranks k join fin f on f.season = k.season and f.team = k.team group by 1, 2")
def grade_season(spark: SparkSession, d: str) -> DataFrame:
    g = A.played(spark, d)
    j = M.bucket_ranks(g).join(M.final_ranks(g).select("season", "team", F.col("r").alias("f")), ["season", "team"])
    gap = F.col("f") - F.col("r")
    return j.groupBy("season", "as_of").agg(F.count("*").alias("n"), F.round(F.avg(gap), 6).alias("bias"), F.round(F.stddev_samp(gap), 6).alias("spread"))


@query("J22_story_lines", GRADE + "select season, team, delta from (select *, row_number() over (partition by season order by abs(delta) desc, team) r from gd where delta is not null) where r <= 3", delta="int")
def story_lines(spark: SparkSession, d: str) -> DataFrame:
    g = graded(spark, d).where("delta is not null").withColumn("r", F.row_number().over(Window.partitionBy("season").orderBy(F.desc(F.abs("delta")), "team")))
    return g.where("r <= 3").select("season", "team", "delta")


_CARRY = Ols("y", ["1", "x"])
TRANSITIONS = "tr as (select b.season, b.team, a.rating x, b.rating y from power a join power b on b.season = a.season + 1 and b.team = a.team)"


def transitions(p: DataFrame) -> DataFrame:
    before = p.select((F.col("season") + 1).cast("int").alias("season"), "team", F.col("rating").alias("x"))
    return before.join(p.withColumnRenamed("rating", "y"), ["season", "team"])


@query("J23_walk_forward_recipe", f"with {TRANSITIONS}, s as (select season, count(*) n, {_CARRY.select} from tr group by season), w as (select t.season, sum(s.n) n, {', '.join(f'sum(s.{k}) {k}' for k in _CARRY.sums)} from (select season from s) t join s on s.season < t.season group by 1) select season, cast(n as bigint) n, {', '.join(f'round({c}, 6) b{i}' for i, c in enumerate(_CARRY.coefficients))} from w")
def walk_forward_recipe(spark: SparkSession, d: str) -> DataFrame:
    """For each season the carryover fitted on the transitions before it only."""
    s = _CARRY.aggregate(transitions(fitted.power(A.played(spark, d))), ["season"], [F.count("*").alias("n")])
    past = Window.orderBy("season").rowsBetween(Window.unboundedPreceding, -1)
    w = s.select("season", *(F.sum(k).over(past).alias(k) for k in ("n", *_CARRY.sums))).where("n is not null")
    return w.select("season", "n", *(F.round(F.expr(c), 6).alias(f"b{i}") for i, c in enumerate(_CARRY.coefficients)))


@query("J24_rated_universe", f"with {PROJECTED} select team, round(coalesce(case when usage_imputed = 0 then projected end, {INTERCEPT} + {MEAN_REVERSION} * (projected - {INTERCEPT})), 6) rating from pj")
def rated_universe(spark: SparkSession, d: str) -> DataFrame:
    known = F.when(F.col("usage_imputed") == 0, F.col("projected"))
    return projected(spark, d).select("team", F.round(F.coalesce(known, INTERCEPT + MEAN_REVERSION * (F.col("projected") - INTERCEPT)), 6).alias("rating"))


BUILDERS = {"carryover": "x", "reverted": f"{MEAN_REVERSION} * x", "blended": "0.5 * x + 0.5 * 2.5"}


@query("J25_builders", f"with {TRANSITIONS} select 'carryover' builder, season, round(avg(abs(x - y)), 6) mae from tr group by season union all select 'reverted', season, round(avg(abs({MEAN_REVERSION} * x - y)), 6) from tr group by season union all select 'blended', season, round(avg(abs(0.5 * x + 1.25 - y)), 6) from tr group by season")
def builders(spark: SparkSession, d: str) -> DataFrame:
    t = transitions(fitted.power(A.played(spark, d)))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("builder"), F.expr(v).alias("m")) for k, v in BUILDERS.items())))
    return t.select("season", "y", each.alias("b")).groupBy(F.col("b.builder").alias("builder"), "season").agg(F.round(F.avg(F.abs(F.col("b.m") - F.col("y"))), 6).alias("mae"))


@query("J26_transition_scores", f"with {TRANSITIONS}, s as (select count(*) n, {_CARRY.select} from tr) select tr.season, count(*) n, round(sqrt(avg(pow({_CARRY.coefficients[0]} + {_CARRY.coefficients[1]} * x - y, 2))), 6) rmse from tr, s group by tr.season")
def transition_scores(spark: SparkSession, d: str) -> DataFrame:
    t = transitions(fitted.power(A.played(spark, d)))
    s = _CARRY.aggregate(t).select(*(F.expr(c).alias(f"b{i}") for i, c in enumerate(_CARRY.coefficients)))
    return t.join(F.broadcast(s)).groupBy("season").agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(F.pow(F.expr("b0 + b1 * x - y"), 2))), 6).alias("rmse"))


@query("J27_system_ranks", M.TOP + "select season, team, cast(a as int) by_power, cast(b as int) by_share from rk")
def system_ranks(spark: SparkSession, d: str) -> DataFrame:
    return M.ordering_cells(spark, d).select("season", "team", "by_power", "by_share")


@query("J28_settled_poll", f"with {M.FINAL} select season, team, cast(r as int) rank from fin")
def settled_poll(spark: SparkSession, d: str) -> DataFrame:
    return M.final_ranks(A.played(spark, d)).select("season", "team", F.col("r").alias("rank"))


def holdout_guard(season: int, locked: tuple[int, ...] = LOCKED_SEASONS) -> int:
    if season in locked:
        raise ValueError(f"season {season} is held out")
    return season


@query("J30_publish_document", f"with {M.FINAL} select season, team, '#' || r || ' ' || team as line from fin where r <= 10")
def publish_document(spark: SparkSession, d: str) -> DataFrame:
    f = M.final_ranks(A.played(spark, d)).where("r <= 10")
    return f.select("season", "team", F.concat(F.lit("#"), F.col("r").cast("string"), F.lit(" "), "team").alias("line"))
