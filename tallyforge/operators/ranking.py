"""Polls, records, the retroactive grid R(N, K) and its surfaces (K*)."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge import ship
from tallyforge.operators import fitted
from tallyforge.operators import ratings as R
from tallyforge.operators import resume as Q
from tallyforge.plans.registry import query
from tallyforge.sources import adapters as A
from tallyforge.sources.stored import stored

ORDERINGS = {
    "schedule_odds": ("tail", "mid", "team"),
    "resume": ("-resume", "-wins", "team"),
    "power": ("-rating", "team"),
}


def order_columns(ordering: str) -> list:
    """Sort columns of a headline ordering, ending in the team; an unknown one is an error."""
    if ordering not in ORDERINGS:
        raise ValueError(f"unknown ordering {ordering!r}; there are {sorted(ORDERINGS)}")
    return [F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in ORDERINGS[ordering]]


ODDS_POWER = Q.SEASON_ODDS.rstrip() + ", res0 as (select *, round(tail, 12) t12, round(mid, 12) m12 from odds join season_power using (season, team)) "


def season_rows(spark: SparkSession, d: str) -> DataFrame:
    g, p, s = Q.inputs(spark, d)
    t = Q.odds(Q.with_probability(s, p), ["season", "team"]).join(p, ["season", "team"])
    return t.withColumns({"tail": F.round("tail", 12), "mid": F.round("mid", 12)})


@query("K01_headline_orderings", ODDS_POWER + "select season, team, cast(row_number() over (partition by season order by t12, m12, team) as int) by_odds, cast(row_number() over (partition by season order by rating desc, team) as int) by_power from res0")
def headline_orderings(spark: SparkSession, d: str) -> DataFrame:
    t, w = season_rows(spark, d), Window.partitionBy("season")
    return t.select("season", "team", F.row_number().over(w.orderBy(*order_columns("schedule_odds"))).alias("by_odds"), F.row_number().over(w.orderBy(*order_columns("power"))).alias("by_power"))


@query("K03_team_set", "select distinct season, team from sides_of_all where team_class = 'fbs'")
def team_set(spark: SparkSession, d: str) -> DataFrame:
    return A.sides(A.contests(spark, d)).where("team_class = 'fbs'").select("season", "team").distinct()


@query("K04_team_classes", "select season, team, min(team_class) team_class from sides_of_all group by season, team")
def team_classes(spark: SparkSession, d: str) -> DataFrame:
    return A.sides(A.contests(spark, d)).groupBy("season", "team").agg(F.min("team_class").alias("team_class"))


@query("K05_records", "select season, team, cast(sum(won) as bigint) wins, cast(sum(lost) as bigint) losses from sides_of_all group by season, team")
def records(spark: SparkSession, d: str) -> DataFrame:
    """Ties credit neither side."""
    return A.sides(A.contests(spark, d)).groupBy("season", "team").agg(F.sum("won").alias("wins"), F.sum("lost").alias("losses"))


@query("K06_ratings_table", "select season, team, rating, cast(sum(won) as bigint) wins, cast(sum(lost) as bigint) losses, cast(row_number() over (partition by season order by rating desc, team) as int) place from sides join season_power using (season, team) group by season, team, rating")
def ratings_table(spark: SparkSession, d: str) -> DataFrame:
    g = A.played(spark, d)
    r = A.sides(g).groupBy("season", "team").agg(F.sum("won").alias("wins"), F.sum("lost").alias("losses"))
    return R.season_power(spark, d, g).join(r, ["season", "team"]).withColumn("place", F.row_number().over(Window.partitionBy("season").orderBy(F.desc("rating"), "team")))


@query("K07_poll_table", "select season, team, cast(row_number() over (partition by season order by rating desc, team) as int) rank from season_power where team in (select team from sides_of_all where team_class = 'fbs')")
def poll_table(spark: SparkSession, d: str) -> DataFrame:
    g = A.contests(spark, d)
    wanted = A.sides(g).where("team_class = 'fbs'").select("team").distinct()
    p = R.season_power(spark, d).join(wanted, "team", "left_semi")
    return p.select("season", "team", F.row_number().over(Window.partitionBy("season").orderBy(F.desc("rating"), "team")).alias("rank"))


@query("K08_attach_intervals", "select season, team, rating, case when season % 2 = 0 then cast(floor(rating) as int) end lo from power")
def attach_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Intervals where they were drawn; null integers elsewhere."""
    p = fitted.power(A.played(spark, d))
    lo = p.where("season % 2 = 0").select("season", "team", F.floor("rating").cast("int").alias("lo"))
    return p.join(lo, ["season", "team"], "left").select("season", "team", "rating", "lo")


GRID_VIEWS: dict[str, str] = {
    "grid_q": f"select season, as_of k, coalesce(max(case when r = {Q.REFERENCE_RANK} then rating end), min(rating)) q_ref from (select *, row_number() over (partition by season, as_of order by rating desc, team) r from power_as_of) group by 1, 2",
    "grid_games": f"""select season, k, team, bucket_order b, game_id, {Q.WIN_P} p, won, lost from (select s.*, q.k, (q.q_ref - coalesce(o.rating, 0) + {Q.EDGE} * site) / {Q.SIGMA} z
      from sides s join grid_q q on q.season = s.season and s.bucket_order <= q.k left join power_as_of o on o.season = s.season and o.as_of = q.k and o.team = s.opponent)""",
    "grid_steps": "select season, k, team, b, p, row_number() over w step_no, lead(b) over w next, (sum(won) over w)::bigint wins, (sum(lost) over w)::bigint losses, sum(p) over w expected from grid_games window w as (partition by season, k, team order by b, game_id)",
    "grid_conv": """select distinct season, k, team, 0::bigint step_no, [1.0::double] acc from grid_steps
      union all select season, k, team, o.step_no, list_transform(range(1, len(acc) + 2), lambda i: coalesce(acc[i], 0) * (1 - p) + case when i > 1 then coalesce(acc[i - 1], 0) else 0 end * p) from grid_conv c join grid_steps o using (season, k, team) where o.step_no = c.step_no + 1""",
    "grid_odds": "select season, e.as_of e, k, team, cast(wins as int) wins, cast(losses as int) losses, expected, list_sum(acc[wins + 1:]) tail, list_sum(acc[wins + 1:]) - 0.5 * acc[wins + 1] mid from grid_conv join grid_steps using (season, k, team, step_no) join fb_keys e using (season) where (next is null or next <> b) and e.as_of >= b and e.as_of <= k and (next is null or e.as_of < next)",
    "retro_grid": """select season, e, k, team, wins, losses, round(tail, 6) tail, round(expected, 6) expected, cast(row_number() over (partition by season, e, k order by round(tail, 12), round(mid, 12), team) as int) rank, e = k is_live, k = last is_hindsight
      from grid_odds join (select season, max(as_of) last from fb_keys group by season) using (season)""",
}
# The same over the blend: the views' names begin with l3_.
GRID_VIEWS |= {f"l3_{k}": re.sub(r"\b(grid_\w+|retro_grid)\b", r"l3_\1", v).replace("power_as_of", "blend_as_of") for k, v in GRID_VIEWS.items()}
A.VIEWS.update(GRID_VIEWS)
A.MATERIALIZED.update(GRID_VIEWS)


#: Tasks that the teams of one season and K are dealt to.
TEAM_BLOCKS = 4
FOLD_SCHEMA = "season int, k int, team string, bucket_order int, next int, wins int, losses int, expected double, tail double, mid double"


def fold_records(pdf: pd.DataFrame) -> pd.DataFrame:
    """FOLD_SCHEMA: the odds of each team's record after each of its buckets, its distribution of wins growing game by game.

    All teams of the frame grow side by side, one convolution a game; what is read off are the last games of buckets.
    """
    pdf = pdf.sort_values(["team", "bucket_order", "game_id"], ignore_index=True)
    team, place = pdf["team"].factorize()[0], pdf.groupby("team", sort=False).cumcount().to_numpy()
    n_teams, most = int(team.max()) + 1, int(place.max()) + 1
    chance = np.full((n_teams, most), np.nan)
    chance[team, place] = pdf["p"].to_numpy()
    wins = np.zeros((n_teams, most), int)
    wins[team, place] = pdf["wins"].to_numpy()
    pmf = np.zeros((n_teams, most + 1))
    pmf[:, 0] = 1.0
    tail, mid = np.zeros((n_teams, most)), np.zeros((n_teams, most))
    for i in range(most):
        on = ~np.isnan(chance[:, i])
        p, old = chance[on, i, None], pmf[on, : i + 2]
        new = old * (1 - p)
        new[:, 1:] += old[:, :-1] * p
        pmf[on, : i + 2] = new
        w = wins[on, i]
        above = np.cumsum(new[:, ::-1], 1)[:, ::-1]
        rows = np.arange(len(w))
        tail[on, i] = above[rows, w]
        mid[on, i] = above[rows, w] - 0.5 * new[rows, w]
    out = pdf[["season", "k", "team", "bucket_order", "next", "wins", "losses"]].copy()
    out["expected"] = pdf.groupby("team", sort=False)["p"].cumsum()
    out["tail"], out["mid"] = tail[team, place], mid[team, place]
    return out[pdf["next"].isna() | (pdf["next"] != pdf["bucket_order"])]


def grid(games: DataFrame, power: DataFrame | None = None) -> DataFrame:
    """R(N, K) of every season, by `power` as of every bucket (fitted.power_by_bucket; None: results alone): the record through bucket N against Power through bucket K, for all N <= K, in one plan.

    Games meet each K that they lie before; the odds of a team under one K are folded once and read off after each bucket, so a K costs one
    convolution a game however many N it has.  A team stands in a cell from its first game on.
    """
    power = stored(fitted.power_by_bucket(games) if power is None else power, "power").withColumnRenamed("as_of", "k")
    q = Window.partitionBy("season", "k").orderBy(F.desc("rating"), "team")
    ref = power.withColumn("r", F.row_number().over(q)).groupBy("season", "k").agg(F.coalesce(F.max(F.when(F.col("r") == Q.REFERENCE_RANK, F.col("rating"))), F.min("rating")).alias("q_ref"))
    buckets = F.broadcast(games.groupBy("season").agg(F.array_sort(F.collect_set("bucket_order")).alias("all")))  # a short list a season
    so_far = Window.partitionBy("season", "team").orderBy("bucket_order", "game_id")
    sides = A.sides(games).select("season", "bucket_order", "game_id", "team", "opponent", "site", "won", "lost")
    sides = sides.withColumns({"wins": F.sum("won").over(so_far).cast("int"), "losses": F.sum("lost").over(so_far).cast("int"), "next": F.lead("bucket_order").over(so_far)}).drop("won", "lost")
    rows = sides.join(buckets, "season").withColumn("k", F.explode(F.expr("filter(all, k -> k >= bucket_order)"))).drop("all").join(F.broadcast(ref), ["season", "k"])
    rows = rows.join(power.select("season", "k", F.col("team").alias("opponent"), F.col("rating").alias("opp")), ["season", "k", "opponent"], "left")
    rows = rows.withColumn("z", (F.col("q_ref") - F.coalesce("opp", F.lit(0.0)) + Q.EDGE * F.col("site")) / Q.SIGMA).withColumn("p", F.expr(Q.WIN_P))
    dealt = rows.select("season", "k", "team", "bucket_order", "game_id", "p", "wins", "losses", "next", F.pmod(F.hash("team"), F.lit(TEAM_BLOCKS)).alias("part"))
    ship(games.sparkSession)
    at = dealt.groupBy("season", "k", "part").applyInPandas(fold_records, FOLD_SCHEMA).join(buckets, "season")
    t = at.withColumn("e", F.explode(F.expr("filter(all, e -> e >= bucket_order and e <= k and (next is null or e < next))")))
    return t.select(
        "season", "e", "k", "team", "wins", "losses", F.round("tail", 6).alias("tail"), F.round("expected", 6).alias("expected"), Q.ranked(t, ["season", "e", "k"]).alias("rank"),
        (F.col("e") == F.col("k")).alias("is_live"), (F.col("k") == F.array_max("all")).alias("is_hindsight"),
    )


def cell(games: DataFrame, e: int, k: int) -> DataFrame:
    """One cell; the Power's poll can't come before the record's."""
    if k < e:
        raise ValueError("R(N, K) needs K >= N")
    return grid(games).where((F.col("e") == e) & (F.col("k") == k))


def register(name: str, sql: str, build) -> None:
    @query(name, sql)
    def run(spark: SparkSession, d: str) -> DataFrame:
        return build(grid(A.played(spark, d)))


register("K10_grid_cells", "select season, e, k, count(*) teams, min(tail) least, max(tail) most from retro_grid group by 1, 2, 3", lambda g: g.groupBy("season", "e", "k").agg(F.count("*").alias("teams"), F.min("tail").alias("least"), F.max("tail").alias("most")))
register("K11_cell_frame", "select season, e, k, team, rank, is_live, is_hindsight from retro_grid where is_live or is_hindsight", lambda g: g.where("is_live or is_hindsight").select("season", "e", "k", "team", "rank", "is_live", "is_hindsight"))
register("K13_live_surface", "select season, e, team, wins, losses, tail, rank from retro_grid where is_live", lambda g: g.where("is_live").select("season", "e", "team", "wins", "losses", "tail", "rank"))
register("K14_hindsight_surface", "select season, e, team, wins, losses, tail, rank from retro_grid where is_hindsight", lambda g: g.where("is_hindsight").select("season", "e", "team", "wins", "losses", "tail", "rank"))
register("K15_triangle", "select * from retro_grid", lambda g: g)
register("K16_surface_split", "select season, is_live, is_hindsight, count(*) n from retro_grid group by 1, 2, 3", lambda g: g.groupBy("season", "is_live", "is_hindsight").agg(F.count("*").alias("n")))

MOVES = "(select *, hindsight_rank - live_rank delta from (select season, e, team, max(case when is_live then rank end) live_rank, max(case when is_hindsight then rank end) hindsight_rank from retro_grid where is_live or is_hindsight group by all))"


def moves(g: DataFrame) -> DataFrame:
    """Live against hindsight rank of each team and poll, from one pass over the cells."""
    both = g.where("is_live or is_hindsight").groupBy("season", "e", "team").agg(F.max(F.when(F.col("is_live"), F.col("rank"))).alias("live_rank"), F.max(F.when(F.col("is_hindsight"), F.col("rank"))).alias("hindsight_rank"))
    return both.withColumn("delta", F.col("hindsight_rank") - F.col("live_rank"))


register("K09_live_hindsight_join", f"select * from {MOVES}", lambda g: moves(g).select("season", "e", "team", "delta", "live_rank", "hindsight_rank"))
register("K17_movers", f"select season, e, team, delta from {MOVES} where abs(delta) >= 5", lambda g: moves(g).where("abs(delta) >= 5").select("season", "e", "team", "delta"))
register("K18_divergence", f"select season, e, round(avg(abs(delta)), 6) mean, max(abs(delta)) most, count(*) n from {MOVES} group by 1, 2", lambda g: moves(g).groupBy("season", "e").agg(F.round(F.avg(F.abs("delta")), 6).alias("mean"), F.max(F.abs("delta")).alias("most"), F.count("*").alias("n")))
register(
    "K19_top_movers",
    f"select season, e, team, delta from (select *, row_number() over (partition by season, e order by abs(delta) desc, team) r from {MOVES} where e > 0) where r <= 5",
    lambda g: moves(g).where("e > 0").withColumn("r", F.row_number().over(Window.partitionBy("season", "e").orderBy(F.desc(F.abs("delta")), "team"))).where("r <= 5").select("season", "e", "team", "delta"),
)
register("K29_divergence_roll_up", f"select season, round(avg(abs(delta)), 6) mean, max(abs(delta)) most from {MOVES} group by 1", lambda g: moves(g).groupBy("season").agg(F.round(F.avg(F.abs("delta")), 6).alias("mean"), F.max(F.abs("delta")).alias("most")))
register(
    "K30_revision_tally",
    f"select season, count(*) graded, count(case when delta <> 0 then 1 end) moved, round(count(case when delta <> 0 then 1 end) / count(*), 6) share from {MOVES} group by 1",
    lambda g: moves(g).groupBy("season").agg(F.count("*").alias("graded"), F.count(F.when(F.col("delta") != 0, 1)).alias("moved"), F.round(F.count(F.when(F.col("delta") != 0, 1)) / F.count("*"), 6).alias("share")),
)
register(
    "K31_biggest_move",
    f"select season, team, e, delta from (select *, row_number() over (partition by season order by abs(delta) desc, e, team) r from {MOVES}) where r = 1",
    lambda g: moves(g).withColumn("r", F.row_number().over(Window.partitionBy("season").orderBy(F.desc(F.abs("delta")), "e", "team"))).where("r = 1").select("season", "team", "e", "delta"),
)
register("K20_grid_of_seasons", "select season, count(*) n, count(distinct e) polls from retro_grid group by season", lambda g: g.groupBy("season").agg(F.count("*").alias("n"), F.countDistinct("e").alias("polls")))


def blended_grid(spark: SparkSession, d: str) -> DataFrame:
    """The grid by the blend as of every bucket."""
    g = A.played(spark, d)
    return grid(g, fitted.power_by_bucket(g, "L3", fitted.contest_steps(spark, d)))


query("K15_triangle_blend", "select * from l3_retro_grid")(blended_grid)
query("K13_live_surface_blend", "select season, e, team, wins, losses, tail, rank from l3_retro_grid where is_live")(lambda spark, d: blended_grid(spark, d).where("is_live").select("season", "e", "team", "wins", "losses", "tail", "rank"))
query("K14_hindsight_surface_blend", "select season, e, team, wins, losses, tail, rank from l3_retro_grid where is_hindsight")(lambda spark, d: blended_grid(spark, d).where("is_hindsight").select("season", "e", "team", "wins", "losses", "tail", "rank"))


@query("K12_power_by_bucket", "select * from power_as_of")
def power_by_bucket(spark: SparkSession, d: str) -> DataFrame:
    return fitted.power_by_bucket(A.played(spark, d))


@query("K21_dense_rank_by", "select season, team, cast(row_number() over (partition by season order by rating desc, team) as int) rank from power where rating is not null and rating > 0")
def dense_rank_by(spark: SparkSession, d: str) -> DataFrame:
    p = fitted.power(A.played(spark, d)).where("rating is not null and rating > 0")
    return p.select("season", "team", F.row_number().over(Window.partitionBy("season").orderBy(F.desc("rating"), "team")).alias("rank"))


@query("K22_rank_from_rating", "select team, cast(row_number() over (order by r desc, team) as int) rank from (select team, round(avg(rating), 6) r from power group by team)")
def rank_from_rating(spark: SparkSession, d: str) -> DataFrame:
    p = fitted.power(A.played(spark, d)).groupBy("team").agg(F.round(F.avg("rating"), 6).alias("r"))
    return p.select("team", F.row_number().over(Window.orderBy(F.desc("r"), "team")).alias("rank"))


@query("K23_composite_rank", "select season, team, cast(row_number() over (partition by season order by -wins, coalesce(rating, 0), team) as int) rank from (select season, team, sum(won) wins from sides group by 1, 2) left join power using (season, team)")
def composite_rank(spark: SparkSession, d: str) -> DataFrame:
    """A missing value counts as 0 in every part of the key."""
    g = A.played(spark, d)
    w = A.sides(g).groupBy("season", "team").agg(F.sum("won").alias("wins")).join(fitted.power(g), ["season", "team"], "left")
    return w.select("season", "team", F.row_number().over(Window.partitionBy("season").orderBy(-F.col("wins"), F.coalesce("rating", F.lit(0.0)), "team")).alias("rank"))


@query("K24_index_merge", "with a as (select season, week, count(*) n from contests where game_id % 2 = 0 group by 1, 2), b as (select season, week, count(*) n from contests where game_id % 3 = 0 group by 1, 2) select coalesce(b.season, a.season) season, coalesce(b.week, a.week) as week, coalesce(b.n, a.n) n from a full join b on a.season = b.season and a.week = b.week")
def index_merge(spark: SparkSession, d: str) -> DataFrame:
    """New rows over old ones, old ones kept where there are no new."""
    g = A.contests(spark, d)
    a = g.where("game_id % 2 = 0").groupBy("season", "week").agg(F.count("*").alias("old"))
    b = g.where("game_id % 3 = 0").groupBy("season", "week").agg(F.count("*").alias("new"))
    return a.join(b, ["season", "week"], "full").select("season", "week", F.coalesce("new", "old").alias("n"))


PAIRS = "(select season, team, wins, losses, round(tail, 6) tail, cast(row_number() over (partition by season order by round(tail, 12), round(mid, 12), team) as int) rank from odds)"


@query("K25_same_record_pairs", Q.SEASON_ODDS + f"select a.season, a.team leader, b.team foil, a.wins, round(b.tail - a.tail, 6) gap from {PAIRS} a join {PAIRS} b on a.season = b.season and a.wins = b.wins and a.losses = b.losses and a.rank < b.rank where a.rank <= 25 and b.rank <= 25 and a.tail <> b.tail")
def same_record_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Of the first 25, pairs with equal records and different odds; the join is on season and record."""
    t = Q.season_odds(spark, d)
    t = t.select("season", "team", "wins", "losses", F.round("tail", 6).alias("tail"), Q.ranked(t, ["season"]).alias("rank")).where("rank <= 25")
    b = t.select("season", "wins", "losses", F.col("team").alias("foil"), F.col("tail").alias("other"), F.col("rank").alias("below"))
    j = t.join(b, ["season", "wins", "losses"]).where("rank < below and tail <> other")
    return j.select("season", F.col("team").alias("leader"), "foil", "wins", F.round(F.col("other") - F.col("tail"), 6).alias("gap"))


@query("K27_one_in", Q.SEASON_ODDS + "select season, team, case when tail > 0 then least(round_even(round(1 / tail, 4), 0), 1e15) end one_in from odds")
def one_in(spark: SparkSession, d: str) -> DataFrame:
    """1 in N, N rounded half to even and bounded; null without a chance."""
    t = Q.season_odds(spark, d)
    return t.select("season", "team", F.when(F.col("tail") > 0, F.least(F.bround(F.round(1 / F.col("tail"), 4), 0), F.lit(1e15))).alias("one_in"))


@query("K28_layer_rows", ODDS_POWER + "select season, team, layer, round(v, 4) as value from (select season, team, unnest(['odds', 'power', 'wins']) layer, unnest([as_key, rating, cast(wins as double)]) v from (select *, key as as_key from res0)) where v is not null")
def layer_rows(spark: SparkSession, d: str) -> DataFrame:
    t = season_rows(spark, d)
    long = t.select("season", "team", F.expr("stack(3, 'odds', key, 'power', rating, 'wins', cast(wins as double)) as (layer, v)"))
    return long.where("v is not null").select("season", "team", "layer", F.round("v", 4).alias("value"))
