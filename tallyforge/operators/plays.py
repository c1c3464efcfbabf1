"""Step-level operators: scoreboard repair, next-score targets, expected points, play values, weights (P*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.plans.registry import query
from tallyforge.sources import adapters as A

EDGES = (3, 6, 10)
BANDWIDTH = 5.0
PRIOR = 200.0
YARDS = 99
#: Score leads from which a period's steps count nothing (fixed values of the two published rules).
GARBAGE = {"connelly": (43, 37, 29, 22), "strict": (28, 24, 21, 16)}


def snap_points(delta: str) -> Column:
    """A scoreboard change as one score: touchdown, field goal or safety value by size."""
    return F.expr(snap_points_sql(delta))


def snap_points_sql(delta: str) -> str:
    return f"(sign({delta}) * case when abs({delta}) >= 5.5 then 7 when abs({delta}) >= 2.5 then 3 when abs({delta}) > 0 then 2 else 0 end)"


def distance_bucket_sql(distance: str = "distance", to_goal: str = "yards_to_goal") -> str:
    steps = " ".join(f"when {distance} <= {e} then {i + 1}" for i, e in enumerate(EDGES))
    return f"case when {distance} >= {to_goal} then 0 {steps} else {len(EDGES) + 1} end"


SCORED = "cast(case when offense_is_home then points_scored else -points_scored end as int)"
P01_VIEWS = {
    "board": f"""select *, sum(case when {SCORED} > 0 then {SCORED} else 0 end) over w - case when event_id % 11 = 0 then 3 else 0 end home_shown,
      sum(case when {SCORED} < 0 then -({SCORED}) else 0 end) over w away_shown from steps window w as (partition by game_id order by play_index rows between unbounded preceding and current row)""",
}


def board(steps: DataFrame) -> DataFrame:
    """Steps and the scores that a feed shows, which now and then fall back."""
    w = Window.partitionBy("game_id").orderBy("play_index").rowsBetween(Window.unboundedPreceding, 0)
    signed = F.expr(SCORED)
    shown = steps.withColumns({"home_shown": F.sum(F.greatest(signed, F.lit(0))).over(w) - F.when(F.col("event_id") % 11 == 0, 3).otherwise(0), "away_shown": F.sum(F.greatest(-signed, F.lit(0))).over(w)})
    return shown


def repaired(shown: DataFrame) -> DataFrame:
    """Scores made monotone by their running maximum; the margin before each step and the points it made, from the offence's side."""
    order = Window.partitionBy("game_id").orderBy("play_index")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    out = shown.withColumns({"home_after": F.max("home_shown").over(upto), "away_after": F.max("away_shown").over(upto)})
    out = out.withColumn("margin_after", F.col("home_after") - F.col("away_after"))
    out = out.withColumn("margin_before", F.lag("margin_after", 1, 0).over(order))
    sign = F.when(F.col("offense_is_home"), 1).otherwise(-1)
    return out.withColumns({"score_margin": sign * F.col("margin_before"), "points_made": sign * (F.col("margin_after") - F.col("margin_before"))})


REPAIRED = """select *, case when offense_is_home then 1 else -1 end * margin_before score_margin, case when offense_is_home then 1 else -1 end * (margin_after - margin_before) points_made from (
  select *, lag(margin_after, 1, 0) over (partition by game_id order by play_index) margin_before from (
    select *, home_after - away_after margin_after from (select *, max(home_shown) over w home_after, max(away_shown) over w away_after from ({board}) window w as (partition by game_id order by play_index rows between unbounded preceding and current row))))""".replace("{board}", P01_VIEWS["board"])


@query("P01_scoreboard_repair", f"select game_id, play_index, cast(home_after as bigint) home_after, cast(away_after as bigint) away_after, cast(score_margin as bigint) score_margin, cast(points_made as bigint) points_made from ({REPAIRED})")
def scoreboard_repair(spark: SparkSession, d: str) -> DataFrame:
    return repaired(board(A.steps(spark, d))).select("game_id", "play_index", "home_after", "away_after", "score_margin", "points_made")


@query("P02_steps_of_window", "select game_id, play_index, points_scored from steps where game_id in (select user_id from events where event_type = 'signup' group by 1 having count(*) >= 15)")
def steps_of_window(spark: SparkSession, d: str) -> DataFrame:
    """The steps of those games that a slice holds."""
    games = A.table(spark, d, "events").where("event_type = 'signup'").groupBy(F.col("user_id").alias("game_id")).count().where(F.col("count") >= 15)
    return A.steps(spark, d).join(games, "game_id", "left_semi").select("game_id", "play_index", "points_scored")


@query(
    "P03_join_integrity",
    """with g as (select distinct c_custkey game_id from customer where c_custkey % 2 = 0), s as (select distinct user_id game_id from events)
    select (select count(*) from s anti join g using (game_id)) orphans, (select count(*) from g anti join s using (game_id)) uncovered, (select count(*) from s join g using (game_id)) matched,
    (select string_agg(distinct event_type, ',' order by event_type) from events where event_type not in ('view', 'click', 'purchase')) unknown_types""",
)
def join_integrity(spark: SparkSession, d: str) -> DataFrame:
    g = A.table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("game_id")).distinct().withColumn("g", F.lit(1))
    e = A.table(spark, d, "events")
    s = e.select(F.col("user_id").alias("game_id")).distinct().withColumn("s", F.lit(1))
    both = g.join(s, "game_id", "full").agg(F.sum(F.col("g").isNull().cast("int")).alias("orphans"), F.sum(F.col("s").isNull().cast("int")).alias("uncovered"), F.sum((F.col("g").isNotNull() & F.col("s").isNotNull()).cast("int")).alias("matched"))
    odd = e.where(~F.col("event_type").isin("view", "click", "purchase")).agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("unknown_types"))
    return both.join(F.broadcast(odd))


@query("P04_points_snapping", f"select event_id, {snap_points_sql('floor(value / 8) - 5')} points from events", points="double")
def points_snapping(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "events").select("event_id", snap_points("floor(value / 8) - 5").alias("points"))


@query("P05_distance_bucket", f"select game_id, play_index, {distance_bucket_sql()} bucket from steps")
def distance_buckets(spark: SparkSession, d: str) -> DataFrame:
    return A.steps(spark, d).select("game_id", "play_index", F.expr(distance_bucket_sql()).alias("bucket"))


NEXT = "coalesce(case when nxt is null then 0 when offense_is_home then nxt else -nxt end, 0)"
TARGETS = f"""select *, {NEXT} next_score, {distance_bucket_sql()} bucket from (
  select *, first_value(case when points_scored <> 0 then {SCORED} end ignore nulls) over (partition by game_id, segment order by play_index rows between current row and unbounded following) nxt from steps)"""


def next_scores(steps: DataFrame) -> DataFrame:
    """The next scoring step's points within (game, segment), this step's own included, from the offence's side; 0 without one."""
    ahead = Window.partitionBy("game_id", "segment").orderBy("play_index").rowsBetween(0, Window.unboundedFollowing)
    out = steps.withColumn("nxt", F.first(F.when(F.col("points_scored") != 0, F.expr(SCORED)), ignorenulls=True).over(ahead))
    return out.withColumns({"next_score": F.expr(NEXT), "bucket": F.expr(distance_bucket_sql())})


@query("P06_next_score", f"select game_id, play_index, next_score from ({TARGETS})")
def next_score_rows(spark: SparkSession, d: str) -> DataFrame:
    return next_scores(A.steps(spark, d)).select("game_id", "play_index", "next_score")


KERNEL = f"exp(-0.5 * pow((a - b) / cast({BANDWIDTH} as double), 2))"


def kernel(spark: SparkSession) -> DataFrame:
    """Unnormalised Gaussian weights between yards 1 and 99."""
    yards = spark.range(1, YARDS + 1).select(F.col("id").cast("int").alias("a"))
    return yards.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(YARDS)))).withColumn("k", F.expr(KERNEL))


@query("P07_kernel", f"select a, b, round({KERNEL}, 9) k from (select cast(unnest(range(1, 100)) as int) a) x, (select cast(unnest(range(1, 100)) as int) b) y")
def kernel_rows(spark: SparkSession, d: str) -> DataFrame:
    return kernel(spark).select("a", "b", F.round("k", 9).alias("k"))


EP_SQL = f"""
  cells as (select down, bucket, yards_to_goal, sum(next_score) total, count(*) n from ({TARGETS}) where is_snap group by 1, 2, 3),
  kern as (select a, b, {KERNEL} k from (select cast(unnest(range(1, 100)) as int) a) x, (select cast(unnest(range(1, 100)) as int) b) y),
  g as (select a, sum(k * total) / sum(k * n) m from cells join kern on b = yards_to_goal group by a),
  dn as (select down, a, sum(k * total) num, sum(k * n) den from cells join kern on b = yards_to_goal group by 1, 2),
  cl as (select down, bucket, a, sum(k * total) num, sum(k * n) den from cells join kern on b = yards_to_goal group by 1, 2, 3),
  grid as (select cast(unnest(range(1, 5)) as int) down), bs as (select cast(unnest(range(0, {len(EDGES) + 2})) as int) bucket),
  ed as (select grid.down, g.a, (coalesce(dn.num, 0) + {PRIOR} * m) / (coalesce(dn.den, 0) + {PRIOR}) m from grid cross join g left join dn on dn.down = grid.down and dn.a = g.a),
  ep as (select ed.down, bs.bucket, ed.a yards_to_goal, (coalesce(cl.num, 0) + {PRIOR} * ed.m) / (coalesce(cl.den, 0) + {PRIOR}) ep from ed cross join bs left join cl on cl.down = ed.down and cl.bucket = bs.bucket and cl.a = ed.a)"""


def expected_points(steps: DataFrame) -> DataFrame:
    """(down, bucket, yards_to_goal, ep) for all 4 x 5 x 99 states.

    Sums and counts of the next score are smoothed over yards with the kernel at three grains, and each grain is drawn
    to the one above by a prior of steps, the counts being those smoothed.  One pass over the steps makes the cells;
    all that follows is over a few thousand rows.
    """
    spark = steps.sparkSession
    cells = next_scores(steps).where("is_snap").groupBy("down", "bucket", "yards_to_goal").agg(F.sum("next_score").alias("total"), F.count("*").alias("n"))
    k = F.broadcast(kernel(spark).withColumnRenamed("b", "yards_to_goal"))
    smooth = cells.join(k, "yards_to_goal").groupBy("down", "bucket", "a").agg(F.sum(F.col("k") * F.col("total")).alias("num"), F.sum(F.col("k") * F.col("n")).alias("den"))
    downs = smooth.groupBy("down", "a").agg(F.sum("num").alias("dnum"), F.sum("den").alias("dden"))
    world = smooth.groupBy("a").agg((F.sum("num") / F.sum("den")).alias("m"))
    grid = world.withColumn("down", F.explode(F.sequence(F.lit(1), F.lit(4)))).join(downs, ["down", "a"], "left")
    zero = F.lit(0.0)
    grid = grid.withColumn("dm", (F.coalesce("dnum", zero) + PRIOR * F.col("m")) / (F.coalesce("dden", zero) + PRIOR))
    grid = grid.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(len(EDGES) + 1)))).join(smooth, ["down", "bucket", "a"], "left")
    return grid.select("down", "bucket", F.col("a").alias("yards_to_goal"), ((F.coalesce("num", zero) + PRIOR * F.col("dm")) / (F.coalesce("den", zero) + PRIOR)).alias("ep"))


@query("P08_expected_points", f"with {EP_SQL.strip()} select down, bucket, yards_to_goal, round(ep, 6) ep from ep")
def expected_points_rows(spark: SparkSession, d: str) -> DataFrame:
    return expected_points(A.steps(spark, d)).withColumn("ep", F.round("ep", 6))


LOOKUP = {"down": "greatest(1, least(4, down + 1))", "bucket": f"greatest(0, least({len(EDGES) + 1}, bucket))", "yards_to_goal": "greatest(1, least(99, yards_to_goal + 3))"}


@query("P09_ep_lookup", f"with {EP_SQL.strip()} select t.game_id, t.play_index, round(ep.ep, 6) ep from ({TARGETS}) t join ep on ep.down = {LOOKUP['down'].replace('down +', 't.down +')} and ep.bucket = t.bucket and ep.yards_to_goal = {LOOKUP['yards_to_goal'].replace('yards_to_goal +', 't.yards_to_goal +')}")
def ep_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A state beside the table's range takes the nearest state's value."""
    s = A.steps(spark, d)
    t = next_scores(s).select("game_id", "play_index", *(F.expr(v).cast("int").alias(k) for k, v in LOOKUP.items()))
    return t.join(F.broadcast(expected_points(s)), ["down", "bucket", "yards_to_goal"]).select("game_id", "play_index", F.round("ep", 6).alias("ep"))


def play_values(steps: DataFrame, table: DataFrame) -> DataFrame:
    """Value of each snap: what follows less the expectation before.

    What follows are the points it made, else the next snap's expectation within (game, segment), its sign turned
    where the ball changes sides, else 0 at the segment's end.  The window runs over snaps only.
    """
    snaps = next_scores(steps).where("is_snap").join(F.broadcast(table), ["down", "bucket", "yards_to_goal"])
    order = Window.partitionBy("game_id", "segment").orderBy("play_index")
    ahead = F.lead("ep").over(order) * F.when(F.lead("offense_is_home").over(order) == F.col("offense_is_home"), 1).otherwise(-1)
    after = F.when(F.col("points_scored") != 0, F.col("points_scored").cast("double")).otherwise(F.coalesce(ahead, F.lit(0.0)))
    return snaps.withColumn("play_value", after - F.col("ep"))


@query(
    "P10_play_value",
    f"""with {EP_SQL.strip()}, s as (select t.*, ep.ep from ({TARGETS}) t join ep on ep.down = t.down and ep.bucket = t.bucket and ep.yards_to_goal = t.yards_to_goal where is_snap)
    select game_id, play_index, round(case when points_scored <> 0 then points_scored else coalesce(lead(ep) over w * case when lead(offense_is_home) over w = offense_is_home then 1 else -1 end, 0) end - ep, 6) play_value
    from s window w as (partition by game_id, segment order by play_index)""",
)
def play_value_rows(spark: SparkSession, d: str) -> DataFrame:
    s = A.steps(spark, d)
    return play_values(s, expected_points(s)).select("game_id", "play_index", F.round("play_value", 6).alias("play_value"))


@query("P11_external_correlation", "select round(corr(x, y), 6) r, round(avg(abs(x - y)), 6) mad, round(stddev_pop(x - y), 6) sd, count(*) n from (select e.value x, a.value y from events e join (select user_id, event_type, avg(value) as value from events group by 1, 2) a on a.user_id = e.user_id and a.event_type = e.event_type)")
def external_correlation(spark: SparkSession, d: str) -> DataFrame:
    e = A.table(spark, d, "events").select("user_id", "event_type", F.col("value").alias("x"))
    other = e.groupBy("user_id", "event_type").agg(F.avg("x").alias("y"))
    j = e.join(other, ["user_id", "event_type"]).na.drop()
    diff = F.col("x") - F.col("y")
    return j.agg(F.round(F.corr("x", "y"), 6).alias("r"), F.round(F.avg(F.abs(diff)), 6).alias("mad"), F.round(F.stddev_pop(diff), 6).alias("sd"), F.count("*").alias("n"))


def garbage_sql(rule: str, period: str, margin: str) -> str:
    cuts = GARBAGE[rule]
    return f"case when abs({margin}) >= case greatest(1, least(4, {period})) when 1 then {cuts[0]} when 2 then {cuts[1]} when 3 then {cuts[2]} else {cuts[3]} end then 0.0 else 1.0 end"


PERIOD = "cast(1 + play_index % 5 as int)"


def step_weight_sql(rule: str) -> str:
    return f"case when play_type = 'error' then 0.0 when {PERIOD} in (2, 4) and distance <= 10 and yards_to_goal >= 40 and play_type = 'click' then 0.0 else {garbage_sql(rule, PERIOD, 'score_margin')} end"


STEP_WEIGHT = step_weight_sql("strict")


@query("P12_step_weights", f"select game_id, play_index, cast({STEP_WEIGHT} as double) w from ({REPAIRED})")
def step_weights(spark: SparkSession, d: str) -> DataFrame:
    """No weight for decided games, kneels and heaves at a half's end."""
    return repaired(board(A.steps(spark, d))).select("game_id", "play_index", F.expr(STEP_WEIGHT).cast("double").alias("w"))


@query("P13_garbage_time", f"select event_id, cast({garbage_sql('connelly', 'cast(1 + event_id % 5 as int)', 'value - 20')} as double) w from events")
def garbage_time(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "events").select("event_id", F.expr(garbage_sql("connelly", "cast(1 + event_id % 5 as int)", "value - 20")).cast("double").alias("w"))
