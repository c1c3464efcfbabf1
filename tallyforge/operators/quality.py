"""Data-quality checks, digests and leakage audits (D*)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import fitted
from tallyforge.plans.registry import query, rule
from tallyforge.sources import adapters as A
from tallyforge.sources import digest

#: Parts of column names that no model may read, and prefixes that make a name ours (fixed values).
BANNED = ("epa", "wpa", "wp_before", "elo", "spread", "odds_line", "rank_ap", "recruit")
OURS = ("our_", "play_value")
VERDICT = "case when bad > 0 then 'FAIL' when n = 0 then 'SKIP' else 'PASS' end"


@query("D01_completed_scored", f"select season, week, season_type, n, bad, {VERDICT} verdict from (select season, week, season_type, count(*) n, count(case when not completed and game_id % 11 <> 0 then 1 end) bad from contests group by 1, 2, 3)")
def completed_scored(spark: SparkSession, d: str) -> DataFrame:
    """Games without a result, known cancellations aside."""
    open_ = ~F.col("completed") & (F.col("game_id") % 11 != 0)
    g = A.contests(spark, d).groupBy("season", "week", "season_type").agg(F.count("*").alias("n"), F.count(F.when(open_, 1)).alias("bad"))
    return g.withColumn("verdict", F.expr(VERDICT))


@query("D02_week_count", "select season, week, season_type, n_games, case when n_games between 1 and 70 then 'PASS' else 'FAIL' end verdict from buckets")
def week_count(spark: SparkSession, d: str) -> DataFrame:
    b = A.bucket_table(A.raw_contests(spark, d))
    return b.select("season", "week", "season_type", "n_games", F.when(F.col("n_games").between(1, 70), "PASS").otherwise("FAIL").alias("verdict"))


ALLOWED = "case when season_type = 'postseason' then 4 when week = 1 then 2 else 1 end"


@query("D03_team_twice", f"select season, season_type, week, team, count(*) n from sides_of_all group by 1, 2, 3, 4 having count(*) > max({ALLOWED})")
def team_twice(spark: SparkSession, d: str) -> DataFrame:
    s = A.sides(A.contests(spark, d)).groupBy("season", "season_type", "week", "team").agg(F.count("*").alias("n"))
    return s.where(f"n > {ALLOWED}")


@query("D04_teams_present", "with roster as (select distinct season, team from sides_of_all), t as (select r.season, r.team, b.b, count(s.game_id) n from roster r cross join (select 26 b) b left join sides_of_all s on s.season = r.season and s.team = r.team and s.completed group by 1, 2, 3) select season, team, n, n between greatest(1, b - 12) and b + 12 present from t")
def teams_present(spark: SparkSession, d: str, expected: int = 26, slack: int = 12) -> DataFrame:
    """Each team's games against what a season should have."""
    g = A.contests(spark, d)
    roster = A.sides(g).select("season", "team").distinct()
    n = A.sides(g.where("completed")).groupBy("season", "team").agg(F.count("*").alias("n"))
    t = roster.join(n, ["season", "team"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return t.withColumn("present", F.col("n").between(max(1, expected - slack), expected + slack))


@query("D05_box_reconcile", "with l as (select l_orderkey, round(sum(l_quantity), 4) total, count(*) parts from lineitem group by 1) select count(*) orders, cast(sum(case when parts > 7 then 1 else 0 end) as bigint) long_orders, round(sum(total), 2) total from l join orders on o_orderkey = l_orderkey")
def box_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Sums of the parts of a score against the whole."""
    parts = A.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_quantity"), 4).alias("total"), F.count("*").alias("parts"))
    j = parts.join(A.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    return j.agg(F.count("*").alias("orders"), F.sum(F.when(F.col("parts") > 7, 1).otherwise(0)).alias("long_orders"), F.round(F.sum("total"), 2).alias("total"))


@query("D06_movement_bound", "select a.season, a.team, round(b.rating - a.rating, 6) change, abs(b.rating - a.rating) > 10 flagged from power a join power b on b.season = a.season + 1 and b.team = a.team")
def movement_bound(spark: SparkSession, d: str, most: float = 10.0) -> DataFrame:
    p = fitted.power(A.played(spark, d))
    after = p.select((F.col("season") - 1).cast("int").alias("season"), "team", F.col("rating").alias("after"))
    change = F.col("after") - F.col("rating")
    return p.join(after, ["season", "team"]).select("season", "team", F.round(change, 6).alias("change"), (F.abs(change) > most).alias("flagged"))


SECOND = "second as (select game_id, case when game_id % 97 = 0 then home_points + 1 else home_points end home_points from contests where game_id % 3 <> 0)"


def second_source(g: DataFrame) -> DataFrame:
    return g.where("game_id % 3 <> 0").select("game_id", F.when(F.col("game_id") % 97 == 0, F.col("home_points") + 1).otherwise(F.col("home_points")).alias("other_points"))


@query("D07_score_difference", f"with {SECOND} select c.game_id, c.home_points, s.home_points other_points from contests c join second s using (game_id) where c.home_points is distinct from s.home_points")
def score_difference(spark: SparkSession, d: str) -> DataFrame:
    """Games that two sources share and score differently, nulls being equal to nulls."""
    g = A.contests(spark, d)
    return g.join(second_source(g), "game_id").where("not (home_points <=> other_points)").select("game_id", "home_points", "other_points")


@query("D08_cross_source_verdict", f"with {SECOND} select count(s.game_id) shared, count(*) - count(s.game_id) only_first, case when count(case when s.game_id is not null and c.home_points <> s.home_points then 1 end) > 0 then 'FAIL' else 'PASS' end verdict from contests c left join second s using (game_id)")
def cross_source_verdict(spark: SparkSession, d: str) -> DataFrame:
    g = A.contests(spark, d)
    j = g.join(second_source(g), "game_id", "left")
    bad = F.count(F.when(F.col("other_points") != F.col("home_points"), 1))
    return j.agg(F.count("other_points").alias("shared"), (F.count("*") - F.count("other_points")).alias("only_first"), F.when(bad > 0, "FAIL").otherwise("PASS").alias("verdict"))


@query("D09_first_week_guard", "select season, season_type, count(*) n from contests where week = 1 and month(start_date) in (12, 1) group by 1, 2")
def first_week_guard(spark: SparkSession, d: str) -> DataFrame:
    """First weeks that fall into December or January: a week's number alone is no key."""
    return A.contests(spark, d).where((F.col("week") == 1) & F.month("start_date").isin(12, 1)).groupBy("season", "season_type").agg(F.count("*").alias("n"))


CHECKS: dict[str, tuple[str, str]] = {
    "unplayed": ("not completed", "0.1"), "same_team": ("home_team = away_team", "0"), "negative": ("home_points < 0 or away_points < 0", "0"), "no_class": ("home_class is null or away_class is null", "0"),
    "no_kickoff": ("start_date is null", "0"), "odd_week": ("week < 1 or week > 53", "0"), "odd_type": ("season_type not in ('regular', 'postseason')", "0"), "shutout": ("home_points = 0 and away_points = 0", "0.01"),
}


@query("D10_week_validation", " union all ".join(f"select '{k}' check_name, season, count(case when {c} then 1 end) bad, count(case when {c} then 1 end) <= {m} * count(*) ok from contests group by season" for k, (c, m) in CHECKS.items()))
def week_validation(spark: SparkSession, d: str) -> DataFrame:
    """All checks in one pass: each is a conditional count, unpivoted afterwards."""
    g = A.contests(spark, d).groupBy("season").agg(F.count("*").alias("n"), *(F.count(F.when(F.expr(c), 1)).alias(k) for k, (c, _) in CHECKS.items()))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("check_name"), F.col(k).alias("bad"), (F.col(k) <= F.lit(float(m)) * F.col("n")).alias("ok")) for k, (_, m) in CHECKS.items())))
    return g.select("season", rows.alias("x")).select("season", "x.check_name", "x.bad", "x.ok")


def frame_digest(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """(digest, rows): the root of the tree of row digests in the given order, whatever the partitioning; rows of equal keys are ordered by their digests."""
    return digest.root(digest.placed(rows, order, F.sha2(digest.row_text([*order, *columns]), 256)))


DIGESTED, DIGESTED_BY = ["season", "week", "home_team", "away_team", "home_points", "away_points"], ["game_id"]


@query("D11_frame_digest", digest.root_sql("contests", DIGESTED, DIGESTED_BY))
def frame_digest_rows(spark: SparkSession, d: str) -> DataFrame:
    return frame_digest(A.contests(spark, d), DIGESTED, DIGESTED_BY)


def banned(columns: list[str]) -> list[str]:
    """Columns whose names hold a banned part in any case, ours aside."""
    return [c for c in columns if not c.lower().startswith(OURS) and any(b in c.lower() for b in BANNED)]


@rule("D12_banned_columns")
def banned_columns(spark: SparkSession, d: str) -> DataFrame:
    names = [*A.table(spark, d, "lineitem").columns, *A.table(spark, d, "events").columns, "home_EPA", "our_epa", "wp_before_play", "play_value_epa"]
    return spark.createDataFrame([(n, n in banned(names)) for n in names], "name string, banned boolean")


FUTURE = re.compile(r"(final|post_?game|next_|future|result_after)", re.I)


def temporal_guard(columns: list[str], declared: set[str]) -> dict[str, list[str]]:
    """Names that speak of the future, and names that nobody declared."""
    return {"future": [c for c in columns if FUTURE.search(c)], "undeclared": [c for c in columns if c not in declared]}


@rule("D13_temporal_guard")
def temporal_guard_rows(spark: SparkSession, d: str) -> DataFrame:
    got = temporal_guard([*A.table(spark, d, "orders").columns, "final_score", "next_opponent"], set(A.table(spark, d, "orders").columns))
    return spark.createDataFrame([(k, ",".join(v)) for k, v in got.items()], "kind string, names string")


def audit(build: Callable[[DataFrame], DataFrame], source: DataFrame, allowed: list[str], key: list[str], columns: list[str]) -> dict[str, bool]:
    """Whether a build gives the same digest from the allowed columns alone; if it can't run on them, what it lacks."""
    whole = frame_digest(build(source), columns, key).first()
    try:
        restricted = frame_digest(build(source.select(*allowed)), columns, key).first()
    except Exception as e:  # the analyser names the column that a build reads beyond the list
        return {"same": False, "missing": str(e).splitlines()[0]}
    return {"same": whole == restricted, "missing": ""}


READS = ["game_id", "season", "season_type", "week", "bucket_order", "game_type", "start_date", "neutral_site", "home_team", "away_team", "home_class", "away_class", "home_points", "away_points"]


@query("D14_allow_list_rebuild")
def allow_list_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """Power rebuilt from the allowed columns only, and with each of them taken away."""
    g = A.played(spark, d)
    got = [("all", audit(fitted.power, g, READS, ["season", "team"], ["rating"]))]
    got += [(c, audit(fitted.power, g, [r for r in READS if r != c], ["season", "team"], ["rating"])) for c in ("home_points", "start_date")]
    return spark.createDataFrame([(k, v["same"], v["missing"][:120]) for k, v in got], "without string, same boolean, missing string")


@query("D15_audit")
def audit_rows(spark: SparkSession, d: str) -> DataFrame:
    from tallyforge.operators import baselines as B

    g = A.played(spark, d)
    out = []
    for name in ("winpct", "colley", "srs", "l2"):
        r = audit(lambda x, f=B.rater(name): f(x).withColumn("rating", F.round("rating", 9)), g, READS, ["season", "team"], ["rating"])
        out.append((name, r["same"]))
    return spark.createDataFrame(out, "layer string, clean boolean")


