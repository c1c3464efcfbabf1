"""The engine's inputs, derived from the warehouse tables: contests, their time buckets, sides and steps.

Every view exists twice: as a DataFrame, and as SQL for DuckDB in VIEWS, from which with_views() puts those that a
statement names (and those that these need) in front of it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge import ship

#: Parameters of the engine (fixed values).
MARGIN_CAP = 28.0
HOME_EDGE = 2.5
SIGMA = 15.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code(key: str | Column) -> Column:
    return F.concat(F.lit("T"), F.lpad(F.col(key).cast("string") if isinstance(key, str) else key, 6, "0"))


def class_of(key: str) -> Column:
    return F.when(F.col(key) % 5 < 3, "fbs").when(F.col(key) % 5 == 3, "fcs").otherwise("ii")


def raw_contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an order whose first two lines have different suppliers; notes and divisions as a source ships them."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    first = lines.withColumn("rn", F.row_number().over(order)).where("rn <= 2")
    pair = first.groupBy("l_orderkey").agg(
        F.max(F.when(F.col("rn") == 1, F.col("l_suppkey"))).alias("hk"), F.max(F.when(F.col("rn") == 2, F.col("l_suppkey"))).alias("ak"),
        F.max(F.when(F.col("rn") == 1, F.col("l_quantity"))).cast("int").alias("home_points"), F.max(F.when(F.col("rn") == 2, F.col("l_quantity"))).cast("int").alias("away_points"),
    )
    regions = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_regionkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    joined = (
        pair.where("hk <> ak")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(regions.select(F.col("s_suppkey").alias("hk"), F.col("n_regionkey").alias("hr")), "hk")
        .join(regions.select(F.col("s_suppkey").alias("ak"), F.col("n_regionkey").alias("ar")), "ak")
    )
    post = F.month("o_orderdate") == 12
    week = F.floor((F.when(post, F.dayofmonth("o_orderdate")).otherwise(F.dayofyear("o_orderdate")) - 1) / 7).cast("int") + 1
    out = joined.select(
        F.col("o_orderkey").alias("game_id"), F.year("o_orderdate").cast("int").alias("season"), week.alias("week"), F.when(post, "postseason").otherwise("regular").alias("season_type"),
        F.col("o_orderdate").alias("start_date"), (F.col("o_orderkey") % 10 == 0).alias("neutral_site"), (F.col("hr") == F.col("ar")).alias("conference_game"),
        code("hk").alias("home_team"), code("ak").alias("away_team"), "home_points", "away_points", class_of("hk").alias("home_class"), class_of("ak").alias("away_class"), (F.col("home_points") != F.col("away_points")).alias("completed"),
    )
    notes = F.when((F.col("season_type") == "postseason") & (F.col("game_id") % 5 == 0), "College Football Playoff Semifinal").when((F.col("season_type") == "regular") & (F.col("week") >= 47) & F.col("conference_game"), "Conference Championship")
    return out.withColumn("notes", notes)


def game_type() -> Column:
    """First match wins: other division regular; playoff by notes; other postseason bowl; championship by notes; regular."""
    both = (F.col("home_class") == "fbs") & (F.col("away_class") == "fbs")
    post = F.col("season_type") == "postseason"
    return F.when(~both, "regular").when(post & F.coalesce(F.col("notes").rlike("(?i)college football playoff"), F.lit(False)), "cfp").when(post, "bowl_non_cfp").when(F.col("notes").rlike("(?i)championship"), "conf_champ").otherwise("regular")


def contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All contests with their type and bucket_order, the place of their (season, season_type, week) in the season."""
    raw = raw_contests(spark, sf_dir).withColumn("game_type", game_type())
    return with_bucket_order(raw)


def bucket_table(games: DataFrame) -> DataFrame:
    """One row a (season, season_type, week): first and last kickoff, games, order within the season, whole days spanned."""
    grouped = games.groupBy("season", "season_type", "week").agg(F.min("start_date").alias("first_kickoff"), F.max("start_date").alias("last_kickoff"), F.count("*").alias("n_games"))
    order = Window.partitionBy("season").orderBy("first_kickoff", "season_type", "week")
    span = F.floor((F.unix_timestamp("last_kickoff") - F.unix_timestamp("first_kickoff")) / 86400)
    return grouped.withColumns({"bucket_order": (F.row_number().over(order) - 1).cast("int"), "span_days": span})


def with_bucket_order(games: DataFrame) -> DataFrame:
    return games.join(bucket_table(games).select("season", "season_type", "week", "bucket_order"), ["season", "season_type", "week"])


def played(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed contests between two top-class teams."""
    return contests(spark, sf_dir).where("completed and home_class = 'fbs' and away_class = 'fbs'")


def sides(games: DataFrame) -> DataFrame:
    """Each contest as two rows, one a team: opponent, site (1 home, -1 away, 0 neutral), margin, won, lost, tied, class."""
    pick = lambda t, o, s: F.struct(
        F.col(f"{t}_team").alias("team"), F.col(f"{o}_team").alias("opponent"), F.col(f"{t}_class").alias("team_class"), F.col(f"{o}_class").alias("opponent_class"),
        F.when(F.col("neutral_site"), 0).otherwise(s).alias("site"), (F.col(f"{t}_points") - F.col(f"{o}_points")).alias("margin"), F.lit(t).alias("side"),
    )
    both = games.select("game_id", "season", "season_type", "week", "bucket_order", "game_type", "start_date", "neutral_site", F.explode(F.array(pick("home", "away", 1), pick("away", "home", -1))).alias("x"))
    return both.select("*", "x.*").drop("x").withColumns({"won": (F.col("margin") > 0).cast("int"), "lost": (F.col("margin") < 0).cast("int"), "tied": (F.col("margin") == 0).cast("int")})


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered steps of each contest-like sequence, as a play-by-play source ships them."""
    e = table(spark, sf_dir, "events").where("ts is not null and user_id is not null")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    out = e.select(
        F.col("user_id").alias("game_id"), (F.row_number().over(order) - 1).cast("int").alias("play_index"), F.floor(F.unix_timestamp("ts") / 604800).alias("segment"),
        F.col("event_type").alias("play_type"), (F.col("event_id") % 2 == 0).alias("offense_is_home"), (1 + F.col("event_id") % 4).cast("int").alias("down"), (1 + F.floor("value").cast("int") % 20).alias("distance"),
        (1 + (F.col("event_id") * 7) % 99).cast("int").alias("yards_to_goal"), "event_id", "value",
    )
    scored = F.when(F.col("play_type") == "purchase", F.when(F.col("event_id") % 3 == 0, 3).when(F.col("event_id") % 7 == 0, -7).otherwise(7)).otherwise(0)
    return out.withColumns({"points_scored": scored.cast("int"), "is_snap": F.col("play_type") != "signup"})


#: Views that are worked out once for a statement, however often it reads them.
MATERIALIZED: set[str] = {"played", "sides"}
VIEWS: dict[str, str] = {
    "raw_contests": """
      select o_orderkey game_id, cast(year(o_orderdate) as int) season, cast(floor((case when month(o_orderdate) = 12 then dayofmonth(o_orderdate) else dayofyear(o_orderdate) end - 1) / 7) as int) + 1 as week,
        case when month(o_orderdate) = 12 then 'postseason' else 'regular' end season_type, o_orderdate start_date, o_orderkey % 10 = 0 neutral_site, hn.n_regionkey = an.n_regionkey conference_game,
        'T' || lpad(cast(hk as varchar), 6, '0') home_team, 'T' || lpad(cast(ak as varchar), 6, '0') away_team, home_points, away_points,
        case when hk % 5 < 3 then 'fbs' when hk % 5 = 3 then 'fcs' else 'ii' end home_class, case when ak % 5 < 3 then 'fbs' when ak % 5 = 3 then 'fcs' else 'ii' end away_class, home_points <> away_points completed
      from (select l_orderkey, max(case when rn = 1 then l_suppkey end) hk, max(case when rn = 2 then l_suppkey end) ak, cast(max(case when rn = 1 then l_quantity end) as int) home_points, cast(max(case when rn = 2 then l_quantity end) as int) away_points
        from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) rn from lineitem) where rn <= 2 group by l_orderkey) p
      join orders on o_orderkey = l_orderkey join supplier hs on hs.s_suppkey = hk join nation hn on hn.n_nationkey = hs.s_nationkey join supplier aw on aw.s_suppkey = ak join nation an on an.n_nationkey = aw.s_nationkey
      where hk <> ak""",
    "noted": """
      select *, case when season_type = 'postseason' and game_id % 5 = 0 then 'College Football Playoff Semifinal' when season_type = 'regular' and week >= 47 and conference_game then 'Conference Championship' end notes from raw_contests""",
    "typed": """
      select *, case when not (home_class = 'fbs' and away_class = 'fbs') then 'regular' when season_type = 'postseason' and notes like 'College Football Playoff%' then 'cfp' when season_type = 'postseason' then 'bowl_non_cfp'
        when notes like '%Championship%' then 'conf_champ' else 'regular' end game_type from noted""",
    "buckets": """
      select season, season_type, week, min(start_date) first_kickoff, max(start_date) last_kickoff, count(*) n_games,
        cast(row_number() over (partition by season order by min(start_date), season_type, week) - 1 as int) bucket_order, cast(floor((epoch(max(start_date)) - epoch(min(start_date))) / 86400) as bigint) span_days
      from typed group by season, season_type, week""",
    "contests": "select t.*, b.bucket_order from typed t join buckets b using (season, season_type, week)",
    "played": "select * from contests where completed and home_class = 'fbs' and away_class = 'fbs'",
    "sides_of_all": """
      select game_id, season, season_type, week, bucket_order, game_type, start_date, neutral_site, completed, team, opponent, team_class, opponent_class, site, margin, side, cast(margin > 0 as int) won, cast(margin < 0 as int) lost, cast(margin = 0 as int) tied from (
        select *, home_team team, away_team opponent, home_class team_class, away_class opponent_class, case when neutral_site then 0 else 1 end site, home_points - away_points margin, 'home' side from contests
        union all select *, away_team, home_team, away_class, home_class, case when neutral_site then 0 else -1 end, away_points - home_points, 'away' from contests)""",
    "sides": "select * from sides_of_all where completed and team_class = 'fbs' and opponent_class = 'fbs'",
    "steps": """
      select *, case when play_type = 'purchase' then case when event_id % 3 = 0 then 3 when event_id % 7 = 0 then -7 else 7 end else 0 end points_scored, play_type <> 'signup' is_snap from (
        select user_id game_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) play_index, cast(floor(floor(epoch(ts)) / 604800) as bigint) segment, event_type play_type, event_id % 2 = 0 offense_is_home,
          cast(1 + event_id % 4 as int) down, 1 + cast(floor(value) as int) % 20 distance, cast(1 + (event_id * 7) % 99 as int) yards_to_goal, event_id, value from events where ts is not null and user_id is not null)""",
}


def with_views(sql: str, more: dict[str, str] | None = None) -> str:
    """The statement behind the views that it names, in an order in which each comes after those that it needs."""
    views, order = VIEWS | (more or {}), []

    def need(text: str) -> None:
        for name in views:
            if name not in order and re.search(rf"\b{name}\b", text) and views[name] is not text:
                need(views[name])
                if name not in order:
                    order.append(name)

    need(sql)
    body = sql.strip()
    recursive = re.match(r"with\s+recursive\s+", body, re.I)
    plain = re.match(r"with\s+", body, re.I)
    if not order:
        return body
    itself = {n for n in order if re.search(rf"\b{n}\b", views[n])}
    head = ",\n".join(f"{n} as {'' if n in itself else 'materialized ' if n in MATERIALIZED else ''}({views[n].strip()})" for n in order)
    start = "with recursive" if recursive or itself else "with"
    body = body[(recursive or plain).end() :] if recursive or plain else body
    return f"{start} {head}{',' if recursive or plain else ''}\n{body}"
