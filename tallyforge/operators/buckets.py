"""Sources, universes and time buckets (S*, W*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.plans.registry import query
from tallyforge.sources import adapters as A

#: The columns that the engine may read of a contest source, and no others.
RAW_COLUMNS = ("game_id", "season", "week", "season_type", "start_date", "completed", "neutral_site", "conference_game", "home_team", "away_team", "home_points", "away_points", "home_class", "away_class", "notes")
UNIVERSES: dict[str, str] = {
    "all": "true",
    "model": "home_class in ('fbs', 'fcs') or away_class in ('fbs', 'fcs')",
    "fbs_vs_fbs": "home_class = 'fbs' and away_class = 'fbs'",
}
LARGE_SPAN_DAYS = 21


def load_games(games: DataFrame, universe: str = "all") -> DataFrame:
    """Completed contests with both scores in a universe; an unknown universe is an error."""
    if universe not in UNIVERSES:
        raise ValueError(f"unknown universe {universe!r}; there are {sorted(UNIVERSES)}")
    return games.where("completed and home_points is not null and away_points is not null").where(UNIVERSES[universe])


@query("S01_contest_scan", "select " + ", ".join(c for c in RAW_COLUMNS if c != "start_date") + ", 'orders' source from noted")
def contest_scan(spark: SparkSession, d: str) -> DataFrame:
    return A.raw_contests(spark, d).select(*(c for c in RAW_COLUMNS if c != "start_date"), F.lit("orders").alias("source"))


@query("S02_step_scan", "select user_id game_id, event_id, event_type play_type, value, cast(year(ts) as int) season from events")
def step_scan(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "events").select(F.col("user_id").alias("game_id"), "event_id", F.col("event_type").alias("play_type"), "value", F.year("ts").cast("int").alias("season"))


@query("S03_json_source", "select event_id, cast(json_extract_string(props, '$.k') as int) k, event_type from events")
def json_source(spark: SparkSession, d: str) -> DataFrame:
    """A JSON body parsed with a written schema; fields that are missing are null."""
    e = A.table(spark, d, "events").withColumn("body", F.from_json("props", "k int"))
    return e.select("event_id", F.col("body.k").alias("k"), "event_type")


@query(
    "S04_union_supplement",
    """with first_part as (select * from noted where game_id % 4 <> 0), more as (select * from noted where game_id % 3 = 0),
    u as (select game_id, season, home_team, away_team, 'primary' source from first_part union all select game_id, season, home_team, away_team, 'supplement' from more where game_id not in (select game_id from first_part))
    select * from u""",
)
def union_supplement(spark: SparkSession, d: str) -> DataFrame:
    """A primary source and those rows of a supplement whose id the primary lacks."""
    raw = A.raw_contests(spark, d).select("game_id", "season", "home_team", "away_team")
    first, more = raw.where("game_id % 4 <> 0"), raw.where("game_id % 3 = 0")
    return first.withColumn("source", F.lit("primary")).unionByName(more.join(first, "game_id", "left_anti").withColumn("source", F.lit("supplement")))


for _name, _universe in (("S05_universe_all", "all"), ("S06_universe_top", "fbs_vs_fbs"), ("S07_universe_model", "model")):

    @query(_name, f"select game_id, season, home_team, away_team, home_points, away_points from contests where completed and ({UNIVERSES[_universe]})")
    def universe_rows(spark: SparkSession, d: str, _universe: str = _universe) -> DataFrame:
        return load_games(A.contests(spark, d), _universe).select("game_id", "season", "home_team", "away_team", "home_points", "away_points")


#: Kinds of step by shipped type (fixed values of the adapter).
STEP_CLASSES = {"view": "rush", "click": "pass", "purchase": "scrimmage_other", "signup": "non_play", "error": "penalty"}


@query(
    "S08_step_loader",
    """select game_id, play_index, case play_type when 'view' then 'rush' when 'click' then 'pass' when 'purchase' then 'scrimmage_other' when 'error' then 'penalty' else 'non_play' end play_class,
      lower(play_type) like '%err%' is_error, 60 * down + distance clock_seconds,
      play_type in ('view', 'click', 'purchase') and down between 1 and 4 and yards_to_goal between 1 and 99 is_snap from steps""",
)
def step_loader(spark: SparkSession, d: str) -> DataFrame:
    """Deduplicated by (game, index), classed by a map with a default, flags derived."""
    s = A.steps(spark, d)
    s = s.withColumn("rn", F.row_number().over(Window.partitionBy("game_id", "play_index").orderBy("event_id"))).where("rn = 1")
    kinds = F.create_map(*(F.lit(x) for kv in STEP_CLASSES.items() for x in kv))
    kind = F.coalesce(kinds[F.col("play_type")], F.lit("non_play"))
    snap = kind.isin("rush", "pass", "scrimmage_other") & F.col("down").between(1, 4) & F.col("yards_to_goal").between(1, 99)
    return s.select("game_id", "play_index", kind.alias("play_class"), F.lower("play_type").contains("err").alias("is_error"), (60 * F.col("down") + F.col("distance")).alias("clock_seconds"), snap.alias("is_snap"))


@query("S11_newest_body", "select user_id, event_type, event_id newest, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) rn from events) where rn = 1")
def newest_body(spark: SparkSession, d: str) -> DataFrame:
    """Of archived bodies with the same parameters the newest."""
    e = A.table(spark, d, "events").select("user_id", "event_type", F.struct("ts", "event_id", "value").alias("b"))
    return e.groupBy("user_id", "event_type").agg(F.max("b").alias("b")).select("user_id", "event_type", F.col("b.event_id").alias("newest"), "b.value")


@query("S13_lock_collisions", "select p_name asset, count(*) n, sum(p_size) bytes from part group by p_name having count(*) > 1", bytes="bigint")
def lock_collisions(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "part").groupBy(F.col("p_name").alias("asset")).agg(F.count("*").alias("n"), F.sum("p_size").alias("bytes")).where("n > 1")


@query("S16_returning_production", "select team, usage, percent from (select c_mktsegment || c_nationkey team, c_custkey, c_acctbal usage, round(c_acctbal / 10000, 6) percent, row_number() over (partition by c_mktsegment || c_nationkey order by c_custkey) rn from customer) where rn = 1")
def returning_production(spark: SparkSession, d: str) -> DataFrame:
    """The first record of each team in file order."""
    c = A.table(spark, d, "customer").select(F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("team"), "c_custkey", F.col("c_acctbal").alias("usage"))
    first = c.groupBy("team").agg(F.min_by("usage", "c_custkey").alias("usage"))
    return first.withColumn("percent", F.round(F.col("usage") / 10000, 6))


@query(
    "S17_portal_flow",
    """with moves as (select c_nationkey origin, case when c_custkey % 3 = 0 then null else cast(c_custkey % 25 as int) end destination from customer),
    o as (select origin team, count(*) n from moves group by 1), i as (select destination team, count(*) n from moves where destination is not null group by 1)
    select coalesce(o.team, i.team) team, coalesce(o.n, 0) "out", coalesce(i.n, 0) "in", coalesce(i.n, 0) - coalesce(o.n, 0) net, round((select count(destination) / count(*) from moves), 6) coverage from o full join i on o.team = i.team""",
)
def portal_flow(spark: SparkSession, d: str) -> DataFrame:
    moves = A.table(spark, d, "customer").select(F.col("c_nationkey").alias("origin"), F.when(F.col("c_custkey") % 3 != 0, (F.col("c_custkey") % 25).cast("int")).alias("destination"))
    out = moves.groupBy(F.col("origin").alias("team")).agg(F.count("*").alias("out"))
    come = moves.where("destination is not null").groupBy(F.col("destination").alias("team")).agg(F.count("*").alias("in"))
    share = moves.agg(F.round(F.count("destination") / F.count("*"), 6).alias("coverage"))
    zero = F.lit(0)
    both = out.join(come, "team", "full").select("team", F.coalesce("out", zero).alias("out"), F.coalesce("in", zero).alias("in"))
    return both.withColumn("net", F.col("in") - F.col("out")).join(F.broadcast(share))


@query(
    "S18_nested_explode",
    "select school, year, string_agg(name || ':' || games, ',' order by name, games) coaches from (select distinct o_orderpriority school, cast(year(o_orderdate) as int) as year, o_orderstatus name, cast(month(o_orderdate) as int) games from orders) group by school, year",
)
def nested_explode(spark: SparkSession, d: str) -> DataFrame:
    """Structs in an array exploded and folded into a sorted list a school and year."""
    o = A.table(spark, d, "orders").select("o_orderpriority", "o_orderstatus", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"))
    nested = o.groupBy("o_orderstatus").agg(F.collect_set(F.struct(F.col("o_orderpriority").alias("school"), F.col("y").alias("year"), F.col("m").alias("games"))).alias("seasons"))
    flat = nested.select(F.col("o_orderstatus").alias("name"), F.explode("seasons").alias("s"))
    lists = flat.groupBy("s.school", "s.year").agg(F.sort_array(F.collect_set(F.struct("name", F.col("s.games").alias("games")))).alias("l"))
    return lists.select("school", "year", F.array_join(F.transform("l", lambda x: F.concat(x["name"], F.lit(":"), x["games"].cast("string"))), ",").alias("coaches"))


COACHES = "select o_custkey school, cast(year(o_orderdate) as int) yr, 'C' || (o_orderkey % 4) name, count(*) games from orders group by 1, 2, 3"


@query(
    "S19_opening_coach",
    f"""with c as ({COACHES}), prior as (select school, yr + 1 yr, name from c),
    m as (select c.*, p.name is not null returning_, row_number() over (partition by c.school, c.yr order by (p.name is not null) desc, games desc, c.name desc) rn, count(*) over (partition by c.school, c.yr) n from c left join prior p on c.school = p.school and c.yr = p.yr and c.name = p.name)
    select school, yr, name, case when n = 1 then 'only' when returning_ then 'returning' else 'most_games' end provenance from m where rn = 1""",
)
def opening_coach(spark: SparkSession, d: str) -> DataFrame:
    """The only candidate; else of those present last year, else of all, the one with most games, then by name."""
    c = coaches(spark, d)
    prior = c.select("school", (F.col("yr") + 1).cast("int").alias("yr"), "name", F.lit(1).alias("back"))
    m = c.join(prior, ["school", "yr", "name"], "left")
    top = m.groupBy("school", "yr").agg(F.max(F.struct(F.coalesce("back", F.lit(0)).alias("back"), "games", "name")).alias("t"), F.count("*").alias("n"))
    return top.select("school", "yr", F.col("t.name").alias("name"), F.when(F.col("n") == 1, "only").when(F.col("t.back") == 1, "returning").otherwise("most_games").alias("provenance"))


def coaches(spark: SparkSession, d: str) -> DataFrame:
    o = A.table(spark, d, "orders").select(F.col("o_custkey").alias("school"), F.year("o_orderdate").cast("int").alias("yr"), F.concat(F.lit("C"), (F.col("o_orderkey") % 4).cast("string")).alias("name"))
    return o.groupBy("school", "yr", "name").agg(F.count("*").alias("games"))


@query("S20_coach_change", f"with c as (select school, yr, max(name) name from ({COACHES}) group by 1, 2) select n.school, n.yr, case when p.name is null then null when p.name <> n.name then 1 else 0 end changed from c n left join c p on p.school = n.school and p.yr = n.yr - 1")
def coach_change(spark: SparkSession, d: str) -> DataFrame:
    c = coaches(spark, d).groupBy("school", "yr").agg(F.max("name").alias("name"))
    prior = c.select("school", (F.col("yr") + 1).cast("int").alias("yr"), F.col("name").alias("before"))
    return c.join(prior, ["school", "yr"], "left").select("school", "yr", F.when(F.col("before").isNotNull(), (F.col("before") != F.col("name")).cast("int")).alias("changed"))


@query("S21_poll_flatten", "select p_brand team, min(rank) rank from (select p_brand, row_number() over (partition by p_type order by p_retailprice desc, p_partkey) rank from part) where rank <= 25 group by 1", rank="int")
def poll_flatten(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("p_type").orderBy(F.desc("p_retailprice"), "p_partkey")
    ranked = A.table(spark, d, "part").withColumn("rank", F.row_number().over(w)).where("rank <= 25")
    return ranked.groupBy(F.col("p_brand").alias("team")).agg(F.min("rank").alias("rank"))


@query(
    "S22_offseason_full_outer",
    """with a as (select distinct c_nationkey team, 1 a from customer where c_custkey % 2 = 0), b as (select distinct s_nationkey team, 1 b from supplier), c as (select distinct cast(p_size as int) team, 1 c from part)
    select coalesce(a.team, b.team, c.team) team, a, b, c from a full join b on a.team = b.team full join c on coalesce(a.team, b.team) = c.team""",
)
def offseason_full_outer(spark: SparkSession, d: str) -> DataFrame:
    a = A.table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_nationkey").alias("team")).distinct().withColumn("a", F.lit(1))
    b = A.table(spark, d, "supplier").select(F.col("s_nationkey").alias("team")).distinct().withColumn("b", F.lit(1))
    c = A.table(spark, d, "part").select(F.col("p_size").alias("team")).distinct().withColumn("c", F.lit(1))
    return a.join(b, "team", "full").join(c, "team", "full")


@query(
    "S23_source_coverage",
    """with w as (select distinct n_nationkey k from nation), h(source, k) as (select distinct 'customer', c_nationkey from customer union all select distinct 'supplier', s_nationkey from supplier)
    select source, count(*) covered, round(count(*) / (select count(*) from w), 6) share, (select count(*) from w) - count(*) missing from h join w using (k) group by source""",
)
def source_coverage(spark: SparkSession, d: str) -> DataFrame:
    wanted = A.table(spark, d, "nation").select(F.col("n_nationkey").alias("k")).distinct()
    have = A.table(spark, d, "customer").select(F.lit("customer").alias("source"), F.col("c_nationkey").alias("k")).unionByName(A.table(spark, d, "supplier").select(F.lit("supplier").alias("source"), F.col("s_nationkey").alias("k"))).distinct()
    n = wanted.agg(F.count("*").alias("n"))
    got = have.join(wanted, "k").groupBy("source").agg(F.count("*").alias("covered")).join(F.broadcast(n))
    return got.select("source", "covered", F.round(F.col("covered") / F.col("n"), 6).alias("share"), (F.col("n") - F.col("covered")).alias("missing"))


@query("S24_future_schedule", "select game_id, season, week, home_team, away_team, coalesce(case when home_class = 'ii' then null else home_class end, 'unknown') home_class from contests where not completed")
def future_schedule(spark: SparkSession, d: str) -> DataFrame:
    g = A.contests(spark, d).where("not completed and home_team is not null and away_team is not null")
    return g.select("game_id", "season", "week", "home_team", "away_team", F.coalesce(F.when(F.col("home_class") != "ii", F.col("home_class")), F.lit("unknown")).alias("home_class"))


@query("S27_team_dimension", "select team, team_class, n_name nation from (select team, min(team_class) team_class from sides_of_all group by team) join supplier on team = 'T' || lpad(cast(s_suppkey as varchar), 6, '0') left join nation on n_nationkey = s_nationkey")
def team_dimension(spark: SparkSession, d: str) -> DataFrame:
    """Best class of each team over both sides, with the crosswalk's attributes.  Class names sort from highest to lowest."""
    best = A.sides(A.contests(spark, d)).groupBy("team").agg(F.min("team_class").alias("team_class"))
    s = A.table(spark, d, "supplier").select(A.code("s_suppkey").alias("team"), "s_nationkey")
    n = A.table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("nation"))
    return best.join(s, "team").join(F.broadcast(n), "s_nationkey", "left").select("team", "team_class", "nation")


@query("S28_scheduled_weeks", "select distinct season, week from contests where season_type = 'regular'")
def scheduled_weeks(spark: SparkSession, d: str) -> DataFrame:
    return A.contests(spark, d).where("season_type = 'regular'").select("season", "week").distinct()


@query("S29_corpus_counter", "select season, count(*) games, sum(home_points + away_points) points from contests where completed group by season", points="bigint")
def corpus_counter(spark: SparkSession, d: str) -> DataFrame:
    return A.contests(spark, d).where("completed").groupBy("season").agg(F.count("*").alias("games"), F.sum(F.col("home_points") + F.col("away_points")).alias("points"))


@query("W01_bucket_table", "select season, season_type, week, bucket_order, n_games, span_days, cast(epoch(first_kickoff) as bigint) first_at, cast(epoch(last_kickoff) as bigint) last_at from buckets")
def bucket_table(spark: SparkSession, d: str) -> DataFrame:
    b = A.bucket_table(A.raw_contests(spark, d))
    return b.select("season", "season_type", "week", "bucket_order", "n_games", "span_days", F.unix_timestamp("first_kickoff").alias("first_at"), F.unix_timestamp("last_kickoff").alias("last_at"))


@query("W02_season_buckets", "select season, season_type, week, bucket_order, n_games from buckets")
def season_buckets(spark: SparkSession, d: str) -> DataFrame:
    return A.bucket_table(A.raw_contests(spark, d)).select("season", "season_type", "week", "bucket_order", "n_games")


def window(games: DataFrame, season: int, season_type: str, week: int, inclusive: bool = True) -> DataFrame:
    """The contests of a season up to a bucket, by the bucket's order and never by the week alone.  An unknown bucket is an error."""
    season_games = games.where(F.col("season") == season)
    cut = season_games.where((F.col("season_type") == season_type) & (F.col("week") == week)).select("bucket_order").first()
    if cut is None:
        raise KeyError(f"no bucket ({season}, {season_type}, {week})")
    return season_games.where(F.col("bucket_order") <= cut[0] if inclusive else F.col("bucket_order") < cut[0])


CUT = "(select season, bucket_order cut from buckets where season_type = 'postseason' and week = 1)"


def cuts(games: DataFrame, season_type: str = "postseason", week: int = 1) -> DataFrame:
    """(season, cut): the order of that bucket in each season that has it; one row a season."""
    return games.where((F.col("season_type") == season_type) & (F.col("week") == week)).groupBy("season").agg(F.min("bucket_order").alias("cut"))


@query("W03_prefix_window", f"select season, game_id, bucket_order from contests join {CUT} using (season) where bucket_order <= cut")
def prefix_window(spark: SparkSession, d: str) -> DataFrame:
    """Every season's contests up to its first bucket after the regular season."""
    g = A.contests(spark, d)
    return g.join(F.broadcast(cuts(g)), "season").where("bucket_order <= cut").select("season", "game_id", "bucket_order")


@query("W04_single_bucket", "select season, game_id from contests where season_type = 'postseason' and week = 1")
def single_bucket(spark: SparkSession, d: str) -> DataFrame:
    """The same bucket of every season."""
    return A.contests(spark, d).where("season_type = 'postseason' and week = 1").select("season", "game_id")


@query("W05_strictly_before", "select b.season, b.bucket_order as_of, count(c.game_id) n, coalesce(sum(c.home_points), 0) points from buckets b left join contests c on c.season = b.season and c.bucket_order < b.bucket_order group by 1, 2", points="bigint")
def strictly_before(spark: SparkSession, d: str) -> DataFrame:
    """Every bucket's past at once: a running sum over bucket totals instead of a range join over contests."""
    c = A.contests(spark, d).groupBy("season", "bucket_order").agg(F.count("*").alias("k"), F.sum("home_points").alias("p"))
    past = Window.partitionBy("season").orderBy("bucket_order").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    return c.select("season", F.col("bucket_order").alias("as_of"), F.coalesce(F.sum("k").over(past), zero).alias("n"), F.coalesce(F.sum("p").over(past), zero).alias("points"))


@query("W06_span_anomaly", "select season, week, span_days from buckets where season_type = 'regular' and span_days > 5")
def span_anomaly(spark: SparkSession, d: str, most: int = 5) -> DataFrame:
    return A.bucket_table(A.raw_contests(spark, d)).where((F.col("season_type") == "regular") & (F.col("span_days") > most)).select("season", "week", "span_days")


def trailing(rows: DataFrame, k: int, least: int, bucket: str = "bucket_order", by: str = "season") -> DataFrame:
    """Rows of the last k distinct buckets of each group; all rows where k <= 0, there are at most k, or the slice is thinner than `least`."""
    if k <= 0:
        return rows
    counts = rows.groupBy(by, bucket).agg(F.count("*").alias("n"))
    newest = Window.partitionBy(by).orderBy(F.desc(bucket))
    whole = Window.partitionBy(by)
    marked = counts.withColumn("place", F.row_number().over(newest)).withColumns({"some": F.sum(F.when(F.col("place") <= k, F.col("n"))).over(whole)})
    keep = marked.where((F.col("place") <= k) | (F.col("some") < least)).select(by, bucket)
    return rows.join(keep, [by, bucket], "left_semi")


@query(
    "W07_trailing_buckets",
    """with k as (select season, bucket_order, count(*) n, row_number() over (partition by season order by bucket_order desc) place from played group by 1, 2), m as (select *, sum(case when place <= 3 then n end) over (partition by season) held from k)
    select game_id, season, bucket_order from played semi join (select season, bucket_order from m where place <= 3 or held < 40) using (season, bucket_order)""",
)
def trailing_buckets(spark: SparkSession, d: str) -> DataFrame:
    return trailing(A.played(spark, d), 3, 40).select("game_id", "season", "bucket_order")


def segment() -> Column:
    h, a = F.col("home_class") == "fbs", F.col("away_class") == "fbs"
    return F.when(F.col("game_type") == "cfp", "cfp").when(F.col("game_type") == "bowl_non_cfp", "bowl").when(h & a, "fbs_vs_fbs").when(h != a, "fbs_vs_fcs").otherwise("other")


@query("W08_segment", "select game_id, case when game_type = 'cfp' then 'cfp' when game_type = 'bowl_non_cfp' then 'bowl' when home_class = 'fbs' and away_class = 'fbs' then 'fbs_vs_fbs' when (home_class = 'fbs') <> (away_class = 'fbs') then 'fbs_vs_fcs' else 'other' end segment from contests")
def segment_rows(spark: SparkSession, d: str) -> DataFrame:
    return A.contests(spark, d).select("game_id", segment().alias("segment"))


@query("W09_game_type", "select game_id, game_type from typed")
def game_type_rows(spark: SparkSession, d: str) -> DataFrame:
    return A.raw_contests(spark, d).select("game_id", A.game_type().alias("game_type"))


@query(
    "W10_title_games",
    """with w as (select season, 1 + max(week) champ_week from (select season, week, count(*) n from contests where season_type = 'regular' and home_class = 'fbs' and away_class = 'fbs' and week < 48 group by 1, 2 having count(*) >= 5) group by 1),
    p as (select s.season, s.team, count(*) n from sides_of_all s join w using (season) where s.season_type = 'regular' and s.week < w.champ_week group by 1, 2)
    select c.game_id, c.season from contests c join w on w.season = c.season and c.week = w.champ_week join p h on h.season = c.season and h.team = c.home_team join p a on a.season = c.season and a.team = c.away_team
    where c.season_type = 'regular' and c.conference_game and h.n >= 12 and a.n >= 12""",
)
def title_games(spark: SparkSession, d: str, least_pairs: int = 5, least_games: int = 12, last_week: int = 48) -> DataFrame:
    """Conference contests of the week after the last full one, where both teams had enough contests before."""
    g = A.contests(spark, d).where("season_type = 'regular'")
    full = g.where((F.col("home_class") == "fbs") & (F.col("away_class") == "fbs") & (F.col("week") < last_week)).groupBy("season", "week").count().where(F.col("count") >= least_pairs)
    champ = full.groupBy("season").agg((1 + F.max("week")).alias("champ_week"))
    prior = A.sides(g).join(champ, "season").where("week < champ_week").groupBy("season", "team").agg(F.count("*").alias("n")).where(F.col("n") >= least_games)
    title = g.join(champ, "season").where("week = champ_week and conference_game")
    for side in ("home", "away"):
        title = title.join(prior.select("season", F.col("team").alias(f"{side}_team")), ["season", f"{side}_team"], "left_semi")
    return title.select("game_id", "season")


@query("W11_week_range", "select game_id from contests where season_type = 'regular' and completed and week between 5 and 14 and home_class in ('fbs') and away_class in ('fbs', 'fcs')")
def week_range(spark: SparkSession, d: str) -> DataFrame:
    g = A.contests(spark, d).where("season_type = 'regular' and completed")
    return g.where(F.col("week").between(5, 14) & F.col("home_class").isin("fbs") & F.col("away_class").isin("fbs", "fcs")).select("game_id")


@query("W12_after_bucket", f"select season, game_id from contests join {CUT} using (season) where bucket_order > cut")
def after_bucket(spark: SparkSession, d: str) -> DataFrame:
    """Every season's contests after its first bucket of the postseason."""
    g = A.contests(spark, d)
    return g.join(F.broadcast(cuts(g)), "season").where("bucket_order > cut").select("season", "game_id")


@query("W13_pre_postseason", "select season, min(bucket_order) - 1 bucket_order from contests where game_type in ('cfp', 'bowl_non_cfp') group by season")
def pre_postseason(spark: SparkSession, d: str) -> DataFrame:
    g = A.contests(spark, d).where(F.col("game_type").isin("cfp", "bowl_non_cfp"))
    return g.groupBy("season").agg((F.min("bucket_order") - 1).alias("bucket_order"))


@query("W14_postseason_segments", "select segment, count(*) n from (select 'all' segment from contests where game_type in ('cfp', 'bowl_non_cfp') union all select 'cfp' from contests where game_type = 'cfp' union all select 'other_bowls' from contests where game_type = 'bowl_non_cfp') group by 1")
def postseason_segments(spark: SparkSession, d: str) -> DataFrame:
    g = A.contests(spark, d).where(F.col("game_type").isin("cfp", "bowl_non_cfp"))
    own = F.when(F.col("game_type") == "cfp", "cfp").otherwise("other_bowls")
    return g.select(F.explode(F.array(F.lit("all"), own)).alias("segment")).groupBy("segment").agg(F.count("*").alias("n"))


@query("W15_publication_status", "select season, season_type, week, case when bucket_order < 5 then 'provisional' else 'published' end status from buckets")
def publication_status(spark: SparkSession, d: str, headline_start: int = 5) -> DataFrame:
    b = A.bucket_table(A.raw_contests(spark, d))
    return b.select("season", "season_type", "week", F.when(F.col("bucket_order") < headline_start, "provisional").otherwise("published").alias("status"))
