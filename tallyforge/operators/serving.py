"""Serving tables, comparison cards and archives as queries (O*, S09-S26)."""

from __future__ import annotations

import shutil
import tempfile
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.operators import metrics as M
from tallyforge.plans.registry import query, rule
from tallyforge.sources import adapters as A
from tallyforge.sources import sinks as S
from tallyforge.sources.archive import Archive, latest_colours


@rule("O04_serving_bundle")
def serving_bundle(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(t, ",".join(k), S.upsert_sql(t, [*k, "payload"])) for t, k in S.SERVING.items()], "name string, key string, upsert string")


@query("O05_games_rows", "select game_id, season, hs.s_suppkey home_id, aw.s_suppkey away_id, home_points, away_points from contests join supplier hs on home_team = 'T' || lpad(cast(hs.s_suppkey as varchar), 6, '0') join supplier aw on away_team = 'T' || lpad(cast(aw.s_suppkey as varchar), 6, '0')")
def games_rows(spark: SparkSession, d: str) -> DataFrame:
    ids = A.table(spark, d, "supplier").select("s_suppkey", A.code("s_suppkey").alias("team"))
    g = A.contests(spark, d).join(ids.select(F.col("team").alias("home_team"), F.col("s_suppkey").alias("home_id")), "home_team").join(ids.select(F.col("team").alias("away_team"), F.col("s_suppkey").alias("away_id")), "away_team")
    return g.select("game_id", "season", "home_id", "away_id", "home_points", "away_points")


@query("O06_backtest_rows", M.SCORED + f", m as (select season, count(*) n, {M.MEASURES} from sc group by season) select season, metric, v as value from (select season, unnest(['su', 'mae', 'rmse', 'brier']) metric, unnest([su, mae, rmse, brier]) v from m)")
def backtest_rows(spark: SparkSession, d: str) -> DataFrame:
    m = M.measured(M.scored(spark, d), "season")
    return m.select("season", F.expr("stack(4, 'su', su, 'mae', mae, 'rmse', rmse, 'brier', brier) as (metric, value)"))


@query("O07_parameter_split", "select o_orderkey, case when o_orderkey % 3 = 0 then null when o_totalprice is not null and isfinite(o_totalprice) then o_totalprice end numeric_value, case when o_orderkey % 3 = 0 then 'true' end label_value from orders")
def parameter_split(spark: SparkSession, d: str) -> DataFrame:
    """Truth values are labels, finite numbers are numeric."""
    is_label = F.col("o_orderkey") % 3 == 0
    finite = F.col("o_totalprice").isNotNull() & ~F.isnan("o_totalprice") & (F.abs("o_totalprice") != float("inf"))
    return A.table(spark, d, "orders").select("o_orderkey", F.when(~is_label & finite, F.col("o_totalprice")).alias("numeric_value"), F.when(is_label, "true").alias("label_value"))


CARD = M.TOP + ", g as (select season, team, least(a, 26) ours, least(b, 26) theirs from rk where a <= 25 or b <= 25), c as (select *, theirs - ours gap, case when ours = 26 or theirs = 26 then 'missing' when ours = theirs then 'agree' else 'gap' end as kind from g) "


def card(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("season")
    t = M.two_ratings(spark, d).withColumns({"a": F.row_number().over(w.orderBy(F.desc("x"), "team")), "b": F.row_number().over(w.orderBy(F.desc("y"), "team"))})
    t = t.where("a <= 25 or b <= 25").select("season", "team", F.least("a", F.lit(26)).alias("ours"), F.least("b", F.lit(26)).alias("theirs"))
    kind = F.when((F.col("ours") == 26) | (F.col("theirs") == 26), "missing").when(F.col("ours") == F.col("theirs"), "agree").otherwise("gap")
    return t.withColumns({"gap": F.col("theirs") - F.col("ours"), "kind": kind})


@query("O15_comparison_card", CARD + "select season, team, ours, theirs, gap, kind from c", ours="int", theirs="int", gap="int")
def comparison_card(spark: SparkSession, d: str) -> DataFrame:
    """Two polls side by side, a team outside of one counting as 26th there."""
    return card(spark, d).select("season", "team", "ours", "theirs", "gap", "kind")


@query("O16_tied_rank", "select season, team, case when count(*) over (partition by season, w) > 1 then 'T' || rank() over (partition by season order by w desc) else cast(rank() over (partition by season order by w desc) as varchar) end shown from (select season, team, sum(won) w from sides group by 1, 2)")
def tied_rank(spark: SparkSession, d: str) -> DataFrame:
    w = A.sides(A.played(spark, d)).groupBy("season", "team").agg(F.sum("won").alias("w"))
    rank = F.rank().over(Window.partitionBy("season").orderBy(F.desc("w"))).cast("string")
    many = F.count("*").over(Window.partitionBy("season", "w")) > 1
    return w.select("season", "team", F.when(many, F.concat(F.lit("T"), rank)).otherwise(rank).alias("shown"))


def channel_sql(v: str) -> str:
    return f"(case when {v} <= 0.04045 then {v} / cast(12.92 as double) else pow(({v} + 0.055) / cast(1.055 as double), 2.4) end)"


def luminance_sql(r: str, g: str, b: str) -> str:
    """Relative luminance of 8-bit channels (fixed values of the web's contrast rule)."""
    one = lambda x: channel_sql(f"(cast({x} as double) / 255)")
    return f"(cast(0.2126 as double) * {one(r)} + cast(0.7152 as double) * {one(g)} + cast(0.0722 as double) * {one(b)})"


RGB = ("p_partkey % 256", "(p_partkey * 7) % 256", "(p_partkey * 13) % 256")


@query("O17_contrast", f"select p_partkey, round({luminance_sql(*RGB)}, 6) luminance, round(1.05 / ({luminance_sql(*RGB)} + 0.05), 6) contrast from part")
def contrast(spark: SparkSession, d: str) -> DataFrame:
    lum = luminance_sql(*RGB)
    return A.table(spark, d, "part").select("p_partkey", F.round(F.expr(lum), 6).alias("luminance"), F.round(1.05 / (F.expr(lum) + 0.05), 6).alias("contrast"))


@query("O20_publish_guard", "select c_custkey, c_custkey % 2 = 0 and c_acctbal > 0 and not c_custkey % 5 = 0 publish from customer")
def publish_guard(spark: SparkSession, d: str) -> DataFrame:
    c = A.table(spark, d, "customer")
    return c.select("c_custkey", ((F.col("c_custkey") % 2 == 0) & (F.col("c_acctbal") > 0) & ~(F.col("c_custkey") % 5 == 0)).alias("publish"))


#: Outside systems that are listed beside ours and why they can't be scored (fixed values).
ROSTER = (("committee", "ranks only"), ("closing_line", "no archive"), ("writers_poll", "ranks only"), ("coaches_poll", "ranks only"), ("published_ratings", "terms of use"))


@rule("O22_external_roster")
def external_roster(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(n, w, False) for n, w in ROSTER], "system string, why string, scorable boolean")


def in_archive(spark: SparkSession, use) -> DataFrame:
    """A small archive made for a query, its result held as rows before the folder goes."""
    root = tempfile.mkdtemp(prefix="archive-")
    try:
        a = Archive(root)
        for i, body in enumerate((b'{"season": 1, "n": 2}', b'{"season": 1, "n": 3}', b'{"season": 2, "n": 5}')):
            a.write("games", {"season": "1" if i < 2 else "2"}, body, at=datetime(2024, 1, 1 + i, tzinfo=UTC))
        got = use(a)
        return spark.createDataFrame([tuple(r) for r in got.collect()], got.schema)
    finally:
        shutil.rmtree(root, ignore_errors=True)


@rule("S09_archive_writer")
def archive_writer(spark: SparkSession, d: str) -> DataFrame:
    return in_archive(spark, lambda a: a.manifest(spark).select("endpoint", "params", "bytes", "sha256"))


@rule("S10_manifest_verification")
def manifest_verification(spark: SparkSession, d: str) -> DataFrame:
    return in_archive(spark, lambda a: a.states(spark).groupBy("state").count())


@rule("S12_archived_bodies")
def archived_bodies(spark: SparkSession, d: str) -> DataFrame:
    return in_archive(spark, lambda a: a.bodies(spark, "games", "season int, n int"))


@query("S26_latest_colours", "select team, arg_max(colour, season) colour, string_agg(cast(season as varchar), '|' order by season) seasons from (select distinct p_brand team, cast(p_size as int) season, first_value(p_type) over (partition by p_brand, p_size order by p_partkey) colour from part) group by team")
def latest_colour_rows(spark: SparkSession, d: str) -> DataFrame:
    p = A.table(spark, d, "part").groupBy(F.col("p_brand").alias("team"), F.col("p_size").alias("season")).agg(F.min_by("p_type", "p_partkey").alias("colour"))
    return latest_colours(p)


