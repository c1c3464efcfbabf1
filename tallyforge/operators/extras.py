"""Guards, plug-ins, files and documents as queries: what SURVEY lists beside the tables."""

from __future__ import annotations

import html
import json
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import config as C
from tallyforge.functions import png
from tallyforge.operators import baselines as B
from tallyforge.operators import metrics as M
from tallyforge.operators import projection as J
from tallyforge.operators import ranking as K
from tallyforge.operators import serving as V
from tallyforge.operators import fitted
from tallyforge.plans.registry import query, rule
from tallyforge.sources import adapters as A
from tallyforge.sources import sinks as S
from tallyforge.sources.archive import colours


def raises(f: Callable[[], object]) -> str:
    try:
        f()
    except (ValueError, KeyError) as e:
        return type(e).__name__
    return ""


def rows(spark: SparkSession, data: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(data, schema)


def shared(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; below a temporary one where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='out-')}"
    return f"{base.rstrip('/')}/out-{uuid.uuid4().hex}"


def in_folder(spark: SparkSession, use: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    """Rows that come from files of the driver's, which go with the folder."""
    root = tempfile.mkdtemp(prefix="files-")
    try:
        return spark.createDataFrame(use(root), schema)
    finally:
        shutil.rmtree(root, ignore_errors=True)


@rule("S14_lock_states")
def lock_states(spark: SparkSession, d: str) -> DataFrame:
    """What a sync finds of each locked file: missing, size, digest or ok."""

    def use(a) -> DataFrame:
        names = [r.file for r in a.manifest(spark).orderBy("file").collect()]
        (a.root / names[0]).unlink()
        (a.root / names[1]).write_bytes(b"x")
        return a.states(spark)

    return V.in_archive(spark, use).groupBy("state").count()


@query("S25_csv_source")
def csv_source(spark: SparkSession, d: str) -> DataFrame:
    path = shared(spark)
    A.table(spark, d, "part").select(F.col("p_brand").alias("team"), F.col("p_size").alias("season"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("").alias("colour")).write.option("header", True).csv(path)
    return colours(spark, path).groupBy("team").agg(F.count("*").alias("n"), F.count("colour").alias("known"))


@rule("K02_ordering_validation")
def ordering_validation(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, [(o, raises(lambda o=o: K.order_columns(o))) for o in (*K.ORDERINGS, "fame")], "ordering string, error string")


def pinned(pins: list[dict], season: int, poll: int) -> dict | None:
    """The first pin for a poll; a pin of one team with itself, or without a reason, is an error."""
    for p in pins:
        if p["leader"] == p["foil"] or not p.get("why"):
            raise ValueError("a pin needs two teams and a reason")
    return next((p for p in pins if (p["season"], p["poll"]) == (season, poll)), None)


@rule("K26_pinned_pair")
def pinned_pair(spark: SparkSession, d: str) -> DataFrame:
    pins = [{"season": 1997, "poll": 3, "leader": "T000001", "foil": "T000002", "why": "same record"}]
    got = [(1997, k, (p := pinned(pins, 1997, k)) and p["leader"], p and p["foil"]) for k in (2, 3)]
    return rows(spark, got, "season int, poll int, leader string, foil string")


@rule("A10_prediction_redirect")
def prediction_redirect(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, [(k, B.PREDICTS_BY.get(k, k)) for k in B.RATERS], "rater string, predicts_by string")


PLUGIN = "from pyspark.sql import functions as F\nfrom tallyforge.sources.adapters import sides\n\ndef rate(games):\n    return sides(games).groupBy('season', 'team').agg(F.avg('margin').alias('rating'))\n"


@query("M24_challenger", "select season, team, round(avg(margin), 6) rating from sides group by season, team")
def challenger(spark: SparkSession, d: str) -> DataFrame:
    """A rater from a user's file, run like any other."""
    root = tempfile.mkdtemp(prefix="plugin-")
    try:
        path = os.path.join(root, "mean_margin.py")
        with open(path, "w") as f:
            f.write(PLUGIN)
        rate = B.load_challenger(path)
    finally:
        shutil.rmtree(root, ignore_errors=True)
    return rate(A.played(spark, d)).withColumn("rating", F.round("rating", 6))


@query("M25_scorecard")
def scorecard(spark: SparkSession, d: str) -> DataFrame:
    """One line of a Markdown table a season."""
    m = M.measured(M.scored(spark, d), "season")
    return m.select("season", F.format_string("| %d | %d | %.3f | %.2f | %.2f | %.4f |", "season", "n", "su", "mae", "rmse", "brier").alias("line"))


def min_violations(games: DataFrame) -> DataFrame:
    raise NotImplementedError("the order of least violations is a linear-ordering programme and isn't offered")


def closing_line(games: DataFrame) -> DataFrame:
    raise NotImplementedError("there is no archive of closing lines or committee ranks")


@rule("J29_holdout_guard")
def holdout(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, [(s, raises(lambda s=s: J.holdout_guard(s))) for s in (1999, 2000, 2001)], "season int, error string")


@rule("C02_config_hash")
def config_hash(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, [("defaults", C.file_hash(json.dumps(C.DEFAULTS, sort_keys=True).encode()))], "name string, hash string")


@rule("C04_evidence_guard")
def evidence_guard(spark: SparkSession, d: str) -> DataFrame:
    tries = {"cap": {"margin": {"c": 24.0}}, "seed": {"bootstrap": {"seed": 1}}, "sigma": {"resume": {"sigma": 9.0}}}
    return rows(spark, [(k, raises(C.Recipe(k, "try", v).resolve)) for k, v in tries.items()], "recipe string, error string")


@rule("C05_resolved_hash")
def resolved_hash(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, [(r.slug, C.resolved_hash(r.resolve())) for r in C.RECIPES], "slug string, hash string")


@rule("C06_recipe_roster")
def recipe_roster(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, [(i, r.stance, r.slug) for i, r in enumerate(C.roster())], "place int, stance string, slug string")


@rule("C16_lever_validate")
def lever_validate(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, [(k, raises(lambda k=k, v=v: C.clamp(k, v))) for k, v in (("margin.c", 3.0), ("margin.d", 3.0), ("poll.ordering", "fame"))], "lever string, error string")


@query("O01_rank_outputs", "select season, team, cast(row_number() over (partition by season order by rating desc, team) as int) rank from power")
def rank_outputs(spark: SparkSession, d: str) -> DataFrame:
    """A poll written in three formats and read back from the text."""
    path = shared(spark)
    S.write_all(J.settled_poll(spark, d), path, "poll", ["season", "rank"])
    return spark.read.schema("season int, team string, rank int").option("header", True).csv(f"{path}/poll.csv")


@query("O02_grid_outputs", "select season, e, k, team, rank from retro_grid where is_live or is_hindsight")
def grid_outputs(spark: SparkSession, d: str) -> DataFrame:
    path = shared(spark)
    cells = K.grid(A.played(spark, d)).where("is_live or is_hindsight").select("season", "e", "k", "team", "rank")
    cells.write.partitionBy("season").parquet(path)
    return spark.read.parquet(path).select(F.col("season").cast("int").alias("season"), "e", "k", "team", "rank")


@query("O03_canonical_csv")
def canonical_csv(spark: SparkSession, d: str) -> DataFrame:
    """The canonical text of all ratings, written to the shared folder; the root of its lines' digests."""
    return S.write_canonical(fitted.power(A.played(spark, d)), shared(spark), ["season", "team"])


def written(root: str) -> None:
    for name, body in (("a.json", "{}"), ("b/c.csv", "x\n"), ("b/d.csv", "y\n")):
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(body)


@rule("O08_inventory")
def inventory(spark: SparkSession, d: str) -> DataFrame:
    return in_folder(spark, lambda r: [written(r), [(x["name"], x["bytes"], x["sha256"]) for x in S.inventory(r)]][1], "name string, bytes long, sha256 string")


@rule("O09_upsert_sql")
def upserts(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, [(t, S.upsert_sql(t, [*k, "payload"]), t in S.IMMUTABLE) for t, k in S.SERVING.items()], "name string, statement string, immutable boolean")


@rule("O10_load_without_address")
def load_without_address(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, [(t, S.load_jdbc(spark.range(1).toDF("k"), t, None)) for t in S.SERVING], "name string, loaded boolean")


@query("O11_documents")
def documents(spark: SparkSession, d: str) -> DataFrame:
    poll = J.settled_poll(spark, d).where("rank <= 25")
    return in_folder(spark, lambda r: [(S.write_documents(poll, r, ["season"], ["rank", "team"]), len(os.listdir(r)))], "documents int, files int")


@query("O12_index_rebuild", "select cast(season as bigint) season, count(*) teams from (select season, row_number() over (partition by season order by rating desc, team) r from power) where r <= 25 group by 1")
def index_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """Seasons and counts read back from the documents themselves."""
    path = shared(spark)
    J.settled_poll(spark, d).where("rank <= 25").groupBy("season").agg(F.collect_list(F.struct("rank", "team")).alias("rows")).write.json(path)
    docs = spark.read.schema("season long, rows array<struct<rank:int,team:string>>").json(path)
    return docs.select("season", F.size("rows").cast("long").alias("teams"))


@rule("O13_release")
def release(spark: SparkSession, d: str) -> DataFrame:
    return in_folder(spark, lambda r: [written(r), [(x["asset"], x["bytes"]) for x in S.release(r)]][1], "asset string, bytes long")


@rule("O14_release_verify")
def release_verify(spark: SparkSession, d: str) -> DataFrame:
    def use(root: str) -> list[tuple]:
        written(root)
        manifest = S.release(root)
        with open(os.path.join(root, "a.json"), "w") as f:
            f.write("changed")
        return [(n,) for n in S.verify_release(root, manifest)]

    return in_folder(spark, use, "name string")


@rule("O18_mark_luminance")
def mark_luminance(spark: SparkSession, d: str) -> DataFrame:
    """Mean luminance of images held in a binary column."""

    @F.pandas_udf("double")
    def luminance(b: pd.Series) -> pd.Series:
        return b.map(png.mean_luminance)

    images = [(v, bytearray(png.encode_grey(np.full((4, 6), v)))) for v in (0, 128, 255)]
    return rows(spark, images, "v int, png binary").select("v", F.round(luminance("png"), 6).alias("luminance"))


def card_svg(title: str, lines: list[str]) -> str:
    """A plain card: a title and lines of text."""
    text = "".join(f'<text x="24" y="{72 + 28 * i}" font-size="18">{html.escape(line)}</text>' for i, line in enumerate(lines))
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="480" height="{96 + 28 * len(lines)}"><text x="24" y="36" font-size="24">{html.escape(title)}</text>{text}</svg>'


@query("O19_cards")
def cards(spark: SparkSession, d: str) -> DataFrame:
    """One card a season with its first ten; ten short lines a row come to the driver's side of a UDF."""

    @F.pandas_udf("string")
    def svg(season: pd.Series, lines: pd.Series) -> pd.Series:
        return pd.Series([card_svg(f"Season {s}", list(x)) for s, x in zip(season, lines, strict=True)])

    top = J.publish_document(spark, d).groupBy("season").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    return top.select("season", svg("season", "lines").alias("svg"))


@rule("O21_preflight")
def preflight(spark: SparkSession, d: str) -> DataFrame:
    """Which tables a run needs are there, and what is a stub."""
    have = [(t, bool(A.table(spark, d, t).columns)) for t in ("orders", "lineitem", "supplier", "nation", "events")]
    return rows(spark, [*have, ("min_violations", False), ("closing_line", False)], "part string, ready boolean")


