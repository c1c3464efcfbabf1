"""A session with the engine's settings, and a facade whose methods return DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.operators import baselines, buckets, fitted, ranking, ratings, resume
from tallyforge.operators import metrics as evaluation
from tallyforge.sources import adapters


def build_session(app: str = "tallyforge", shuffle_partitions: int | None = None, master: str | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if master:
        b = b.master(master)
    return b.getOrCreate()


class Engine:
    """Everything over one set of tables: games, Power, odds, the grid, raters and the back-test."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def games(self, universe: str = "fbs_vs_fbs") -> DataFrame:
        return buckets.load_games(adapters.contests(self.spark, self.path), universe)

    def steps(self) -> DataFrame:
        return adapters.steps(self.spark, self.path)

    def as_of(self, season: int, season_type: str, week: int, inclusive: bool = True) -> DataFrame:
        return buckets.window(self.games(), season, season_type, week, inclusive)

    def power(self, source: str = "L3") -> DataFrame:
        return ratings.power_of(self.games(), source, fitted.contest_steps(self.spark, self.path))

    def rate(self, name: str) -> DataFrame:
        rate = baselines.rater(name)
        return rate(self.games(), fitted.contest_steps(self.spark, self.path)) if rate in baselines.WITH_STEPS else rate(self.games())

    def odds(self) -> DataFrame:
        return resume.schedule_odds(self.spark, self.path)

    def grid(self, source: str = "L3") -> DataFrame:
        g = self.games()
        return ranking.grid(g, fitted.power_by_bucket(g, source, fitted.contest_steps(self.spark, self.path)))

    def backtest(self) -> DataFrame:
        return evaluation.measured(evaluation.scored(self.spark, self.path), "season")
