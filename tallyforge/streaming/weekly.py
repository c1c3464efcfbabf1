"""The weekly cycle as a stream: an extension, since the engine's inputs come in bodies a week.

Contests arrive; each micro-batch names the buckets that it touches, and what stands as of these and later buckets of
the season is stated again.  Late bodies overwrite by the newest; published rows are inserted once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyforge.plans.registry import query
from tallyforge.sources import adapters as A


def touched(batch: DataFrame) -> DataFrame:
    """(season, from_bucket): from where on each season has to be stated again."""
    return batch.groupBy("season").agg(F.min("bucket_order").alias("from_bucket"))


def restate(stream: DataFrame, store: str, build: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Keeps all contests below `store` and writes what `build` makes of the touched seasons to `out`, once a micro-batch."""

    def each(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{store}/epoch={epoch}")
        known = spark.read.schema(batch.schema).option("recursiveFileLookup", True).parquet(store)
        newest = known.groupBy("game_id").agg(F.max_by(F.struct(*known.columns), "start_date").alias("r")).select("r.*")
        build(newest.join(touched(batch).select("season"), "season", "left_semi")).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(stream: DataFrame, late: str = "14 days", width: str = "7 days") -> DataFrame:
    """Counts and points of contests a week of kickoffs, later ones than the watermark being left out."""
    return stream.withWatermark("start_date", late).groupBy(F.window("start_date", width).alias("w"), "season").agg(F.count("*").alias("games"), F.sum(F.col("home_points") + F.col("away_points")).alias("points"))


@query("X01_weekly_windows", "select cast(floor((epoch(start_date) - 345600) / 604800) * 604800 + 345600 as bigint) week_start, season, count(*) games, cast(sum(home_points + away_points) as bigint) points from contests group by 1, 2")
def weekly_windows(spark: SparkSession, d: str) -> DataFrame:
    """The batch form of the windowed stream; windows begin on Thursdays as epoch days do, moved to Mondays."""
    g = A.contests(spark, d).withColumn("week", F.window("start_date", "7 days", "7 days", "4 days"))
    return g.groupBy(F.unix_timestamp("week.start").alias("week_start"), "season").agg(F.count("*").alias("games"), F.sum(F.col("home_points") + F.col("away_points")).alias("points"))
