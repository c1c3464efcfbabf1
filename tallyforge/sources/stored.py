"""Tables written below the shared folder, so that what is read often is worked out once and survives lost executors."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Lets Spark delete a query's shuffle files as soon as the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where that is unset (tests)."""
    have = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if have:
        return have.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="shared-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


@contextlib.contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Queries run inside leave no shuffle files behind; while they run, lost tasks can still read them."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


class Stored:
    """A table written once; its shuffles are gone then, as nothing reads them again.

    It lasts as long as the driver's process, which deletes what is left at its end: results that are read lazily may need it.
    """

    kept: dict[str, Stored] = {}

    def __init__(self, df: DataFrame, name: str, partition_by: list[str] | None = None):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/tables/{name}-{uuid.uuid4().hex}"
        writer = df.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        with tidied(self.spark):
            writer.parquet(self.path)
        self.schema = df.schema
        self.kept[self.path] = self

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Deletes the files; only once nothing lazy reads them any more."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(conf).delete(where, True)
        self.kept.pop(self.path, None)


@atexit.register
def drop_all() -> None:
    """Deletes the tables of this process; a JVM that is gone already took its session's end with it."""
    for stored in list(Stored.kept.values()):
        with contextlib.suppress(Exception):
            stored.drop()


def stored(df: DataFrame, name: str) -> DataFrame:
    return Stored(df, name).read()
