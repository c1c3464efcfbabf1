"""The raw archive: append-only bodies with a manifest, verification, latest-wins reads (S09-S15, S25, S26)."""

from __future__ import annotations

import hashlib
import json
import re
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "endpoint string, params string, fetched_at string, file string, bytes long, sha256 string, status int, url string"
SECRET = re.compile(r"(?i)(api_?key|token|password|authorization)=")


class ArchiveError(ValueError):
    """An archive that isn't what its manifest says, or a write that would change it."""


class Archive:
    """Bodies below a local folder, each written once; the manifest is one JSON line a body."""

    def __init__(self, root: str):
        self.root = Path(root)
        self.manifest_path = self.root / "manifest.jsonl"

    def write(self, endpoint: str, params: dict[str, str], body: bytes, status: int = 200, url: str = "", at: datetime | None = None) -> str:
        """Stores a body under a time-stamped name, never over another one; refuses addresses that hold credentials."""
        if SECRET.search(url):
            raise ArchiveError("the address holds a credential")
        stamp = (at or datetime.now(UTC)).strftime("%Y%m%dT%H%M%S%fZ")
        slug = re.sub(r"[^a-z0-9]+", "-", f"{endpoint} {json.dumps(params, sort_keys=True)}".lower()).strip("-")
        name, n = f"{slug}-{stamp}.json", 1
        while (self.root / name).exists():
            n += 1
            name = f"{slug}-{stamp}-{n}.json"
        self.root.mkdir(parents=True, exist_ok=True)
        with open(self.root / name, "xb") as f:
            f.write(body)
        row = {"endpoint": endpoint, "params": json.dumps(params, sort_keys=True), "fetched_at": stamp, "file": name, "bytes": len(body), "sha256": hashlib.sha256(body).hexdigest(), "status": status, "url": url}
        with open(self.manifest_path, "a", encoding="utf-8") as f:
            f.write(json.dumps(row, sort_keys=True) + "\n")
        return name

    def manifest(self, spark: SparkSession) -> DataFrame:
        if not self.manifest_path.exists():
            return spark.createDataFrame([], MANIFEST)
        return spark.read.schema(MANIFEST).json(str(self.manifest_path))

    def states(self, spark: SparkSession) -> DataFrame:
        """(file, state) of every entry: missing, size, digest or ok."""
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(str(self.root)).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("have"), F.sha2("content", 256).alias("digest"))
        m = self.manifest(spark).join(files, "file", "left")
        state = F.when(F.col("have").isNull(), "missing").when(F.col("have") != F.col("bytes"), "size").when(F.col("digest") != F.col("sha256"), "digest").otherwise("ok")
        return m.select("file", state.alias("state"))

    def verify(self, spark: SparkSession) -> int:
        """Entries, all of which are as the manifest says; else an error that names the first."""
        bad = self.states(spark).where("state <> 'ok'").first()
        if bad:
            raise ArchiveError(f"{bad.file}: {bad.state}")
        return self.manifest(spark).count()

    def newest(self, spark: SparkSession, endpoint: str, params: dict[str, str] | None = None) -> DataFrame:
        """Of each parameter set the last good entry whose parameters contain the given ones."""
        m = self.manifest(spark).where((F.col("endpoint") == endpoint) & (F.col("status") == 200))
        for k, v in (params or {}).items():
            m = m.where(F.get_json_object("params", f"$.{k}") == v)
        return m.groupBy("params").agg(F.max(F.struct("fetched_at", "file")).alias("x")).select("params", F.col("x.file").alias("file"))

    def bodies(self, spark: SparkSession, endpoint: str, schema: str, params: dict[str, str] | None = None) -> DataFrame:
        """The newest bodies' rows by a written schema; an empty typed table where there are none."""
        files = [str(self.root / r.file) for r in self.newest(spark, endpoint, params).collect()]
        if not files:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(files)

    def lock(self, spark: SparkSession) -> DataFrame:
        """(asset, bytes, sha256); two entries of one flattened name are an error."""
        m = self.manifest(spark).select(F.regexp_replace("file", "/", "__").alias("asset"), "bytes", "sha256")
        twice = m.groupBy("asset").count().where("count > 1").first()
        if twice:
            raise ArchiveError(f"two entries are named {twice.asset}")
        return m


def colours(spark: SparkSession, path: str) -> DataFrame:
    """Team colours from CSV, blanks being null."""
    return spark.read.option("header", True).option("nullValue", "").schema("team string, season int, colour string").csv(path)


def latest_colours(rows: DataFrame) -> DataFrame:
    """The last season's colour of each team, and all its seasons joined in order."""
    return rows.groupBy("team").agg(F.max_by("colour", "season").alias("colour"), F.array_join(F.transform(F.array_sort(F.collect_set("season")), lambda s: s.cast("string")), "|").alias("seasons"))
