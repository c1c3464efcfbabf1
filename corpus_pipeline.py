"""The corpus pipeline: language ID, near-duplicate groups, mixing sources to target weights, token ids.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept, written and read again.  All but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import stages
from tallyforge.llm.common import Stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the rows outside of the held-out fold and drops documents of no language."""
    return stages.identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that links of 5-word shingles at a similarity of 0.8 form."""
    return stages.one_of_each_group(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out documents so that sources come to their target weights."""
    return stages.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every document and decodes it again."""
    return stages.tokenized(docs)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("mix_sources", mix_sources), ("token_ids", token_ids)]

#: A learned classifier has no SQL; tests/llm compares the stages with plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = Stored(stage(spark, docs, sf_dir), name).read()
    return docs
