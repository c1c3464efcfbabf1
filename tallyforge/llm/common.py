"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge import ship
from tallyforge.sources.stored import Stored  # noqa: F401  for the other modules

#: Rows and bytes that a function of map_arrow gets at once; a row that is larger comes alone.
ROWS, BYTES = 2048, 32 << 20
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ROWS rows and, but for single rows, BYTES bytes."""
    if batch.num_rows > ROWS:
        for at in range(0, batch.num_rows, ROWS):
            yield from pieces(batch.slice(at, ROWS))
    elif batch.num_rows > 1 and batch.nbytes > BYTES:
        yield from pieces(batch.slice(0, batch.num_rows // 2))
        yield from pieces(batch.slice(batch.num_rows // 2))
    else:
        yield batch


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema) -> DataFrame:
    """mapInArrow with state per task: `make` runs once in each task and returns the function for its batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        try:
            for batch in batches:
                for piece in pieces(batch):
                    out = each(piece)
                    if out is not None and out.num_rows:
                        yield out
        finally:
            del each
            trim()

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def trim() -> None:
    """Gives freed memory back, since a worker lives on and idles beside the tasks that follow."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def hash60(*parts) -> F.Column:
    """60 bits of the md5 of columns as text, from 0 on; null and the empty text differ."""
    text = F.concat_ws("|", *(F.when(F.col(p).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col(p).cast("string"))) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def word_count(text: str = "text"):
    """Number of words, null counting 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def tokenizer_path(name: str, path: str | None = None) -> str:
    """Where a vocabulary file lies: as given, or in the public_tokenizers package."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)
