"""The operators as stages over tables with the columns of documents: decisions applied to whole rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, langid, mixing, ngramjoin
from .common import Stored, map_arrow, word_count

#: Most keys of rows to leave out that are sent to all tasks; beyond it the rows are shuffled.
MOST_IDS_SENT = 1_000_000


def identified(docs: DataFrame, languages: tuple[str, ...] | None = None, least_score: float = 0.5, far: float = langid.FAR) -> DataFrame:
    """The rows, unchanged, whose text is in one of `languages` (None: of all that could be learned).

    Rejected are null texts, texts without letters, those predicted to be in another language, those whose winner lost a duel
    (score under `least_score`), and those foreign to all learned languages (by `far` nats less likely than their usual texts).  Where no row is labelled nothing can be learned, and only texts without letters go.
    """
    model = langid.train(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def make():
        m = sent.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = [False] * batch.num_rows
            for at in range(0, batch.num_rows, 512):
                where, rows, size = [], [], []
                for i, x in enumerate(batch.column(place).slice(at, 512), at):
                    if raw := langid.letters(x.as_py()):
                        where.append(i)
                        rows.append(langid.vector(raw))
                        size.append(len(raw))
                if not rows:
                    continue
                if not m.families:
                    for i in where:
                        keep[i] = True
                    continue
                x = langid.np.stack(rows)
                foreign = m.foreign(x, langid.np.array(size), far)
                for i, (lang, score), unknown in zip(where, m.predict(x), foreign, strict=True):
                    keep[i] = not unknown and score >= least_score and (languages is None or lang in languages)
            return batch.filter(pa.array(keep))

        return each

    return map_arrow(docs, make, docs.schema)


def one_of_each_group(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Of each group of linked documents the row with the least id.

    Where ids repeat or are null, a row is named by its id (null last), text and all columns: rows that share an id but not a
    text are documents of their own, and rows without an id link like others.  Of rows alike in every column one
    stays; rows without id and words all stay, as they are linked with nothing.
    """
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").isEmpty():
        return roots(docs, "doc_id", width, percent)
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text"), F.xxhash64(*docs.columns).alias("row"))
    bare = F.col("doc_id").isNull() & (word_count() == 0)
    out = roots(docs.where(~bare).withColumn("__key", key), "__key", width, percent).dropDuplicates(["__key"])
    return out.select(*docs.columns).unionByName(docs.where(bare))


def roots(docs: DataFrame, key: str, width: int, percent: int) -> DataFrame:
    """The rows whose key is the least of their group."""
    found = ngramjoin.groups(docs, id_col=key, width=width, percent=percent)
    go = Stored(found.where(F.col(key) != F.col("component_id")).select(key).distinct(), "go").read()
    if go.count() <= MOST_IDS_SENT:
        go = F.broadcast(go)
    return docs.join(go, key, "left_anti").select(*docs.columns)


def mixed(docs: DataFrame) -> DataFrame:
    """Each row once for every slot of the schedule that begins it, 0 to 2 of them, in the order of the slots.

    Rows are named by id and text, so rows that share an id alone are mixed by themselves; of rows alike in both, one stands for
    all and is repeated by the slots of all.  Rows without an id stay once, behind the others, as the mix can't name them.
    """
    named = docs.where("doc_id is not null").withColumn("__key", F.struct("doc_id", F.xxhash64("text").alias("h")))
    slots = mixing.mix(named, id_col="__key").where("laps_begun > 0").groupBy("__key").agg(F.flatten(F.collect_list("lap_slots")).alias("__slots"))
    one = named if named.groupBy("__key").agg(F.count("*").alias("n")).where("n > 1").isEmpty() else named.dropDuplicates(["__key"])
    taken = one.join(slots, "__key").withColumn("__slot", F.explode("__slots"))
    bare = docs.where("doc_id is null").withColumn("__slot", F.lit(None).cast("struct<slot: bigint, at: bigint>"))
    return taken.select(*docs.columns, "__slot").unionByName(bare).orderBy(F.col("__slot").asc_nulls_last()).select(*docs.columns)


def tokenized(docs: DataFrame) -> DataFrame:
    return bpe.digests(docs)
