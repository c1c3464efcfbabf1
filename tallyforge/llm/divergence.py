"""Source divergence audit: how far each source's words are from each other source's of its language, and which words it favours.

Counts meet as sums per (lang, source, term) and are packed into vectors: a source's counts over one chunk of its language's
vocabulary.  A language's sources lie in blocks; each vector is sent to every pair of blocks that its own block is part
of, and a task computes the submatrix of one pair of blocks over a run of successive chunks.  Submatrices of the runs are added up.
All arithmetic is in whole numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge import ship

from .common import Stored, pieces, table, trim

#: Documents that must have a term, scale of p, terms of a source that are listed.
LEAST_DOCUMENTS, SCALE, MOST_TERMS = 3, 1_000_000_000, 200
#: Terms of a chunk, sources of a block, chunks that a task takes one after another, and terms that a task counts before it gives them on.
CHUNK, BLOCK, RUN, HELD = 4096, 64, 16, 200_000
#: Bytes of terms stay, A-Z in lower case; all others are blanks.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def term_counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, summed within tasks and then over all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in held.items():
                k = len(n)
                terms = pa.array([t.decode() for t in n], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), terms, pa.array(list(n.values()), pa.int64()), pa.array([d[t] for t in n], pa.int64())], ["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in batches:
            for piece in pieces(batch):
                for lang, source, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), piece.column(2), strict=True):
                    n, d = held.setdefault((lang, source), (Counter(), Counter()))
                    own = Counter(text.as_py().encode().translate(TERMS).split())
                    size -= len(n)
                    n.update(own)
                    d.update(own.keys())
                    size += len(n)
                    if size > HELD:
                        yield from flush()
                        size = 0
        yield from flush()
        trim()

    named = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    found = named.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n, total, terms):
    """1 + floor(SCALE * (n + 1) / (total + terms)), as whole numbers of up to 38 digits."""
    return F.expr(f"1L + (cast({n} + 1 as decimal(20, 0)) * {SCALE}) div cast({total} + {terms} as decimal(20, 0))")


def shares(n: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The same of arrays: long division by three digits at a time, so nothing passes 63 bits up to a `whole` of 9e15."""
    left, out = n + 1, np.zeros(np.broadcast(n, whole).shape, np.int64)
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + left // whole
        left = left % whole
    return out + 1


def submatrix(pdf: pd.DataFrame) -> pd.DataFrame:
    """(lang, g, other, value) for all sources of two blocks, over the chunks of a run one after another.

    Rows are (chunk, g, block, width, total, terms, slots, counts); each chunk has a row of every source of both blocks, and slots
    that a row doesn't list have count 0.
    """
    first, second = pdf["i"].iloc[0], pdf["j"].iloc[0]
    rows = np.sort(pdf["g"].unique())
    at = {g: k for k, g in enumerate(rows.tolist())}
    block = np.zeros(len(rows), np.int64)
    block[[at[g] for g in pdf["g"]]] = pdf["block"]
    a, b = np.flatnonzero(block == first), np.flatnonzero(block == second)
    values = np.zeros((len(rows), len(rows)), np.int64)
    for _, part in pdf.sort_values("chunk").groupby("chunk"):
        width = int(part["width"].iloc[0])
        if width == 0:
            continue
        n = np.zeros((len(rows), width), np.int64)
        whole = np.ones((len(rows), 1), np.int64)
        for g, total, terms, slots, counts in zip(part["g"], part["total"], part["terms"], part["slots"], part["counts"], strict=True):
            n[at[g], np.asarray(slots, np.int64)] = np.asarray(counts, np.int64)
            whole[at[g], 0] = total + terms
        p = shares(n, whole)
        for k in a:
            apart = p[k] - p[b]
            squares = apart * apart
            values[k, b] += (squares // p[b]).sum(1)
            if first != second:
                values[b, k] += (squares // p[k]).sum(1)
    keep = np.zeros_like(values, bool)
    keep[np.ix_(a, b)] = True
    keep |= keep.T
    np.fill_diagonal(keep, False)
    x, y = np.nonzero(keep)
    return pd.DataFrame({"lang": pdf["lang"].iloc[0], "g": rows[x], "other": rows[y], "value": values[x, y]})


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", block: int = BLOCK, chunk: int = CHUNK, run: int = RUN) -> DataFrame:
    """(lang, source, part, item, value, rank) of every source within its language.

    A language's terms are those in LEAST_DOCUMENTS of its documents.  p of a term is 1 + floor(SCALE * (its count + 1) / (all counts of these
    terms + their number)), of a source or of its language.  Part `pair`: item is each other source, value the
    sum over terms of floor((p - q)^2 / q) with the other's q, 0 without terms.  Part `term`: item is each term that the source has, its p above
    the language's q, value the same quotient, the MOST_TERMS greatest.  rank is by value descending, item ascending by bytes.
    Null text, lang and source count as empty ones; a source without terms takes part; a language of one source has no
    pair; repeated rows count as often as they stand there; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    counts = Stored(term_counts(docs, text_col, lang_col, source_col), "counts").read()
    by_source = Window.partitionBy("lang").orderBy("source")
    sources = docs.select(F.coalesce(lang_col, F.lit("")).alias("lang"), F.coalesce(source_col, F.lit("")).alias("source")).distinct()
    sources = Stored(sources.withColumn("g", F.row_number().over(by_source).cast("long") - 1), "sources").read()
    known = counts.groupBy("lang", "term").agg(F.sum("n").alias("of_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST_DOCUMENTS)
    known = Stored(known.select("lang", "term", "of_lang"), "known").read()
    langs = sources.groupBy("lang").agg(F.count("*").alias("many")).join(known.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("of_lang").alias("lang_total")), "lang", "left")
    langs = langs.select("lang", "many", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"))
    langs = langs.withColumns({"chunks": F.greatest(F.ceil(F.col("terms") / chunk), F.lit(1)).cast("int"), "blocks": F.ceil(F.col("many") / block).cast("int")})
    langs = Stored(langs, "langs").read()
    # A term's chunk is drawn by its hash, and its slot is its place there.
    placed = known.join(langs, "lang").select("lang", "term", "of_lang", F.pmod(F.xxhash64("term"), "chunks").cast("int").alias("chunk"))
    slot = F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1
    placed = Stored(placed.withColumn("slot", slot), "placed").read()
    held = Stored(counts.select("lang", "source", "term", "n").join(placed, ["lang", "term"]), "held").read()
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = Stored(sources.join(totals, ["lang", "source"], "left").join(langs, "lang").withColumn("total", F.coalesce("total", F.lit(0).cast("long"))), "groups").read()
    out = pairs(held, groups, placed, block, run).unionByName(favoured(held, groups))
    return out.select("lang", "source", "part", "item", "value", "rank")


def ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int"))


def favoured(held: DataFrame, groups: DataFrame) -> DataFrame:
    """Part `term`; of a source's terms each task gives on no more than the MOST_TERMS greatest."""
    both = held.join(groups, ["lang", "source"]).withColumns({"p": share("n", "total", "terms"), "q": share("of_lang", "lang_total", "terms")}).where("p > q")
    rows = both.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    return ranked(rows).where(F.col("rank") <= MOST_TERMS)


def pairs(held: DataFrame, groups: DataFrame, placed: DataFrame, block: int, run: int) -> DataFrame:
    """Part `pair`: packed vectors, replicated to pairs of blocks, a submatrix a task."""
    packed = held.join(groups.select("lang", "source", "g"), ["lang", "source"]).groupBy("lang", "g", "chunk").agg(F.collect_list("slot").alias("slots"), F.collect_list("n").alias("counts"))
    widths = placed.groupBy("lang", "chunk").agg(F.count("*").alias("width"))
    every = groups.where("many > 1").select("lang", "g", "total", "terms", "blocks", F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk"))
    vectors = every.join(widths, ["lang", "chunk"], "left").join(packed, ["lang", "g", "chunk"], "left")
    own = (F.col("g") / block).cast("int")
    sent = vectors.withColumn("block", own).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    none = F.array().cast("array<long>")
    sent = sent.select(
        "lang", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.floor(F.col("chunk") / run).cast("int").alias("run"), "chunk", "g", "block", F.coalesce("width", F.lit(0)).alias("width"),
        "total", "terms", F.coalesce(F.col("slots").cast("array<long>"), none).alias("slots"), F.coalesce("counts", none).alias("counts"),
    )
    found = sent.groupBy("lang", "i", "j", "run").applyInPandas(submatrix, "lang string, g long, other long, value long")
    sums = found.groupBy("lang", "g", "other").agg(F.sum("value").alias("value"))
    names = groups.select("lang", "g", "source")
    named = sums.join(names, ["lang", "g"]).join(names.select("lang", F.col("g").alias("other"), F.col("source").alias("item")), ["lang", "other"])
    return ranked(named.select("lang", "source", F.lit("pair").alias("part"), "item", "value"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


#: All terms of all pairs of sources, in 128-bit integers.
OP11_SQL = rf"""
with d as materialized (select row_number() over () k, coalesce(lang, '') lang, coalesce(source, '') source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') w from documents),
t as materialized (select k, lang, source, term, count(*) n from (select k, lang, source, unnest(w) term from d) group by all),
v as materialized (select lang, term, sum(n)::hugeint n from t group by all having count(*) >= {LEAST_DOCUMENTS}),
l as (select lang, count(*) v, sum(n) total from v group by lang),
g as materialized (select distinct lang, source from d),
c as materialized (select lang, source, term, sum(t.n)::hugeint n from t join v using (lang, term) group by all),
gt as (select lang, source, sum(n) total from c group by all),
p as materialized (select g.lang, g.source, v.term, coalesce(c.n, 0) n, 1 + ({SCALE}::hugeint * (coalesce(c.n, 0) + 1)) // (coalesce(gt.total, 0) + l.v) p, 1 + ({SCALE}::hugeint * (v.n + 1)) // (l.total + l.v) q
  from g join v using (lang) join l using (lang) left join gt using (lang, source) left join c on c.lang = g.lang and c.source = g.source and c.term = v.term),
pr as (select a.lang, a.source, 'pair' part, b.source item, coalesce(s.value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source
  left join (select x.lang, x.source a, y.source b, sum((x.p - y.p) * (x.p - y.p) // y.p) as value from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all) s on s.lang = a.lang and s.a = a.source and s.b = b.source),
te as (select lang, source, 'term' part, term item, (p - q) * (p - q) // q as value from p where n > 0 and p > q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, item) rank from (select * from pr union all select * from te))
select lang, source, part, item, value::bigint as value, rank::int rank from r where part = 'pair' or rank <= {MOST_TERMS}
"""
