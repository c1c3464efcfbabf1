"""Mixing sources to target weights with a low-discrepancy schedule.  DataFrame functions only.

Each source's documents, shuffled by hash, form one stream of words, run through at most MOST_LAPS times and cut
into blocks of equal length.  Golden-ratio points, mapped through the sources' cumulative numbers of blocks, say which
source each slot of the schedule serves; the k-th slot of a source takes its k-th block, and what no slot takes isn't
taken.  The schedule runs until every source has all blocks of its target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Stored, hash60, table, word_count

MOST_LAPS = 2
SHARE = 1.5
WEIGHTS = (3, 1, 2)
BLOCK = 1024
#: Hash ranges that a source's stream is laid out in, slots that are ranked together, and cells of the unit interval.
CHUNKS, SLOT_CHUNK, CELLS = 4096, 65_536, 1024
CHUNK_BITS = 60 - (CHUNKS.bit_length() - 1)
#: The points are j * STEP mod GRID, all in 64-bit integers: STEP is GRID over the golden ratio.
GRID = 2_147_483_647
STEP = 1_327_217_884
#: Slots for each block of all sources: so many points leave no gap as wide as one block's part of the interval, so each
#: source, which holds one part a block, is served as often as it has blocks.
ROUNDS = 3


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, laps: int = MOST_LAPS) -> DataFrame:
    """(source, src, source_size, target, quota) from rows (source, size).

    Sources by code point, null last, get the weights in turn.  `share` of all sizes is divided by weight; a target stops
    at `laps` times its source's size and the excess is divided again among the others until none is above.  That
    fixed point is target = min(cap, level * weight): with sources in the order of cap / weight, level is the
    greatest of (goal - caps before) / (weights from here on).  The windows run over one row a source.
    """
    sums = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sums.withColumn("src", (F.row_number().over(by_name) - 1).cast("int"))
    ranked = ranked.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.col("src") % len(weights) + 1).cast("double"))
    ranked = ranked.withColumn("cap", (F.col("source_size") * laps).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("w"), "src")
    whole = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    goal = F.least(F.sum("source_size").over(whole) * F.lit(float(share)), F.sum("cap").over(whole))
    levels = ranked.withColumn("level", (goal - before) / onward)
    levels = levels.withColumn("level", F.max("level").over(whole))
    out = levels.withColumn("target", F.least("cap", F.col("level") * F.col("w")))
    return out.select("source", "src", "source_size", "target", F.least(F.round("target").cast("long"), (F.col("source_size") * laps)).alias("quota"))


def schedule(sources: DataFrame, slots: int, block: int = BLOCK, step: int = STEP) -> DataFrame:
    """(src, nth, slot): which slot serves the nth block of a source, for all that so many points reach.

    Each source holds the part of the unit interval that its blocks are of all blocks.  Point and source meet by an
    equality on the cell of the interval, of which every source covers as many as it is long, and a range check.
    Slots of a source are ranked within chunks of the schedule and moved on by the counts before.
    """
    total = F.sum("blocks").over(Window.partitionBy())
    upto = F.sum("blocks").over(Window.orderBy("src"))
    width = -(-GRID // CELLS)
    spans = (
        sources.where("quota > 0")
        .select("src", F.ceil(F.col("quota") / block).alias("blocks"))
        .select("src", "blocks", F.floor((upto - F.col("blocks")) / total * GRID).cast("long").alias("lo"), F.floor(upto / total * GRID).cast("long").alias("hi"))
        .where("hi > lo")
        .withColumn("cell", F.explode(F.expr(f"sequence(lo div {width}, (hi - 1) div {width})")))
    )
    points = sources.sparkSession.range(slots).select(F.col("id").alias("slot"), ((F.col("id") % GRID) * step % GRID).alias("u")).withColumn("cell", F.expr(f"u div {width}"))
    served = points.join(spans, "cell").where("u >= lo and u < hi").select("src", "slot", "blocks", F.expr(f"slot div {SLOT_CHUNK}").alias("part"))
    before = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = served.groupBy("src", "part").count().select("src", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("src", "part").orderBy("slot")
    ranked = served.withColumn("row", F.row_number().over(within)).join(counts, ["src", "part"])
    return ranked.withColumn("nth", F.col("before") + F.col("row") - 1).where("nth < blocks").select("src", "nth", "slot")


def streams(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Each row's place in its source's shuffled stream: (id, size, src, part, row, at, source_size, target, quota).

    The order is that of a hash of the id; (src, part, row) is a row's own key, repeated rows included.
    """
    hashed = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).select("id", "size", "src", "source_size", "target", "quota", hash60("id").alias("h"))
    hashed = hashed.withColumn("part", F.shiftright("h", CHUNK_BITS).cast("int"))
    before = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = hashed.groupBy("src", "part").agg(F.sum("size").alias("words")).select("src", "part", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("src", "part").orderBy("h", "id", "size")
    placed = hashed.withColumns({"row": F.row_number().over(within), "inner": F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    return placed.join(sums, ["src", "part"]).withColumn("at", F.col("before") + F.col("inner")).drop("h", "before", "inner")


def mix(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, block: int = BLOCK, laps: int = MOST_LAPS, slots: int | None = None, step: int = STEP) -> DataFrame:
    """(id_col, size, source_size, target, taken, laps_begun, first_slot, lap_slots) for every row.

    size is the number of words, null texts having none; taken the words that slots of the schedule take of the row,
    repeats counted; laps_begun in how many laps its first word is taken, lap_slots by which slots, and where in the stream; first_slot the first
    slot that takes any of it (null: none).  A source's taken words are its target to the nearest word, its last block being cut,
    unless the schedule is cut to fewer `slots`.  Rows without words take part with taken = 0; repeated rows each
    have their own place; an empty table gives an empty result.  More blocks than the grid of points can tell apart are an
    error: take longer ones.
    """
    sized = Stored(rows.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size")), "sizes").read()
    sources = Stored(targets(sized, weights, share, laps), "targets").read()
    blocks = int(sources.agg(F.sum(F.ceil(F.col("quota") / block))).first()[0] or 0)
    if blocks * ROUNDS > GRID:
        raise ValueError(f"{blocks} blocks are more than a schedule tells apart; take blocks longer than {block}")
    served = schedule(sources, ROUNDS * blocks if slots is None else slots, block, step)
    placed = streams(sized, sources)
    lap = F.explode(F.sequence(F.lit(0), F.lit(laps - 1)))
    spans = placed.where("size > 0").select("src", "part", "row", "at", "size", "quota", "source_size", lap.alias("lap"))
    spans = spans.withColumns({"from": F.col("at") + F.col("lap") * F.col("source_size")}).where("from < quota")
    spans = spans.withColumn("to", F.least(F.col("from") + F.col("size"), "quota"))
    spans = spans.withColumn("nth", F.explode(F.expr(f"sequence(from div {block}, (to - 1) div {block})")))
    words = F.least(F.col("to"), (F.col("nth") + 1) * block) - F.greatest(F.col("from"), F.col("nth") * block)
    begun = (F.expr(f"from div {block}") == F.col("nth")).cast("int")
    pieces = spans.select("src", "part", "row", "nth", words.alias("words"), begun.alias("begun"), "from")
    begun_at = F.array_sort(F.collect_list(F.when(F.col("begun") == 1, F.struct("slot", F.col("from").alias("at")))))
    taken = pieces.join(served, ["src", "nth"]).groupBy("src", "part", "row").agg(F.sum("words").alias("taken"), F.sum("begun").alias("laps_begun"), F.min("slot").alias("first_slot"), begun_at.alias("lap_slots"))
    out = placed.join(taken, ["src", "part", "row"], "left")
    zero = F.lit(0).cast("long")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", zero).alias("taken"), F.coalesce("laps_begun", zero).alias("laps_begun"), "first_slot", "lap_slots")


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("lap_slots")


#: The same in whole windows, for small tables.
OP6_SQL = f"""
with d as materialized (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) size, ('0x' || substr(md5(case when doc_id is null then 'n' else 'v' || doc_id end), 1, 15))::bigint h from documents),
s0 as (select source, sum(size)::bigint source_size from d group by source),
s1 as (select *, row_number() over (order by source nulls last) - 1 src from s0),
s2 as (select *, [{", ".join(map(str, WEIGHTS))}][src % {len(WEIGHTS)} + 1]::double w, source_size * {MOST_LAPS}::double cap from s1),
s3 as (select *, (least((sum(source_size) over ())::double * {SHARE}, sum(cap) over ()) - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0)) / sum(w) over (o rows between current row and unbounded following) l from s2 window o as (order by cap / w, src)),
s4 as (select source, src, source_size, least(cap, max(l) over () * w) target from s3),
s5 as materialized (select *, least(round(target)::bigint, source_size * {MOST_LAPS}) quota from s4),
n as (select {ROUNDS} * sum(ceil(quota / {BLOCK}))::bigint slots from s5),
q as (select src, ceil(quota / {BLOCK})::bigint blocks from s5 where quota > 0),
spans as (select src, blocks, floor((sum(blocks) over (order by src) - blocks) / sum(blocks) over () * {GRID})::bigint lo, floor(sum(blocks) over (order by src) / sum(blocks) over () * {GRID})::bigint hi from q),
points as (select slot, slot % {GRID} * {STEP} % {GRID} u from (select unnest(range(0, slots)) slot from n)),
served as (select src, slot, row_number() over (partition by src order by slot) - 1 nth from points join spans on u >= lo and u < hi),
st as materialized (select row_number() over () key, d.doc_id, d.size, src, source_size, target, quota, sum(d.size) over (partition by src order by h, doc_id, d.size rows between unbounded preceding and current row)::bigint - d.size pos from d join s5 on d.source is not distinct from s5.source),
sp as (select key, src, pos + lap * source_size f, least(pos + lap * source_size + size, quota) t from st, (select unnest(range(0, {MOST_LAPS})) lap) where size > 0 and pos + lap * source_size < quota),
bl as (select key, src, f, t, unnest(range(f // {BLOCK}, (t - 1) // {BLOCK} + 1)) nth from sp),
tk as (select key, sum(least(t, (nth + 1) * {BLOCK}) - greatest(f, nth * {BLOCK})) taken, count(case when f // {BLOCK} = nth then 1 end) laps_begun, min(slot) first_slot from bl join served using (src, nth) group by key)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint taken, coalesce(laps_begun, 0)::bigint laps_begun, first_slot from st left join tk using (key)
"""
