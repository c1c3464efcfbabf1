"""Jaccard join of word n-gram sets by PartEnum signatures, and the groups that its links form.

Sets fall into bands of similar size.  Two linked sets of a band differ in at most k elements, so when the
elements' domain is cut into n1 groups of n2 parts, they agree on n2 - k2 whole parts of some group that holds at
most k2 of the differences: every such subset of parts is a signature, and linked sets share one.  Candidates are
checked on the sets themselves.

Groups are found without listing the pairs of a signature: see Linker.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stored, map_arrow, table

GROWTH = 1.5
#: Members and bytes of sets in a block of a family, which two of are one task's work.
BLOCK_MEMBERS, BLOCK_BYTES = 2048, 32_000_000
#: Most candidate rows that are sent to all tasks to pick their texts; beyond it the texts are shuffled.
MOST_SENT = 250_000
#: Signatures of at most PAIRED nodes of a large family are taken apart into pairs.
PAIRED = 64
#: 64-bit words of a set's sketch.
SKETCH = 16
SEEDS = 4
#: One set in SAMPLE is looked at for hot signatures, which HOT_IN_SAMPLE of these share; the MOST_HOT hottest are sent to all tasks.
SAMPLE, HOT_IN_SAMPLE, MOST_HOT = 64, 16, 100_000
MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Band:
    """One instance of the join: sets of sizes low to high are compared with each other and with larger linked ones."""

    index: int
    low: int
    high: int
    most: int  # differing elements of a linked pair
    groups: int
    parts: int
    spared: int  # k2: parts of the lucky group that may differ

    @property
    def lucky(self) -> int:
        """Groups of any linked pair that hold at most `spared` differences."""
        return self.groups - self.most // (self.spared + 1)


@lru_cache(maxsize=None)
def band(index: int, percent: int) -> Band:
    low = 1
    for _ in range(index):
        low = max(low + 1, int(low * GROWTH))
    high = max(low + 1, int(low * GROWTH)) - 1
    most = (100 - percent) * (high + high * 100 // percent) // (100 + percent)
    if most == 0:
        return Band(index, low, high, 0, 1, 1, 0)
    if most <= 3:
        return Band(index, low, high, most, 1, most + 2, most)
    return Band(index, low, high, most, most // 2 + 3 + most // 10, 3, 1)


def bands_of(n: int, percent: int) -> list[Band]:
    """Every band that a set of n elements takes part in: its own, and lower ones with sets that it can be linked to."""
    i = 0
    while band(i, percent).high < n:
        i += 1
    out = [band(i, percent)]
    while i and percent * n <= 100 * band(i - 1, percent).high:
        i -= 1
        out.append(band(i, percent))
    return out


def mixed(values: np.ndarray, seed: int) -> np.ndarray:
    x = values ^ np.uint64((seed + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
    x = (x ^ x >> np.uint64(32)) * MIX
    return (x ^ x >> np.uint64(29)) * MIX2


def band_signatures(elements: np.ndarray, b: Band, seed: int) -> tuple[np.ndarray, int]:
    """The signatures of one band, without those of no element; and how many of them a linked set shares at least, under 1 if perhaps none."""
    values = np.sort(mixed(elements, seed))
    cells = b.groups * b.parts
    cell = (values >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32)  # rises with the value
    edge = np.searchsorted(cell, np.arange(cells + 1, dtype=np.uint64))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values ^ values >> np.uint64(31)) * MIX, out=total[1:])
    sums = (total[edge[1:]] - total[edge[:-1]]).reshape(b.groups, b.parts)
    sizes = np.diff(edge).reshape(b.groups, b.parts)
    tag = np.uint64((b.index * SEEDS + seed) * 1_000_003)
    if b.parts == 1:
        some = np.flatnonzero(sizes[:, 0])
        found = mixed(sums[some, 0] + some.astype(np.uint64) * MIX2 + tag, 7)
    else:
        kept = []
        for j, chosen in enumerate(combinations(range(b.parts), b.parts - b.spared)):
            columns = list(chosen)
            some = np.flatnonzero(sizes[:, columns].sum(1))
            weight = np.array([(2 * c + 3) for c in columns], np.uint64) * MIX2
            joined = (mixed(sums[np.ix_(some, columns)], 9) * weight).sum(1, dtype=np.uint64)
            kept.append(mixed(joined + (some.astype(np.uint64) * np.uint64(comb(b.parts, b.spared)) + np.uint64(j)) * MIX2 + tag, 7))
        found = np.concatenate(kept)
    return found, b.lucky - int(((sizes == 0).sum(1) >= b.parts - b.spared).sum())


def signatures(elements: np.ndarray, percent: int, first_seed: int = 0) -> tuple[np.ndarray, int]:
    """All signatures of a non-empty set of 64-bit elements, and how many of them any linked set shares at least.

    A part without elements says nothing, so it gives none.  A linked pair agrees in every lucky group, so it shares a
    signature for each that isn't bare.  Where a set has so many bare groups that a linked set might agree with it
    on those alone, the same holds for that other set, and both give the signatures of the next seed too; at the
    last seed bare groups count as well, by the set's own band.
    """
    out, need = [], len(elements) + 1
    for b in bands_of(len(elements), percent):
        for seed in range(first_seed, first_seed + SEEDS):
            found, sure = band_signatures(elements, b, seed)
            out.append(found)
            need = min(need, max(sure, 1))
            if sure > 0:
                break
        else:
            out.append(np.array([b.index + 1], np.uint64) * MIX)
    # 48 bits are enough to tell signatures apart, as what shares one is checked, and cost a quarter less to ship.
    return np.unique(np.concatenate(out) >> np.uint64(16)).view(np.int64), need


class Words(dict):
    """Word -> 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 150_000:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


def shingles(text: str | None, width: int, words: Words) -> np.ndarray:
    """The distinct n-grams of a text as sorted 64-bit hashes; with fewer words than `width`, all of them as one; none without words.

    bytes.lower and bytes.split treat exactly A-Z and the blanks x20 and x09 to x0D.
    """
    split = (text or "").encode().lower().split()
    if not split:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, split), np.uint64, len(split))
    span = min(width, len(split))
    n = len(h) - span + 1
    out = np.full(n, span, np.uint64)
    for i in range(span):
        out = (out ^ h[i : i + n]) * MIX
        out ^= out >> np.uint64(32)
    return np.unique(out)


def fingerprint(elements: np.ndarray) -> int:
    """A set's node: 64 bits of a digest of its elements."""
    return int.from_bytes(hashlib.blake2b(elements.tobytes(), digest_size=8).digest(), "little", signed=True)


def signed_sets(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """(id, h, n, node, need, sigs), h the text's hash: a set's signatures, and how many of them a linked set shares at least, come with its first row of each task only, so copies add few."""
    kind = dict(docs.dtypes)[id_col]

    def make():
        words, seen = Words(), set()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, nodes, sigs, needs = [], [], [], []
            for x in batch.column(2):
                s = shingles(x.as_py(), width, words)
                n.append(len(s))
                node = fingerprint(s) if len(s) else None
                nodes.append(node)
                if node is None or node in seen:
                    sigs.append(None)
                    needs.append(None)
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(node)
                found, need = signatures(s, percent)
                sigs.append(found)
                needs.append(need)
            flat = np.concatenate([s for s in sigs if s is not None] or [np.zeros(0, np.int64)])
            offsets = np.concatenate(([0], np.cumsum([0 if s is None else len(s) for s in sigs]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.array(needs, pa.int32()), lists], ["id", "h", "n", "node", "need", "sigs"])

        return each

    return map_arrow(docs.select(id_col, F.xxhash64(text_col).alias("h"), text_col), make, f"id {kind}, h long, n long, node long, need int, sigs array<long>")


def sketch(elements: np.ndarray) -> np.ndarray:
    """The parity of the number of elements in each of 64 * SKETCH parts of their domain: two sets differ in at least as many elements as their sketches in bits."""
    part = (elements >> np.uint64(32)) * np.uint64(64 * SKETCH) >> np.uint64(32)
    odd = np.bincount(part.astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def node_sets(docs: DataFrame, width: int) -> DataFrame:
    """(node, items binary, sketch): the sets behind rows of (text, node), a node once a task."""

    def make():
        words, seen = Words(), set()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            nodes, items, sketches = [], [], [np.zeros(0, np.int64)]
            for x, node in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if node in seen:
                    continue
                s = shingles(x.as_py(), width, words)
                if fingerprint(s) == node:
                    seen.add(node)
                    nodes.append(node)
                    items.append(s.tobytes())
                    sketches.append(sketch(s))
            offsets = pa.array(np.arange(len(nodes) + 1, dtype=np.int32) * SKETCH)
            bits = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sketches)))
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(items, pa.binary()), bits], ["node", "items", "sketch"])

        return each

    return map_arrow(docs, make, "node long, items binary, sketch array<long>")


def components(edges: DataFrame, most_rounds: int = 60) -> Stored:
    """(u, v): v is the least node of u's component, for nodes with edges but the least ones themselves.

    Near copies name several hubs each, so first every node moves into its least neighbour, if that is less than
    itself, and edges follow, by one end and then by the other.  Most then have both ends in one node and go, with
    the nodes that have moved; the rounds see the rest only.
    """
    first = Stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    moves = Stored(first.read().groupBy("u").agg(F.min("v").alias("to")), "moves").read()
    ends = first.read().join(moves, "u").select(F.col("to").alias("a"), "v").distinct()
    ends = ends.join(moves.select(F.col("u").alias("v"), F.col("to").alias("v_to")), "v", "left").select("a", F.coalesce("v_to", "v").alias("b"))
    rest = stars(ends, most_rounds).read()
    first.drop()
    after = rest.select(F.col("u").alias("to"), F.col("v").alias("least"))
    moved = moves.join(after, "to", "left").select("u", F.coalesce("least", "to").alias("v"))
    return Stored(moved.unionByName(rest.join(moves, "u", "left_anti")), "labels")


def stars(edges: DataFrame, most_rounds: int) -> Stored:
    """What components returns, by alternate large and small stars, which take a logarithm of rounds.

    Least neighbours are partial sums, and the joins that bring them back have one row a node on one side, so a node
    with very many edges is split over tasks.
    """
    current = Stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "stars")
    state = None
    for _ in range(most_rounds):
        e = current.read()
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = Stored(small, "stars")
        told = after.read().agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        current.drop()
        current = after
        if told == state:
            return current
        state = told
    raise RuntimeError(f"components did not settle within {most_rounds} rounds")


def hot_signatures(signed: DataFrame) -> Stored:
    """Signatures of very many sets, found in a sample of sets: a choice of path only, as all their rows are kept either way.

    A signature that several sets of the sample share is shared for certain, so its rows needn't be gathered to see
    that, and no task gets them all.
    """
    sample = signed.where(f"sigs is not null and pmod(xxhash64(node), {SAMPLE}) = 0").select(F.explode("sigs").alias("sig"), "node")
    often = sample.groupBy("sig").agg(F.countDistinct("node").alias("k")).where(F.col("k") >= HOT_IN_SAMPLE)
    return Stored(often.orderBy(F.desc("k"), "sig").limit(MOST_HOT).select("sig"), "hot")


def hubs(members: DataFrame) -> DataFrame:
    """(sig, hub, last): the least and greatest node of each signature, as partial sums."""
    return members.groupBy("sig").agg(F.min("node").alias("hub"), F.max("node").alias("last"))


class Linker:
    """Finds the links among nodes that share signatures.

    Nodes that share signatures, directly or by others, are a family.  Passages that many texts quote chain texts that
    aren't alike, more of them the larger the table, so large families are first taken apart into those that pairs
    of nodes that may be linked form: see refined.  A family is dealt into blocks, and the nodes
    of a block are compared in one task by a product of incidence matrices, so no pair becomes a row.  A family of
    one block is done with that.  In larger ones each block also gets the family's hub, the node that shares most
    signatures, so near copies of one text become one group of linked nodes, the core, which is then left alone:
    only the rest is compared, block by block, with itself and with the core.
    """

    def __init__(self, members: DataFrame, shared: DataFrame, by_node: DataFrame, texts: DataFrame, width: int, percent: int):
        """`members` has (node, hub), `shared` (sig, node), `by_node` the size `n`, the `need` and one row (id, h) behind each node, `texts` (id, h, text)."""
        self.members, self.shared, self.by_node, self.texts, self.width, self.percent = members, shared, by_node, texts, width, percent

    def resolve(self) -> DataFrame | None:
        """(a, b): links that join all that is joined, not each of them; None where no signature is shared."""
        if self.members.isEmpty():
            return None
        loose = components(self.members.select(F.col("hub").alias("a"), F.col("node").alias("b")))
        named = loose.read().select(F.col("u").alias("node"), F.col("v").alias("family"))
        named = named.unionByName(named.select(F.col("family").alias("node"), "family").distinct())
        shares = self.members.groupBy("node").agg(F.count("*").alias("shares"))
        nodes = named.join(shares, "node").join(self.by_node.select("node", "id", "h", "n", "need", (F.col("n") * 8).alias("bytes")), "node")
        nodes = Stored(nodes, "families").read()
        self.sets = self.fetched(nodes.select("id", "h", "node"))
        many = nodes.groupBy("family").agg(blocks_of(F.count("*"), F.sum("bytes")).alias("blocks")).where("blocks > 1").select("family")
        if not many.isEmpty():
            large = Stored(nodes.join(many, "family", "left_semi"), "many").read()
            families = self.refined(large).withColumnRenamed("label", "family")
            nodes = Stored(nodes.join(many, "family", "left_anti").unionByName(large.drop("family").join(families, "node")), "families").read()
        deal = nodes.groupBy("family").agg(blocks_of(F.count("*"), F.sum("bytes")).alias("blocks"), F.max(F.struct("shares", "node")).alias("top"))
        deal = Stored(deal.select("family", "blocks", F.col("top.node").alias("hub")), "deal").read()
        dealt = nodes.join(deal, "family").select("node", "family", "blocks", (F.col("node") == F.col("hub")).alias("is_hub"))
        own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        home = dealt.join(self.sets.select("node", "items"), "node").withColumn("own", F.explode(F.when(F.col("is_hub"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))))
        edges = self.compared(home.select("family", F.col("own").alias("i"), F.col("own").alias("j"), "own", "node", F.col("node").alias("label"), "items"))
        large = deal.where("blocks > 1").select("family")
        if large.isEmpty():
            return edges
        labels = components(edges).read().select(F.col("u").alias("node"), F.col("v").alias("label"))
        rest = nodes.join(large, "family", "left_semi").join(labels, "node", "left").select("family", "node", F.coalesce("label", "node").alias("label"), "bytes")
        return edges.unionByName(self.compare_blocks(Stored(rest, "large").read()))

    def refined(self, nodes: DataFrame) -> DataFrame:
        """(node, label): the families that pairs which may be linked form among nodes of large families.

        Signatures of few nodes are taken apart into pairs, and a pair's are counted.  Signatures of many (hot) aren't: a
        pair shares at most as many of them as either node has.  So a linked pair is among the counted ones, with as
        many as both need, or it shares hot ones alone, as many as both need, and all nodes that have so many stay together.
        A counted pair also has sizes and sketches that a linked one may have.
        """
        rows = self.shared.join(nodes.select("node"), "node", "left_semi")
        often = rows.groupBy("sig").agg(F.count("*").alias("k")).where("k > 1")
        rows = Stored(rows.join(often, "sig"), "rows_of_large").read()
        hot = rows.where(F.col("k") > PAIRED).select("sig", "node")
        had = hot.groupBy("node").agg(F.count("*").alias("hot"))
        info = nodes.select("node", "n", "need").join(had, "node", "left").select("node", "n", "need", F.coalesce("hot", F.lit(0)).alias("hot"))
        info = Stored(info.join(self.sets.select("node", "sketch"), "node"), "info").read()
        lists = rows.where(F.col("k") <= PAIRED).groupBy("sig").agg(F.array_sort(F.collect_list("node")).alias("all"))
        pairs = lists.select("all", F.explode("all").alias("a")).select("a", F.explode(F.expr("filter(all, x -> x > a)")).alias("b"))
        pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("common"))
        for end in ("a", "b"):
            pairs = pairs.join(info.select(F.col("node").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in ("n", "need", "hot", "sketch"))), end)
        apart = "aggregate(zip_with(sketch_a, sketch_b, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
        may = f"common + least(hot_a, hot_b) >= greatest(need_a, need_b) and 100 * least(n_a, n_b) >= {self.percent} * greatest(n_a, n_b) and {100 + self.percent} * {apart} <= {100 - self.percent} * (n_a + n_b)"
        hot = hot.join(info.where("hot >= need").select("node"), "node", "left_semi")
        stars = hot.join(hot.groupBy("sig").agg(F.min("node").alias("hub")), "sig").select(F.col("hub").alias("a"), F.col("node").alias("b"))
        labels = components(pairs.where(may).select("a", "b").unionByName(stars)).read().select(F.col("u").alias("node"), F.col("v").alias("label"))
        return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())

    def fetched(self, wanted: DataFrame) -> DataFrame:
        """(node, items, sketch) of rows (id, h, node).

        A node is found again by the id and the text's hash of one of its rows.  Only where rows repeat in both can a
        node come from several tasks, and is made one by a shuffle.
        """
        t, w = self.texts.alias("t"), (F.broadcast(wanted) if wanted.count() <= MOST_SENT else wanted).alias("w")
        found = t.join(w, (F.col("t.h") == F.col("w.h")) & F.col("t.id").eqNullSafe(F.col("w.id")))
        sets = Stored(node_sets(found.select("t.text", "w.node"), self.width), "sets").read()
        if sets.groupBy("node").agg(F.count("*").alias("k")).where("k > 1").isEmpty():
            return sets
        return Stored(sets.dropDuplicates(["node"]), "sets").read()

    def compared(self, keyed: DataFrame) -> DataFrame:
        """The links within each (family, i, j)."""
        percent = self.percent
        found = keyed.groupBy("family", "i", "j").applyInPandas(lambda pdf: block_links(pdf, percent), "a long, b long")
        return Stored(found, "links").read()

    def compare_blocks(self, nodes: DataFrame) -> DataFrame:
        """Links of large families' nodes outside of their cores with all others."""
        core = nodes.groupBy("family", "label").agg(F.count("*").alias("k")).groupBy("family").agg(F.max(F.struct("k", "label")).alias("top")).select("family", F.col("top.label").alias("core"))
        parts = nodes.join(core, "family").withColumn("is_core", F.col("label") == F.col("core"))
        many = parts.groupBy("family", "is_core").agg(blocks_of(F.count("*"), F.sum("bytes")).alias("blocks"))
        many = many.groupBy("family").agg(F.coalesce(F.max(F.when(F.col("is_core"), F.col("blocks"))), F.lit(0)).alias("core_blocks"), F.coalesce(F.max(F.when(~F.col("is_core"), F.col("blocks"))), F.lit(0)).alias("rest_blocks"))
        # Blocks of the rest have the numbers from 0; those of the core come behind and meet the rest only.
        dealt = parts.join(many, "family").where("rest_blocks > 0")
        own = F.when(F.col("is_core"), F.col("rest_blocks") + F.pmod(F.xxhash64("node"), F.greatest("core_blocks", F.lit(1)))).otherwise(F.pmod(F.xxhash64("node"), F.col("rest_blocks"))).cast("int")
        others = F.when(F.col("is_core"), F.sequence(F.lit(0), F.col("rest_blocks") - 1)).otherwise(F.sequence(F.lit(0), F.col("rest_blocks") + F.col("core_blocks") - 1))
        dealt = dealt.withColumn("own", own).withColumn("other", F.explode(others))
        return self.compared(dealt.select("family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "label").join(self.sets.select("node", "items"), "node"))


def blocks_of(members, size):
    return F.greatest(F.ceil(members / BLOCK_MEMBERS), F.ceil(size / BLOCK_BYTES)).cast("int")


def block_links(pdf, percent: int):
    """Edges that join the labels of linked members of two blocks (or of one with itself)."""
    import pandas as pd

    sets = [np.frombuffer(x, np.uint64) for x in pdf["items"]]
    nodes, own = pdf["node"].to_numpy(), pdf["own"].to_numpy()
    first = np.flatnonzero(own == pdf["i"].iloc[0])
    second = np.flatnonzero(own == pdf["j"].iloc[0])
    names, label = np.unique(pdf["label"].to_numpy(), return_inverse=True)
    parent = list(range(len(names)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    sizes = np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    values, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = counts > 1  # what only one set holds can't be common
    column = np.cumsum(shared) - 1
    row = np.repeat(np.arange(len(sets)), sizes)
    keep = shared[inverse]
    row, column = row[keep], column[inverse[keep]]
    common = np.zeros((len(first), len(second)), np.float32)
    at_first, at_second = np.full(len(sets), -1), np.full(len(sets), -1)
    at_first[first], at_second[second] = np.arange(len(first)), np.arange(len(second))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    step = 2048
    for lo in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(column, (lo, lo + step))
        r, c = row[a:b], column[a:b] - lo
        x, y = np.zeros((len(first), step), np.float32), np.zeros((len(second), step), np.float32)
        f, g = at_first[r], at_second[r]
        x[f[f >= 0], c[f >= 0]] = 1
        y[g[g >= 0], c[g >= 0]] = 1
        common += x @ y.T
    union = sizes[first][:, None] + sizes[second][None, :] - common
    found = (100 * common >= percent * union) & (label[first][:, None] != label[second][None, :])
    out = []
    for p, q in zip(*np.nonzero(found), strict=True):
        x, y = root(label[first[p]]), root(label[second[q]])
        if x != y:
            parent[x] = y
            a, b = int(nodes[first[p]]), int(nodes[second[q]])
            out.append((min(a, b), max(a, b)))
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """(id_col, n_shingles, component_id) for every row: the least id reachable by links, its own included.

    Two documents are linked when percent * (their n-gram sets' union) <= 100 * intersection.  Texts without words and null
    texts have the empty set and are linked with nothing.  Equal sets are one node and are never compared.  A row
    whose id is null belongs to its set's component; without any id there, component_id is null.  Rows that share an
    id but not a text are documents of their own.  Sets are told apart by 64-bit hashes of their words, n-grams and
    whole.
    """
    signed = Stored(signed_sets(docs, id_col, text_col, width, percent), "signed")
    exploded = signed.read().where("sigs is not null").select(F.explode("sigs").alias("sig"), "node")
    hot = F.broadcast(hot_signatures(signed.read()).read())
    of = Window.partitionBy("sig")
    usual = exploded.join(hot, "sig", "left_anti").withColumns({"x": F.min("node").over(of), "y": F.max("node").over(of)}).where("x < y")
    shared = usual.select("sig", "node").unionByName(exploded.join(hot, "sig", "left_semi")).distinct()
    sharing = Stored(shared, "sharing")
    rows = Stored(signed.read().select("id", "h", "n", "node", "need"), "rows")
    signed.drop()
    one = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h"))  # a row with an id, where there is one
    by_node = rows.read().where("node is not null").groupBy("node").agg(one.alias("one"), F.max("need").alias("need"), F.max("n").alias("n"))
    by_node = Stored(by_node.select("node", "need", "n", "one.id", "one.h"), "nodes").read()
    # A linked pair shares `need` signatures of either; what shares fewer with all others together has no link.
    enough = sharing.read().groupBy("node").agg(F.count("*").alias("k")).join(by_node, "node").where("k >= need").select("node")
    left = Stored(sharing.read().join(enough, "node", "left_semi"), "left").read()
    members = Stored(left.join(hubs(left).where("hub < last"), "sig").select("node", "hub"), "members")
    sharing.drop()
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    edges = Linker(members.read(), left, by_node, texts, width, percent).resolve()
    if edges is None:
        node_ids = by_node.select("node", F.col("node").alias("label"), F.col("id").alias("least"))
    else:
        labels = components(edges).read().select(F.col("u").alias("node"), F.col("v").alias("label"))
        node_ids = by_node.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), F.col("id").alias("least"))
    component = node_ids.groupBy("label").agg(F.min("least").alias("component_id"))
    of_node = Stored(node_ids.join(component, "label").select("node", "component_id"), "components").read()
    out = rows.read().join(of_node, "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def op3_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))


#: All pairs that share an n-gram, for small tables.
OP3_SQL = """
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w from documents),
g as (select distinct doc_id, unnest(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else []::varchar[] end) s from w),
n as materialized (select w.doc_id, count(g.s) n from w left join g using (doc_id) group by 1),
p as materialized (select a.doc_id a, b.doc_id b, count(*) c from g a join g b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
l as materialized (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
e as materialized (select a, b from l union all select b, a from l),
r as (select doc_id, doc_id label from n union select e.b, r.label from r join e on e.a = r.doc_id and r.label < e.b)
select n.doc_id, n.n n_shingles, min(r.label) component_id from n join r using (doc_id) group by 1, 2
"""
