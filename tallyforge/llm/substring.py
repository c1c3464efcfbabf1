"""Substring dedup: repeated windows of words, found by Rabin-Karp hashes and merged into maximal removal intervals.

Every window of `width` consecutive words is hashed twice as it rolls: 64 bits that sort it and 16 that check it.  The
windows of a group of texts are sorted and counted there first, so each group ships a window once, for the least of
its documents; all others of the group are repeats already.  What is shipped lies in hash ranges, as differences of
sorted hashes in byte planes, which shuffle in about half of the bytes that rows would take.  The least
document of a window over all groups keeps it.  Each document is told the hashes of its repeats, and rolls over its words
once more to turn them into intervals.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge import ship

from .common import Stored, pieces, table, trim

WIDTH = 13
#: Windows that a task sorts at once, bytes of text that it splits at once, and hash ranges for each shuffle partition.
GROUP, SPLIT, RANGES = 1 << 20, 1 << 20, 4
#: The two bases and the odd number that spreads the results; all arithmetic is modulo 2^64.
BASE, CHECK_BASE, SPREAD = 0x9E3779B97F4A7C1B, 0xC2B2AE3D27D4EB53, np.uint64(0xD6E8FEB86659FD93)
BLANK = re.compile(rb"[\x20\x09-\x0D]")


class Vocabulary(dict):
    """Word -> its row in two columns of 64-bit hashes; forgotten between texts once it is large."""

    MOST = 400_000

    def __init__(self):
        self.clear_all()

    def clear_all(self) -> None:
        self.clear()
        self.columns = np.zeros((2, 1024), np.uint64)

    def __missing__(self, word: bytes) -> int:
        import xxhash

        at = len(self)
        if at == self.columns.shape[1]:
            self.columns = np.concatenate((self.columns, np.zeros_like(self.columns)), axis=1)
        both = xxhash.xxh3_128_intdigest(word)
        self.columns[:, at] = both >> 64, both & (1 << 64) - 1
        self[word] = at
        return at

    def rows(self, text: str | None) -> np.ndarray:
        """The rows of a text's words, split SPLIT bytes at a time (bytes.split knows exactly the blanks x20 and x09 to x0D)."""
        if len(self) > self.MOST:
            self.clear_all()
        body, parts, at = (text or "").encode(), [], 0
        while at < len(body):
            end = at + SPLIT
            if end < len(body):
                found = BLANK.search(body, end)
                end = found.start() if found else len(body)
            words = body[at:end].split()
            parts.append(np.fromiter(map(self.__getitem__, words), np.int64, len(words)))
            at = end
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (1 << 64) - 1, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def rolled(words: np.ndarray, width: int, base: int) -> np.ndarray:
    """The Rabin-Karp hash of every window: sum of word[i + k] * base^(width - 1 - k).

    Sums of word[i] * base^-i up to each place give a window as the difference of two, times a power that all windows of a
    place share, so no window is hashed by itself.  An odd base has an inverse modulo 2^64.
    """
    n = len(words) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(pow(base, -1, 1 << 64), len(words)), out=sums[1:])
    h = (sums[width:] - sums[:n]) * (powers(base, n) * np.uint64(pow(base, width - 1, 1 << 64)))
    h = (h ^ h >> np.uint64(32)) * SPREAD
    return h ^ h >> np.uint64(29)


def windows(rows: np.ndarray, columns: np.ndarray, width: int, check: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """(64-bit hashes, 16-bit checks) of every window of a text."""
    h = rolled(columns[0][rows], width, BASE)
    return h, (rolled(columns[1][rows], width, CHECK_BASE) >> np.uint64(48)).astype(np.uint16) if check else None


def planes(values: np.ndarray) -> bytes:
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def from_planes(data: bytes, at: int, n: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T).view(kind).reshape(n)


def packed(h: np.ndarray, c: np.ndarray, doc: np.ndarray) -> bytes:
    """Entries in the order of h, as planes of differences, checks and documents' differences to the least one."""
    least = doc.min()
    return np.array([len(h), least], np.int64).tobytes() + planes(np.diff(h, prepend=np.uint64(0))) + planes(c) + planes((doc - least).view(np.uint64))


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, least = np.frombuffer(data, np.int64, 2).tolist()
    return np.cumsum(from_planes(data, 16, n, np.uint64), dtype=np.uint64), from_planes(data, 16 + 8 * n, n, np.uint16), from_planes(data, 16 + 10 * n, n, np.uint64).view(np.int64) + least


def judged(h: np.ndarray, c: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of entries (h, c, doc), sorted by h: indexes of the entries of each window's least document, and of all others', each document once."""
    fresh = np.ones(len(h), bool)
    fresh[1:] = h[1:] != h[:-1]
    alone = fresh & np.append(fresh[1:], True)
    tied = np.flatnonzero(~alone)
    tied = tied[np.lexsort((doc[tied], c[tied], h[tied]))]
    same = np.zeros(len(tied), bool)
    same[1:] = (h[tied[1:]] == h[tied[:-1]]) & (c[tied[1:]] == c[tied[:-1]])
    again = same.copy()
    again[1:] &= doc[tied[1:]] == doc[tied[:-1]]
    of = tied[np.maximum.accumulate(np.where(same, 0, np.arange(len(tied))))] if len(tied) else tied  # where its window begins
    least = doc[tied] == doc[of]
    return np.sort(np.concatenate((np.flatnonzero(alone), tied[~same]))), tied[~least & ~again]


def shipped(docs: DataFrame, id_col: str, text_col: str, width: int, ranges: int) -> DataFrame:
    """(part int, known boolean, entries binary): the windows of each group of texts by hash range, and repeats known already, dealt by document."""
    step = np.uint64(-(-(1 << 64) // max(ranges, 2)))

    def dealt(doc: np.ndarray) -> np.ndarray:
        return (doc.view(np.uint64) * SPREAD >> np.uint64(32)) % np.uint64(ranges)

    def rows_of(h, c, doc) -> Iterator[tuple[int, bool, bytes]]:
        order = np.argsort(h)
        h, c, doc = h[order], c[order], doc[order]
        first, more = judged(h, c, doc)
        # A window that very many documents hold mustn't meet in one range, so what is known goes by document.
        for known, at, part in ((False, first, h[first] // step), (True, more, dealt(doc[more]))):
            order = np.lexsort((h[at], part))
            at, part = at[order], part[order]
            for some in np.split(np.arange(len(at)), np.flatnonzero(np.diff(part)) + 1) if len(at) else ():
                yield int(part[some[0]]), known, packed(h[at[some]], c[at[some]], doc[at[some]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, size = Vocabulary(), [], 0

        def flush() -> pa.RecordBatch:
            made = list(rows_of(*(np.concatenate(x) for x in zip(*held, strict=True))))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int32()), pa.array([m[1] for m in made], pa.bool_()), pa.array([m[2] for m in made], pa.binary())], ["part", "known", "entries"])

        for batch in batches:
            for piece in pieces(batch):
                for doc, text in zip(piece.column(0).to_pylist(), piece.column(1), strict=True):
                    rows = words.rows(text.as_py())
                    for at in range(0, len(rows) - width + 1, GROUP):
                        h, c = windows(rows[at : at + GROUP + width - 1], words.columns, width)
                        held.append((h, c, np.full(len(h), doc, np.int64)))
                        size += len(h)
                        if size >= GROUP:
                            yield flush()
                            size = 0
        if held:
            yield flush()
        trim()

    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "part int, known boolean, entries binary")


def repeats(sent: DataFrame) -> DataFrame:
    """(doc long, h long): the windows that a document loses, from `shipped` rows that lie together and in order by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def told(doc: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(h.view(np.int64))], ["doc", "h"])

        def flush() -> pa.RecordBatch:
            h, c, doc = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(h, kind="stable")  # made of sorted runs
            h, c, doc = h[order], c[order], doc[order]
            more = judged(h, c, doc)[1]
            return told(doc[more], h[more])

        for batch in batches:
            for p, known, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if known:
                    h, _, doc = unpacked(entries.as_py())
                    yield told(doc, h)
                    continue
                if held and p != part:
                    yield flush()
                part = p
                held.append(unpacked(entries.as_py()))
        if held:
            yield flush()
        trim()

    return sent.mapInArrow(run, "doc long, h long")


def spans_of(h: np.ndarray, lost: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in words, of the maximal intervals that windows with a hash in `lost` cover."""
    at = np.flatnonzero(np.isin(h, lost))
    if not len(at):
        return at, at
    apart = np.flatnonzero(np.diff(at) > width)  # windows that touch are one interval
    return at[np.concatenate(([0], apart + 1))], at[np.concatenate((apart, [len(at) - 1]))] + width


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id_col, n_words, spans array<struct<start, end>>, kept string) for every row.

    A word goes if a window of `width` words covers it whose words also start a window in a document with a smaller id;
    all windows are judged as they came in.  spans are the maximal intervals of such words, from 0, end not included; kept
    has the other words joined by one space.  Rows that share an id are parts of one document: neither is smaller.
    A null id is smaller than none and none is smaller than it, so such rows lose nothing and cost others nothing.  Null texts
    have no words.  Ids are whole numbers.  Windows are told apart by 80 bits; a document knows its own again by 64 of them.
    """
    spark = docs.sparkSession
    ship(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = shipped(docs, id_col, text_col, width, partitions * RANGES).repartition(partitions, "part").sortWithinPartitions("known", "part")
    hits = Stored(repeats(sent), "repeats").read()
    lost = hits.groupBy(F.col("doc").alias("__doc")).agg(F.collect_set("h").alias("__lost"))
    kind = dict(docs.dtypes)[id_col]
    joined = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(lost, F.col("__id") == F.col("__doc"), "left").select("__id", "__text", "__lost")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary()
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            for piece in pieces(batch):
                sizes, spans, kept = [], [], []
                for text, lost in zip(piece.column(1), piece.column(2), strict=True):
                    body, n, own = text.as_py(), 0, []
                    if lost.is_valid:
                        rows = words.rows(body)
                        n = len(rows)
                        h, _ = windows(rows, words.columns, width, check=False)
                        starts, ends = spans_of(h, lost.values.to_numpy().view(np.uint64), width)
                        own = list(zip(starts.tolist(), ends.tolist(), strict=True))
                    split = (body or "").encode().split()
                    last, left = 0, []
                    for lo, hi in own:
                        left += split[last:lo]
                        last = hi
                    left += split[last:]
                    sizes.append(len(split))
                    spans.append([{"start": lo, "end": hi} for lo, hi in own])
                    kept.append(b" ".join(left).decode())
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(kept, pa.string())], [id_col, "n_words", "spans", "kept"])
        trim()

    return joined.mapInArrow(run, f"{id_col} {kind}, n_words long, spans array<struct<start: long, end: long>>, kept string")


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = removals(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


#: Windows as joined words, each with the least id that has it.
OP13_SQL = rf"""
with d as materialized (select row_number() over () k, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
x as materialized (select k, doc_id, i, array_to_string(w[i:i + {WIDTH - 1}], ' ') s from (select k, doc_id, w, unnest(range(1, len(w) - {WIDTH - 2})) i from d where len(w) >= {WIDTH})),
m as (select s, min(doc_id) least from x group by s),
c as (select distinct k, i + unnest(range(0, {WIDTH})) i from (select k, i from x join m using (s) where least < doc_id)),
g as (select k, list(i) g from c group by k),
r as (select doc_id, w, list_filter(range(1, len(w) + 1), lambda i: not list_contains(coalesce(g, []), i)) i from d left join g using (k))
select doc_id, len(w) n_words, len(w) - len(i) n_removed, sha256(array_to_string(list_transform(i, lambda j: w[j]), ' ')) kept_sha256 from r
"""
