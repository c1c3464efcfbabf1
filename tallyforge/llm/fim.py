"""Fill-in-the-middle by overlapping chunks: two cut ranks a text, found without scanning the text unit by unit.

The texts of a batch lie one behind another as UTF-8, cut into chunks of CHUNK bytes that also see the last byte of the
chunk before.  A unit ends between two adjacent bytes that a predicate names, so each chunk counts its own
boundaries.  Prefix sums over the counts say which chunk owns a cut's rank, and only those chunks are
scanned again for the place itself.  Nothing is shuffled: a row's cuts need its own text and id only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tallyforge import ship

from .common import pieces, table, trim

CHUNK = 16_384
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
NEWLINE = 10
#: Whether a unit ends between bytes `a` and `b`, for arrays of neighbours; the end of a text that isn't empty ends one too.
UNITS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "lines": lambda a, b: a == NEWLINE,
    "characters": lambda a, b: (b & 0xC0) != 0x80,
    "words": lambda a, b: ((a == 32) | ((a >= 9) & (a <= 13))) & ~((b == 32) | ((b >= 9) & (b <= 13))),
}


def draws(doc_id: int | None, seed: int) -> list[int]:
    """The first four 8-digit groups of the hex SHA-256 of `seed:id`; a null id counts as no digits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


class Chunks:
    """Boundaries of the texts of a batch, counted by chunk.

    A place p is a boundary if a unit of its text ends before byte p of the buffer, p not being a text's first byte.
    Chunk k judges the places from k * size on, with the byte before the first of them.
    """

    def __init__(self, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, ends_unit, size: int = CHUNK):
        self.buffer, self.starts, self.ends, self.ends_unit, self.size = buffer, starts, ends, ends_unit, size
        self.count = -(-len(buffer) // size)
        first = np.zeros(len(buffer) + 1, bool)
        first[starts] = True  # what stands before a text belongs to another one
        self.first = first
        counts = np.array([int(self.boundaries(k).sum()) for k in range(self.count)], np.int64)
        self.before = np.concatenate(([0], np.cumsum(counts)))

    def boundaries(self, k: int) -> np.ndarray:
        """Of chunk k, by place: whether a unit ends before it."""
        lo, hi = k * self.size, min(len(self.buffer), (k + 1) * self.size)
        seen = self.buffer[max(lo - 1, 0) : hi]
        out = np.zeros(hi - lo, bool)
        out[hi - lo - len(seen) + 1 :] = self.ends_unit(seen[:-1], seen[1:])
        return out & ~self.first[lo:hi]

    def ranks(self, places: np.ndarray) -> np.ndarray:
        """Boundaries before each place, whose chunk alone is scanned."""
        out = np.empty(len(places), np.int64)
        owner = np.minimum(places // self.size, max(self.count - 1, 0))
        for k in np.unique(owner) if self.count else ():
            of = owner == k
            out[of] = self.before[k] + np.concatenate(([0], np.cumsum(self.boundaries(int(k)))))[places[of] - k * self.size]
        return out if self.count else np.zeros(len(places), np.int64)

    def places(self, ranks: np.ndarray) -> np.ndarray:
        """The place of each boundary that has `rank` others before it: routed by the prefix sums to the chunk that owns it."""
        out = np.empty(len(ranks), np.int64)
        owner = np.searchsorted(self.before, ranks, "right") - 1
        for k in np.unique(owner):
            of = owner == k
            out[of] = k * self.size + np.flatnonzero(self.boundaries(int(k)))[ranks[of] - self.before[k]]
        return out

    def units(self) -> tuple[np.ndarray, np.ndarray]:
        """Units of every text, and the boundaries before its first place."""
        base = self.ranks(self.starts)
        inner = self.ranks(self.ends) - base
        return inner + (self.ends > self.starts), base

    def cut(self, base: np.ndarray, units: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Where the text ends its unit number `after` (0: its start; all of them: its end)."""
        out = np.where(after == 0, self.starts, self.ends)
        inner = (after > 0) & (after < units)
        out[inner] = self.places(base[inner] + after[inner] - 1)
        return out


def arranged(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    if form == "psm":
        return b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
    return b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))


def restored(form: str, output: bytes) -> bytes:
    """The text that an output was made of; the markers stand in none of its parts."""
    if form == "plain":
        return output
    order = (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE)
    part, at = {}, 0
    for mark, follows in zip(order, (*order[1:], None), strict=True):
        if not output.startswith(mark, at):
            raise ValueError(f"no {mark!r} where it must stand")
        end = output.find(follows, at) if follows else len(output)
        part[mark] = output[at + len(mark) : end]
        at = end
    return part[PREFIX] + part[MIDDLE] + part[SUFFIX]


def bodies(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of a column of texts, and where each text starts and ends in them; null is empty."""
    values = [x.as_buffer() if x.is_valid else b"" for x in column.cast(pa.large_binary())]
    edges = np.concatenate(([0], np.cumsum([len(v) for v in values], dtype=np.int64)))
    return np.frombuffer(b"".join(values), np.uint8), edges[:-1].astype(np.int64), edges[1:].astype(np.int64)


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", units: str = "lines", seed: int = 7, rate: int = 100, spm: int = 50, chunk: int = CHUNK) -> DataFrame:
    """(id_col, n, form, prefix_chars, middle_chars, output binary) for every row.

    `rate` of 100 texts are cut after two units drawn by the id alone, `spm` of 100 of these put the suffix first.  Null texts
    are empty; empty texts, and those with a marker in them, stay plain.  A null id draws as if it had no digits.  Rows
    that repeat give equal rows; other columns have no effect; an empty table gives an empty result.  A text of
    one unit is cut at its start or end.  Memory is a batch's texts and outputs; a text that is larger than a batch
    comes alone.
    """
    if units not in UNITS:
        raise ValueError(f"units are {', '.join(UNITS)}")
    ends_unit = UNITS[units]
    kind = dict(docs.dtypes)[id_col]

    def batch_of(ids: list, column: pa.Array) -> pa.RecordBatch:
        buffer, starts, ends = bodies(column)
        chunks = Chunks(buffer, starts, ends, ends_unit, chunk)
        n, base = chunks.units()
        h = np.array([draws(i, seed) for i in ids], np.int64).reshape(-1, 4)
        a, b = np.minimum(h[:, 0] % (n + 1), h[:, 1] % (n + 1)), np.maximum(h[:, 0] % (n + 1), h[:, 1] % (n + 1))
        one, two = chunks.cut(base, n, a), chunks.cut(base, n, b)
        whole = buffer.tobytes()
        forms, sizes, outputs = [], [], []
        for i, (lo, p, q, hi) in enumerate(zip(starts.tolist(), one.tolist(), two.tolist(), ends.tolist(), strict=True)):
            text = whole[lo:hi]
            if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h[i, 2] % 100 >= rate:
                forms.append("plain")
                sizes.append((None, None))
                outputs.append(text)
                continue
            forms.append("spm" if h[i, 3] % 100 < spm else "psm")
            prefix, middle = whole[lo:p], whole[p:q]
            sizes.append((len(prefix.decode(errors="replace")), len(middle.decode(errors="replace"))))
            outputs.append(arranged(forms[-1], prefix, middle, whole[q:hi]))
        return pa.RecordBatch.from_arrays(
            [pa.array(n, pa.int64()), pa.array(forms), pa.array([s[0] for s in sizes], pa.int64()), pa.array([s[1] for s in sizes], pa.int64()), pa.array(outputs, pa.binary())],
            ["n", "form", "prefix_chars", "middle_chars", "output"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                made = batch_of(piece.column(0).to_pylist(), piece.column(1))
                yield pa.RecordBatch.from_arrays([piece.column(0), *made.columns], [id_col, *made.schema.names])
        trim()

    ship(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")


def digests(made: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The outputs' digests, and those of the texts rebuilt from output and form alone, in place of the outputs."""
    kind = dict(made.dtypes)[id_col]
    columns = [id_col, "n", "form", "prefix_chars", "middle_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [x.as_py() for x in batch.column(5)]
            back = [restored(f, x) for f, x in zip(batch.column(2).to_pylist(), out, strict=True)]
            shas = [pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string()) for xs in (out, back)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *shas], [*columns, "output_sha256", "restored_sha256"])

    return made.select(*columns, "output").mapInArrow(run, f"{id_col} {kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(transform(table(spark, sf_dir, "documents")))


#: Units as lists, cut and joined again; the text is rebuilt by splitting at the markers.
OP12_SQL = r"""
with d as (select doc_id, coalesce(text, '') text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') u, sha256('7:' || coalesce(doc_id::varchar, '')) h from documents),
n as (select *, len(u) n, ('0x' || h[1:8])::bigint % (len(u) + 1) a, ('0x' || h[9:16])::bigint % (len(u) + 1) b, ('0x' || h[17:24])::bigint % 100 c, ('0x' || h[25:32])::bigint % 100 e from d),
f as (select *, case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or c >= 100 then 'plain' when e < 50 then 'spm' else 'psm' end form,
  array_to_string(u[1:least(a, b)], '') p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') m, array_to_string(u[greatest(a, b) + 1:], '') s from n),
o as (select *, case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end o from f),
r as (select *, split_part(o, '<M>', 2) rm, case form when 'psm' then split_part(split_part(o, '<S>', 1), '<P>', 2) else split_part(split_part(o, '<M>', 1), '<P>', 2) end rp,
  case form when 'psm' then split_part(split_part(o, '<M>', 1), '<S>', 2) else split_part(split_part(o, '<P>', 1), '<S>', 2) end rs from o)
select doc_id, n, form, case when form <> 'plain' then length(p) end prefix_chars, case when form <> 'plain' then length(m) end middle_chars, sha256(o) output_sha256, sha256(case form when 'plain' then o else rp || rm || rs end) restored_sha256 from r
"""
