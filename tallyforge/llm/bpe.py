"""Byte-level BPE over rank files: padded numpy matrices, one merge a row and round.

Distinct pre-tokens of a batch are encoded together.  Pre-tokens of similar length form one matrix of
symbol ids, padded with -1.  In each round every row looks its neighbouring pairs up in a hashed pair
table, merges its leftmost pair of least rank and is compacted by one; rows without a pair leave.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_arrow, tokenizer_path

NO_RANK = np.int32(2**31 - 1)
#: Longer pre-tokens (runs of letters without any space) merge by a heap, by the same rule.
MATRIX_LIMIT = 192
#: Most pre-tokens that a task remembers; past it the memory is emptied.
CACHE_LIMIT = 600_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairTable:
    """(left id, right id) -> rank of the joined bytes, as an open-addressed hash table in two arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        self.bits = max(4, int(len(keys) * 2.5).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.values = np.full(size, NO_RANK, np.int32)
        left = np.array(keys, np.int64)
        ranks_left = np.array(values, np.int32)
        slot = self.slot(left)
        while len(left):  # each round seats the first comer of every free slot; the others probe on
            free = self.keys[slot] == -1
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            first = first[free[first]]
            self.keys[slot[first]] = left[first]
            self.values[slot[first]] = ranks_left[first]
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, ranks_left, slot = left[rest], ranks_left[rest], (slot[rest] + 1) & (size - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NO_RANK where there is none or a side is padding."""
        shape = left.shape
        keys = (left.astype(np.int64) << 32 | right.astype(np.int64)).ravel()
        out = np.full(len(keys), NO_RANK, np.int32)
        todo = np.flatnonzero((right.ravel() >= 0) & (left.ravel() >= 0))
        slot, mask = self.slot(keys[todo]), len(self.keys) - 1
        while len(todo):
            held = self.keys[slot]
            hit = held == keys[todo]
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (held != -1)
            todo, slot = todo[on], (slot[on] + 1) & mask
        return out.reshape(shape)


class Bpe:
    """Encoder and decoder for one rank file.  Ids are ranks; the ids of single bytes come from the file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.pairs = PairTable(ranks)
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.token = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token
        self.cache: dict[str, tuple[int, ...]] = {}

    def encode_pieces(self, pieces: Iterable[bytes]) -> list[tuple[int, ...]]:
        pieces = list(pieces)
        out: list[tuple[int, ...]] = [()] * len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        buckets: dict[int, list[int]] = {}
        for i, n in enumerate(lengths):
            if n > MATRIX_LIMIT:
                out[i] = self.encode_long(pieces[i])
            elif n:
                buckets.setdefault(int(n) if n <= 16 else -(-int(n) // 16) * 16, []).append(i)
        for width, rows in buckets.items():
            step = max(1, 400_000 // width)
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                for i, ids in zip(part, self.encode_bucket([pieces[i] for i in part], lengths[part], width), strict=True):
                    out[i] = ids
        return out

    def encode_bucket(self, pieces: list[bytes], lengths: np.ndarray, width: int) -> list[tuple[int, ...]]:
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        ids = np.where(np.arange(width) < lengths[:, None], self.byte_id[raw], np.int32(-1))
        rank = self.pairs.find(ids[:, :-1], ids[:, 1:])
        done: list[tuple[int, ...]] = [()] * len(pieces)
        row_of = np.arange(len(pieces))
        while len(ids):
            best = rank.argmin(1) if rank.shape[1] else np.zeros(len(ids), np.int64)
            least = rank[np.arange(len(ids)), best] if rank.shape[1] else np.full(len(ids), NO_RANK)
            ended = least == NO_RANK
            if ended.any():
                for i, row in zip(row_of[ended], ids[ended].tolist(), strict=True):
                    done[i] = tuple(x for x in row if x >= 0)
                on = ~ended
                ids, rank, best, least, row_of = ids[on], rank[on], best[on], least[on], row_of[on]
                if not len(ids):
                    break
            # Merge the pair at `best` and close the gap behind it; the matrix gets one column narrower.
            rows, w = np.arange(len(ids)), ids.shape[1]
            keep = np.arange(w)[None, :] != (best + 1)[:, None]
            ids[rows, best] = least
            ids = ids[keep].reshape(len(rows), w - 1)
            rank = rank[keep[:, 1:]].reshape(len(rows), w - 2)
            if w > 2:  # only the two pairs beside the new symbol change
                right = best < w - 2
                rank[rows[right], best[right]] = self.pairs.find(ids[rows[right], best[right]], ids[rows[right], best[right] + 1])
                left = best > 0
                rank[rows[left], best[left] - 1] = self.pairs.find(ids[rows[left], best[left] - 1], ids[rows[left], best[left]])
        return done

    def encode_long(self, piece: bytes) -> tuple[int, ...]:
        """One piece of any length in n log n: a heap of (rank, place) over a linked list."""
        n, ranks = len(piece), self.ranks
        start, end = list(range(n)), list(range(1, n + 1))
        before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (r := ranks.get(piece[start[i] : end[j]])) is not None:
                heapq.heappush(heap, (r, i, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or (j := after[i]) >= n or end[j] != stop:
                continue
            end[i], alive[j], after[i] = stop, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return tuple(ranks[piece[start[i] : end[i]]] for i in range(n) if alive[i])

    def learn(self, words: set[str]) -> None:
        """Makes sure that the memory holds all these words; a full memory is emptied of others first."""
        new = [w for w in words if w not in self.cache]
        if new and len(self.cache) + len(new) > CACHE_LIMIT:
            self.cache.clear()
            new = list(words)
        for word, ids in zip(new, self.encode_pieces(w.encode() for w in new), strict=True):
            self.cache[word] = ids

    def encode(self, text: str) -> list[int]:
        words = self.split(text)
        distinct = set(words)
        self.learn(distinct)
        cache = self.cache
        return [i for w in words for i in cache[w]]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def load(path: str | None = None, pattern: str | None = None) -> Bpe:
    import public_tokenizers

    return Bpe(read_ranks(tokenizer_path("byte_bpe_50k.tiktoken", path)), pattern or public_tokenizers.PATTERN)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id_col, ids array<int>): the tokens of every whole text.

    Null and empty texts give an empty list; repeated rows and null ids stay; other columns are left out.
    No shuffle: each row is encoded where it is read.
    """
    kind = dict(docs.dtypes)[id_col]

    def make():
        bpe = load(path, pattern)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = []
            for texts in blocks(batch.column(1)):
                bpe.learn(set().union(*map(bpe.split, texts)))
                ids += map(bpe.encode, texts)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

        return each

    return map_arrow(docs.select(id_col, text_col), make, f"`{id_col}` {kind}, ids array<int>")


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id_col, bytes): the bytes that the ids stand for; a null list gives no bytes.  Unknown ids raise IndexError."""
    kind = dict(tokens.dtypes)[id_col]

    def make():
        bpe = load(path)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [bpe.decode(x.as_py() or ()) for x in batch.column(1)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], [id_col, "bytes"])

        return each

    return map_arrow(tokens.select(id_col, ids_col), make, f"`{id_col}` {kind}, bytes binary")


def blocks(column: pa.Array, size: int = 4_000_000) -> Iterator[list[str]]:
    """The texts of a column in lists of about `size` characters; null is empty."""
    held, n = [], 0
    for x in column:
        held.append(x.as_py() or "")
        n += len(held[-1])
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Encodes and decodes every text and returns (id_col, n_tokens, ids_sha256, decoded_sha256), without moving the ids.

    Null and empty texts have no tokens, and both digests are those of no bytes.
    """
    kind = dict(docs.dtypes)[id_col]

    def make():
        bpe = load(path)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, a, b = [], [], []
            for texts in blocks(batch.column(1)):
                split = [bpe.split(t) for t in texts]
                bpe.learn(set().union(*split))
                cache = bpe.cache
                for words in split:
                    ids = [i for w in words for i in cache[w]]
                    n.append(len(ids))
                    a.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                    b.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

        return each

    return map_arrow(docs.select(id_col, text_col), make, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    return digests(table(spark, sf_dir, "documents"))
