"""Token counts with the whole-token shortcut.

Offline, once: which vocabulary strings does the tokenizer turn into exactly one token when they stand alone?
A pre-token among these counts 1 by a set lookup; only the others are merged, each distinct one once a task.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe import Bpe
from .common import map_arrow, table, tokenizer_path

#: Below this code point all versions of Unicode agree on what is a letter, number or blank.
SETTLED = "԰"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable bytes for themselves, the others from 256 up in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


class Counter:
    """Counts tokens as the tokenizers library does for a byte-level BPE file; special strings inside texts are one token each."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError("only byte-level BPE files without normalizer or prefix blank can be counted this way")
        letters = byte_letters()
        self.library = Tokenizer.from_file(path)
        self.pre = self.library.pre_tokenizer
        #: The pattern of this kind of pre-tokenizer, a fixed value.
        self.find = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        self.late = regex.compile(rf"[^\x00-{SETTLED}]").search
        specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        ranks: dict[bytes, int] = {}
        added = {t["content"] for t in spec["added_tokens"]}
        vocabulary = spec["model"]["vocab"]
        for token, i in vocabulary.items():
            if token not in added:
                ranks[bytes(letters[c] for c in token)] = i
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank_of = {(vocabulary[a], vocabulary[b]): (i, vocabulary[a + b]) for i, (a, b) in enumerate(pairs)}
        self.bytes_of = [0] * 256
        for c, b in letters.items():
            self.bytes_of[b] = vocabulary[c]
        self.whole = self.prove(ranks)
        self.cache: dict[str, int] = {}

    def merged(self, piece: bytes) -> int:
        """Tokens of a pre-token: merges by the file's list, least rank first, leftmost of equals."""
        if len(piece) > 64:
            return self.merged_long(piece)
        ids = [self.bytes_of[b] for b in piece]
        rank_of = self.rank_of
        while len(ids) > 1:
            best = min(((r[0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if (r := rank_of.get(p))), default=None)
            if best is None:
                break
            i = best[1]
            ids[i : i + 2] = [rank_of[ids[i], ids[i + 1]][1]]
        return len(ids)

    def merged_long(self, piece: bytes) -> int:
        """The same in n log n, for runs without blanks."""
        import heapq

        n = len(piece)
        ids, after, before = [self.bytes_of[b] for b in piece], list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.rank_of.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = self.rank_of[a, b][1], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            left -= 1
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := self.rank_of.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (r[0], x, ids[x], ids[y]))
        return left

    def prove(self, ranks: dict[bytes, int]) -> frozenset[str]:
        """The vocabulary strings that the merges turn into one token, as texts."""
        out = set()
        for token in ranks:
            try:
                text = token.decode()
            except UnicodeDecodeError:
                continue  # part of a character: never a pre-token
            if self.merged(token) == 1:
                out.add(text)
        return frozenset(out)

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens.  Texts with characters that Unicode settled late are split by the library itself, whose tables they must follow."""
        if self.late(text):
            return [text[a:b] for _, (a, b) in self.pre.pre_tokenize_str(text)]
        return self.find(text)

    def count_plain(self, text: str) -> int:
        whole, cache, n = self.whole, self.cache, 0
        for piece in self.pieces(text):
            if piece in whole:
                n += 1
            else:
                if (k := cache.get(piece)) is None:
                    if len(cache) >= 500_000:
                        cache.clear()
                    k = cache[piece] = self.merged(piece.encode())
                n += k
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self.count_plain(text)
        n, at = 0, 0
        for m in self.special.finditer(text):
            n += self.count_plain(text[at : m.start()]) + 1
            at = m.end()
        return n + self.count_plain(text[at:])


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One counter a worker process, since the proof takes seconds."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 1024) -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) of every whole text.

    Null and empty texts have 0 bytes and tokens.  Repeated rows and null ids stay; other columns are left out.  No shuffle.
    """
    kind = dict(docs.dtypes)[id_col]

    def make():
        c = counter(tokenizer_path("byte_bpe_50k.json", path))

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            n_bytes, n = [], []
            for x in batch.column(1):
                text = x.as_py() or ""
                n_bytes.append(len(text.encode()))
                n.append(c.count(text))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_())], [id_col, "n_bytes", "n_tokens", "over_limit"])

        return each

    return map_arrow(docs.select(id_col, text_col), make, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
