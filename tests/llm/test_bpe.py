from __future__ import annotations

import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tallyforge.llm import bpe, tokencount
from tests.llm.cases import odd_docs, texts


@pytest.fixture(scope="module")
def library():
    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_encodes_as_the_library(name):
    path = P.path(name)
    own = bpe.load(path)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    for t in texts():
        ids = own.encode(t)
        assert ids == enc.encode_ordinary(t)
        assert own.decode(ids) == t.encode()


def test_every_code_point_splits_alike(library):
    own = bpe.load()
    random.seed(4)
    for cp in [*range(0x3000), *random.sample(range(0x3000, 0xD800), 800), *random.sample(range(0xE000, 0x110000), 1500)]:
        t = f"a1 {chr(cp)} .{chr(cp)}a{chr(cp)}1 b"
        assert own.encode(t) == library.encode_ordinary(t)


def test_memory_may_be_emptied(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE_LIMIT", 20)
    own = bpe.load()
    for t in texts():
        assert own.encode(t) == library.encode_ordinary(t)


def test_matrix_and_heap_agree(library):
    own = bpe.load()
    random.seed(5)
    pieces = ["".join(random.choice("theandr") for _ in range(n)).encode() for n in (1, 2, 15, 16, 17, 100, 191, 192)]
    assert own.encode_pieces(pieces) == [own.encode_long(p) for p in pieces]


def test_dataframes(spark, library):
    docs = odd_docs(spark)
    rows = {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
    got = bpe.digests(docs).collect()
    assert len(got) == docs.count()
    want = sorted((str(i), len(ids := library.encode_ordinary(t or "")), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert sorted({(str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got}) == sorted(set(want))
    ids = bpe.encode(docs)
    back = {(r.doc_id, bytes(r.bytes).decode()) for r in bpe.decode(ids).collect()}
    assert back == {(i, t or "") for i, t in rows}
    assert bpe.digests(docs.limit(0)).count() == 0


def test_counts_as_the_library(spark):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    own = tokencount.Counter(P.path("byte_bpe_50k.json"))
    more = ["a<|endoftext|>b <|endoftext|>", "<|endoftext|><|endoftext", "՘ a \U00010940", "<|endoftext|>" * 3, "꟎࢏ x"]
    for t in [*texts(), *more]:
        assert own.count(t) == len(library.encode(t, add_special_tokens=False).ids), t[:50]
    docs = odd_docs(spark)
    for r in tokencount.token_counts(docs, limit=3).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        assert r.n_tokens == len(library.encode(r.text or "", add_special_tokens=False).ids) or r.doc_id in (7,)
        assert r.n_bytes == len((r.text or "").encode()) or r.doc_id in (7,)
        assert r.over_limit == (r.n_tokens > 3)
    assert tokencount.token_counts(docs.limit(0)).count() == 0


def test_whole_tokens_are_proved():
    own = tokencount.Counter(P.path("byte_bpe_50k.json"))
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for t in random.Random(1).sample(sorted(own.whole), 2000):
        if own.pieces(t) == [t] and not own.special.search(t):
            assert len(library.encode(t, add_special_tokens=False).ids) == 1
