from __future__ import annotations

import hashlib
import struct
import zlib

import pytest

from tallyforge.llm import matroska as mk
from tests.llm.cases import odd_docs, texts


def test_round_trip_and_cues():
    for t in [*texts(), "q" * 300_000]:
        payload = mk.pad(t.encode())
        data = mk.mux(payload)
        media = mk.parse(data)
        assert mk.samples(data, media) == payload and len(payload) % 192 == 0 and payload
        assert [c for _, _, c in media.cues] == media.clusters and media.tracks[1].bits == 8
        times = [p[1] for p in media.packets]
        assert times == sorted(times)


@pytest.mark.parametrize("kind", [mk.XIPH, mk.EBML_LACE, mk.FIXED])
def test_lacing(kind):
    sizes = [300, 300, 300] if kind == mk.FIXED else [0, 1, 254, 255, 256, 70_000, 3, 9]
    frames = [bytes([i % 251]) * n for i, n in enumerate(sizes)]
    body = mk.lace(frames, kind)
    assert [body[o : o + n] for o, n in mk.unlace(body, 0, len(body), kind)] == frames
    with pytest.raises(mk.Bad):
        mk.unlace(body, 0, 2, kind)


def test_numbers_and_unknown_sizes():
    for n in (0, 126, 127, 128, 16382, 16383, 2**35):
        assert mk.vint(mk.put_size(n), 0, False) == (n, len(mk.put_size(n)))
    block = b"\x81\x00\x05\x80abc"
    cluster = b"\x1f\x43\xb6\x75\xff" + mk.number(mk.TIMESTAMP, 7) + mk.element(mk.SIMPLE_BLOCK, block)
    group = mk.element(mk.CLUSTER, mk.number(mk.TIMESTAMP, 9) + mk.element(mk.BLOCK_GROUP, mk.element(mk.BLOCK, b"\x81\xff\xff\x00xy") + mk.number(mk.REFERENCE, 1)))
    data = mk.element(mk.EBML, mk.element(mk.DOC_TYPE, b"webm")) + b"\x18\x53\x80\x67\x01\xff\xff\xff\xff\xff\xff\xff" + cluster + group
    media = mk.parse(data)
    assert [(p[1], data[p[2] : p[2] + p[3]], p[4]) for p in media.packets] == [(12_000_000, b"abc", True), (8_000_000, b"xy", False)]


def test_broken_files():
    data = mk.mux(mk.pad(b"hello" * 100))
    for bad in (b"", b"abc", data[:50], data[:-1], b"\x00" + data):
        with pytest.raises(mk.Bad):
            mk.parse(bad)


def test_dataframes(spark):
    docs = odd_docs(spark)
    got = mk.features(mk.encode(docs)).collect()
    assert len(got) == docs.count()
    want = set()
    for r in docs.collect():
        p = mk.pad((r.text or "").encode())
        want.add((r.doc_id, len((r.text or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    assert {(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got} == want
    files = spark.createDataFrame([(1, bytearray(mk.mux(mk.pad(b"x")))), (2, bytearray(b"junk")), (3, None)], "doc_id long, media binary")
    rows = mk.packets(files).collect()
    assert {(r.doc_id, r.problem is None) for r in rows} == {(1, True), (2, False)}
    assert mk.features(mk.encode(docs.limit(0))).count() == 0
    assert mk.features(files.where("doc_id <> 2"), keep=()).where("doc_id = 3").first().feature is None
    assert struct.calcsize(">hB") == 3
