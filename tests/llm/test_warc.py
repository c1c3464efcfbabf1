from __future__ import annotations

import base64
import hashlib
import struct

import pytest
import zstandard

from tallyforge.llm import warc


def pages(spark):
    rows = [(5, "http://a/", "<p>same</p>", 1), (2, "http://b/", "<p>same</p>", 1), (3, None, None, 1), (4, "http://c/\r\nX: y", "", 1), (9, "http://d/", "long " * 50_000, 1), (None, "u", "<p>same</p>", 1), (None, "u", "alone", 1), (6, "é", "ünï", 1), (6, "é", "ünï", 1)]
    rows += [(100 + i, f"http://x/{i}", f"<html><body>page {i} with some words in it and more of them {i * 7}</body></html>" * 3, 1) for i in range(60)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest_hex int").repartition(4)


def sha(t: str | None) -> str:
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


def test_round_trip(spark):
    p = pages(spark)
    stored = warc.write_archives(p)
    got = warc.read_archives(stored.read()).collect()
    assert len(got) == p.count() and all(r.problem is None for r in got)
    rows = [(r.page_id, r.html) for r in p.collect()]
    first = {}
    for i, t in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    want = sorted((str(i), len((t or "").encode()), sha(t), "response" if (t or "") not in first or i == first[t or ""] else "revisit") for i, t in rows)
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type) for r in got) == want
    for r in got:
        if r.record_type == "revisit":
            assert r.refers_to_page in {v for v in first.values()} and r.payload == b""


def test_small_payloads_are_all_responses(spark):
    stored = warc.write_archives(pages(spark), least_bytes=12)
    assert warc.read_archives(stored.read()).where("record_type = 'revisit'").count() == 0


def test_empty_table(spark):
    stored = warc.write_archives(pages(spark).limit(0))
    assert warc.read_archives(stored.read()).count() == 0


def archive(records: list[bytes], dictionary: bytes = b"", press_dictionary: bool = False) -> bytes:
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    body = b"".join(zstandard.ZstdCompressor(dict_data=d).compress(r) for r in records)
    kept = zstandard.ZstdCompressor().compress(dictionary) if press_dictionary else dictionary
    return (struct.pack("<II", warc.DICT_MAGIC, len(kept)) + kept if dictionary else b"") + body


def test_dictionaries_and_foreign_frames():
    record = warc.make_record(1, "http://a/", b"payload", warc.base32_sha1(b"payload"), None)
    d = zstandard.train_dictionary(1024, [f"WARC/1.1 record {i} of some length {i * i}".encode() * 4 for i in range(300)]).as_bytes()
    for data in (archive([record]), archive([record, record], d), archive([record], d, True), archive([record]) + struct.pack("<II", 0x184D2A50, 3) + b"xyz"):
        assert all(r[-1] is None and r[9 + 0] == 1 or r[7] == 1 for r in warc.read_archive("s", data))
    stream = zstandard.ZstdCompressor(write_content_size=False).compressobj()
    data = stream.compress(record) + stream.flush()
    assert [r[-1] for r in warc.read_archive("s", data)] == [None]


@pytest.mark.parametrize("broken", [
    b"HTTP/1.1\r\nA: b\r\n\r\nx\r\n\r\n", b"WARC/1.1\r\nWARC-Type: response\r\n\r\nx\r\n\r\n", b"WARC/1.1\r\nno colon here\r\n\r\n\r\n\r\n", b"WARC/1.1",
    b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: x\r\nWARC-Date: y\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n", b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: x\r\nWARC-Date: y\r\nContent-Length: -1\r\n\r\nabc\r\n\r\n",
])
def test_broken_records_are_named(broken):
    good = warc.make_record(1, "u", b"p", warc.base32_sha1(b"p"), None)
    rows = list(warc.read_archive("s", archive([good, broken, good])))
    assert [r[-1] is None for r in rows] == [True, False, True]


def test_broken_archives_end_with_a_problem():
    good = archive([warc.make_record(1, "u", b"p" * 100, warc.base32_sha1(b"p" * 100), None)])
    assert list(warc.read_archive("s", good[:-3]))[-1][-1]
    assert list(warc.read_archive("s", b"nonsense"))[-1][-1]
    wrong = archive([warc.make_record(1, "u", b"p", warc.base32_sha1(b"q"), None)])
    assert list(warc.read_archive("s", wrong))[0][-1] == "payload digest differs"


def test_files(spark, tmp_path):
    (tmp_path / "a.warc.zst").write_bytes(archive([warc.make_record(7, "u", b"p", warc.base32_sha1(b"p"), None)]))
    got = warc.read_files(spark, str(tmp_path)).collect()
    assert [(r.page_id, bytes(r.payload)) for r in got] == [(7, b"p")]


def test_a_stated_payload_length_must_be_the_payloads():
    good = warc.make_record(1, "http://a/", b"body", warc.base32_sha1(b"body"), None)
    bad = good.replace(b"X-Payload-Length: 4", b"X-Payload-Length: 5")
    press = zstandard.ZstdCompressor()
    archive = struct.pack("<II", warc.DICT_MAGIC, 0) + press.compress(good) + press.compress(bad)
    problems = [r[-1] for r in warc.read_archive("s", archive, with_payload=False)]
    assert problems[0] is None and "x-payload-length is 5" in problems[1]
