"""WARC archives compressed with Zstandard: one frame per record, the dictionary in a leading skippable frame.

Archives live in a table (segment string, archive binary), one row a segment, which Spark writes and
commits on whatever store the path names; `read_files` reads .warc.zst files of other writers the same way.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge import ship

from .common import Stored, map_arrow, table

#: Fixed values of the formats (RFC 8878; the WARC-Zstandard specification).
ZSTD_MAGIC = 0xFD2FB528
DICT_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
#: Payload bytes after which a writer begins another segment; a larger record has a segment of its own.
SEGMENT_BYTES = 8_000_000
#: The dictionary is trained from so many rows at most, so many characters of each.
DICT_ROWS, DICT_CHARS, DICT_BYTES = 256, 4096, 32_768

RECORDS = "record_type string, record_id string, date string, target_uri string, refers_to string, payload_digest string, payload_bytes long, page_id long, refers_to_page long, payload binary, segment string, frame_offset long, frame_bytes long, problem string"


class Bad(ValueError):
    """An archive or a record that breaks the format."""


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at `at` ends, found by walking its block headers."""
    if at + 5 > len(data):
        raise Bad("frame header is cut off")
    kind = data[at + 4]
    single, checked = kind >> 5 & 1, kind >> 2 & 1
    size = (1 if single else 0, 2, 4, 8)[kind >> 6]
    p = at + 5 + (0 if single else 1) + (0, 1, 2, 4)[kind & 3] + size
    last = 0
    while not last:
        if p + 3 > len(data):
            raise Bad("block header is cut off")
        head = data[p] | data[p + 1] << 8 | data[p + 2] << 16
        last, of_kind, n = head & 1, head >> 1 & 3, head >> 3
        p += 3 + (1 if of_kind == 1 else n)
    p += 4 * checked
    if p > len(data):
        raise Bad("frame is cut off")
    return p


def frames(archive: bytes) -> tuple[bytes | None, Iterator[tuple[int, memoryview]]]:
    """The dictionary, or None, and each data frame with its offset.  A dictionary may itself be a Zstandard frame."""
    import zstandard

    data, first, dictionary = memoryview(archive), 0, None
    if len(data) >= 8:
        magic, n = struct.unpack_from("<II", data)
        if magic == DICT_MAGIC:
            if 8 + n > len(data):
                raise Bad("dictionary frame is cut off")
            dictionary, first = bytes(data[8 : 8 + n]), 8 + n
            if dictionary[:4] == struct.pack("<I", ZSTD_MAGIC):
                dictionary = zstandard.ZstdDecompressor().decompressobj().decompress(dictionary)

    def each() -> Iterator[tuple[int, memoryview]]:
        at = first
        while at < len(data):
            if at + 8 > len(data):
                raise Bad("trailing bytes")
            magic, n = struct.unpack_from("<II", data, at)
            if magic in SKIPPABLE:
                at += 8 + n
                continue
            if magic != ZSTD_MAGIC:
                raise Bad(f"no frame at byte {at}")
            end = frame_end(data, at)
            yield at, data[at:end]
            at = end

    return dictionary, each()


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, names in lower case, and the block.  Checks the version line, the headers' form, the length and the two closing line ends."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    if not gap:
        raise Bad("headers have no end")
    lines = head.split(b"\r\n")
    if lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise Bad("no WARC version line")
    headers: dict[str, str] = {}
    name = ""
    for line in lines[1:]:
        if line[:1] in (b" ", b"\t") and name:
            headers[name] += " " + line.strip().decode("utf-8", "replace")
            continue
        key, colon, value = line.partition(b":")
        if not colon or not key.strip():
            raise Bad("a header line has no name")
        name = key.strip().decode("utf-8", "replace").lower()
        headers[name] = value.strip().decode("utf-8", "replace")
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if need not in headers:
            raise Bad(f"{need} is missing")
    if not headers["content-length"].isdecimal():
        raise Bad("content-length is no number")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise Bad(f"content-length is {n}, the record holds {max(0, len(rest) - 4)}")
    return headers, rest[:n]


def read_archive(segment: str, archive: bytes, with_payload: bool = True) -> Iterator[tuple]:
    """A row of RECORDS for each record; a record that breaks the format gets nulls and its `problem`.

    The stated payload length must be the block's, the digest the payload's; of a revisit, which has no payload, both are its response's.
    """
    import zstandard

    try:
        dictionary, each = frames(archive)
        plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for at, frame in each:
            problem, headers, block = None, {}, None
            try:
                out = plain.decompressobj()
                headers, block = parse_record(out.decompress(frame))
                digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
                if headers["warc-type"] != "revisit" and digest and base32_sha1(block) != digest:
                    problem = "payload digest differs"
            except (Bad, zstandard.ZstdError) as e:
                problem = str(e)
            number = lambda k: int(v) if (v := headers.get(k, "")).lstrip("-").isdecimal() else None  # noqa: B023, E731
            size = number("x-payload-length")
            if problem is None and headers["warc-type"] != "revisit" and size not in (None, len(block)):
                problem = f"x-payload-length is {size}, the payload holds {len(block)}"
            length = None if block is None else len(block)
            if not with_payload:
                block = None
            yield (
                headers.get("warc-type"), headers.get("warc-record-id"), headers.get("warc-date"), headers.get("warc-target-uri"), headers.get("warc-refers-to"),
                headers.get("warc-payload-digest", "").removeprefix("sha1:") or None, length if size is None else size,
                number("x-page-id"), number("x-refers-to-page"), block, segment, at, len(frame), problem,
            )
    except Bad as e:
        yield (None,) * 10 + (segment, None, None, str(e))


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}')}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One uncompressed record: a response with the payload, or a revisit of `refers_to` without it."""
    revisit = refers_to is not None
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", f"X-Page-Id: {'' if page_id is None else page_id}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    block = b"" if revisit else payload
    return "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train_dictionary(pages: DataFrame, payload_col: str = "html") -> bytes:
    """A dictionary from at most DICT_ROWS distinct payloads, those of least hash; empty where they are too few to train one.

    The share of hashes that may be among the least follows from their approximate number, with a margin of four, so that
    all partitions together send a few thousand strings of DICT_CHARS, however many they are.
    """
    import zstandard

    some = pages.where(F.length(payload_col) > 64).select(F.substring(F.col(payload_col), 1, DICT_CHARS).alias("p"), F.xxhash64(payload_col).alias("h"))
    distinct = some.agg(F.approx_count_distinct("h")).first()[0]
    part = min(1.0, (4.0 * DICT_ROWS + 200) / max(distinct, 1))
    near = some.where((F.col("h") / F.lit(2.0**64) + 0.5) <= part).groupBy("h").agg(F.min("p").alias("p"))
    rows = near.orderBy("h").limit(DICT_ROWS).collect()
    samples = [r.p.encode() for r in rows]
    if len(samples) < 8:
        return b""
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_archives(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", dictionary: bytes | None = None) -> Stored:
    """Writes a record for every row into zstd archives in the shared folder and returns that table of segments.

    Of equal payloads of at least `least_bytes` bytes the least id is the response; the others are revisits of it.
    Null payloads are empty; null urls have an empty target.  Rows that share both id and payload are all responses;
    a null id refers to the least id of its equals, or is a response without one.  The least id comes from partial
    sums and the join that brings it to the payloads has one row a digest on its other side, so Spark can split a
    payload that a third of all pages share.
    """
    ship(pages.sparkSession)
    if dictionary is None:
        dictionary = train_dictionary(pages, payload_col)
    body = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), body.alias("payload"), F.sha1(body).alias("digest_hex"))
    firsts = (
        rows.where(F.col("id").isNotNull() & (F.octet_length("payload") >= least_bytes)).groupBy("digest_hex").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest_hex", "first")
    )
    may = F.octet_length("payload") >= least_bytes
    rows = rows.join(firsts, "digest_hex", "left").select("id", "url", "payload", F.when(may & ~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))
    lead = struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary if dictionary else b""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3, write_checksum=True, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

        def closed(parts: list[bytes]) -> pa.RecordBatch:
            archive = b"".join(parts)
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(archive).hexdigest()[:24]]), pa.array([archive], pa.binary())], ["segment", "archive"])

        parts, held = [lead], 0
        for batch in batches:
            for page, url, payload, refers in zip(*batch.columns, strict=True):
                payload = payload.as_py()
                parts.append(press.compress(make_record(page.as_py(), url.as_py(), payload, base32_sha1(payload), refers.as_py())))
                held += len(payload)
                if held >= SEGMENT_BYTES:
                    yield closed(parts)
                    parts, held = [lead], 0
        if len(parts) > 1:
            yield closed(parts)

    return Stored(rows.mapInArrow(run, "segment string, archive binary"), "warc")


def read_archives(archives: DataFrame, segment_col: str = "segment", archive_col: str = "archive", with_payload: bool = True) -> DataFrame:
    """RECORDS of all archives of a table (a segment's name and its bytes).

    Each frame is decoded by itself with the archive's dictionary; broken records are rows with a `problem`, and a
    broken archive ends with one.  Null archives give no rows.
    """

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            rows = [r for name, data in zip(batch.column(0), batch.column(1), strict=True) if data.is_valid for r in read_archive(name.as_py(), data.as_py(), with_payload)]
            if not rows:
                return None
            columns = list(zip(*rows, strict=True))
            kinds = [pa.string()] * 6 + [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in RECORDS.split(", ")])

        return each

    spread = archives.select(segment_col, archive_col)
    return map_arrow(spread, make, RECORDS)


def read_files(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """RECORDS of the .warc.zst files below a path, on any store that Spark reads."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").option("recursiveFileLookup", "true").load(path)
    return read_archives(files.select("path", "content"), "path", "content", with_payload)


def op1_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as records and read back; revisits learn their response from the archive's own headers."""
    stored = write_archives(table(spark, sf_dir, "pages"))
    records = read_archives(stored.read(), with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to_page").alias("refers_to"), "problem")


OP1_SQL = """
with p as (select page_id, coalesce(encode(html), ''::blob) b from pages),
d as (select page_id, octet_length(b) n, sha1(b) h from p),
e as (select *, min(page_id) over (partition by h) f,
  -- base32 of the digest, five bits at a time over its hexadecimal digits
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, 1 + (5 * i) // 4, 2) || case when (5 * i) // 4 + 2 > 40 then '0' else '' end)::int >> (8 - 5 - (5 * i) % 4)) & 31)::int, 1)), 'string_agg', '') s
  from d)
select page_id, n::bigint payload_bytes, s payload_digest, case when page_id = f then 'response' else 'revisit' end record_type,
  case when page_id <> f then f end refers_to, null::varchar problem from e
"""
