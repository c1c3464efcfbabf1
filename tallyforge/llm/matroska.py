"""Matroska: EBML elements, clusters, lacing and cues parsed into packet tables; and a writer of 8-bit PCM tracks."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_arrow, table

#: Fixed values of the format (RFC 8794, RFC 9559): element ids.
EBML, SEGMENT, SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x114D9B74, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION, AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER, CUE_RELATIVE = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1, 0xF0
MASTERS = frozenset({EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_POSITIONS})
#: Elements that end a cluster or segment of unknown size.
TOP = frozenset({SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, EBML, SEGMENT})

RATE = 8000
FRAME = 192
FRAMES_A_BLOCK = 8
BLOCKS_A_CLUSTER = 64
NO_LACE, XIPH, FIXED, EBML_LACE = range(4)


class Bad(ValueError):
    """Bytes that break the format."""


def vint(data, at: int, keep_marker: bool) -> tuple[int, int]:
    """A variable-length number and the place behind it; -1 for the reserved unknown size."""
    if at >= len(data):
        raise Bad("number is cut off")
    first = data[at]
    if not first:
        raise Bad(f"number at {at} is longer than eight bytes")
    n = 9 - first.bit_length()
    if at + n > len(data):
        raise Bad("number is cut off")
    value = int.from_bytes(data[at : at + n], "big")
    if keep_marker:
        return value, at + n
    value ^= 1 << 7 * n
    return (-1 if value == (1 << 7 * n) - 1 else value), at + n


def put_size(n: int) -> bytes:
    width = next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + put_size(len(body)) + body


def number(kind: int, value: int) -> bytes:
    return element(kind, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: int) -> bytes:
    """The body of a block behind its header: the lace's sizes and the frames."""
    if kind == NO_LACE:
        return frames[0]
    out = bytearray([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if kind == XIPH:
        for n in sizes[:-1]:
            out += b"\xff" * (n // 255) + bytes([n % 255])
    elif kind == EBML_LACE:
        out += put_size(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            d = b - a
            width = next(w for w in range(1, 9) if abs(d) < (1 << 7 * w - 1) - 1)
            out += (d + (1 << 7 * width - 1) - 1 | 1 << 7 * width).to_bytes(width, "big")
    elif len(set(sizes)) != 1:
        raise Bad("fixed lacing needs frames of one size")
    return bytes(out) + b"".join(frames)


def mux(payload: bytes, rate: int = RATE, frame: int = FRAME) -> bytes:
    """A file with one 8-bit mono PCM track.  Blocks hold FRAMES_A_BLOCK frames; the kinds of lacing take turns; each cluster has a cue."""
    head = element(EBML, number(EBML_VERSION, 1) + number(EBML_READ_VERSION, 1) + number(EBML_MAX_ID, 4) + number(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + number(DOC_TYPE_VERSION, 4) + number(DOC_TYPE_READ, 2))
    ms = lambda samples: samples * 1000 // rate
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / rate)) + element(MUXING_APP, b"t") + element(WRITING_APP, b"t"))
    audio = element(AUDIO, element(SAMPLING, struct.pack(">d", float(rate))) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + number(DEFAULT_DURATION, frame * 1_000_000_000 // rate) + audio))
    body, cues = [info, tracks], []
    at = len(info) + len(tracks)
    a_block, turn = frame * FRAMES_A_BLOCK, (XIPH, EBML_LACE, FIXED)
    for start in range(0, len(payload), a_block * BLOCKS_A_CLUSTER):
        base, blocks = ms(start), []
        for k, lo in enumerate(range(start, min(len(payload), start + a_block * BLOCKS_A_CLUSTER), a_block)):
            frames = [payload[i : i + frame] for i in range(lo, min(len(payload), lo + a_block), frame)]
            kind = turn[k % 3] if len(frames) > 1 else NO_LACE
            blocks.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", ms(lo) - base, 0x80 | kind << 1) + lace(frames, kind)))
        cluster = element(CLUSTER, number(TIMESTAMP, base) + b"".join(blocks))
        cues.append(element(CUE_POINT, number(CUE_TIME, base) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    return head + element(SEGMENT, b"".join([*body, element(CUES, b"".join(cues))]))


@dataclass
class Track:
    number: int = 0
    kind: int = 0
    codec: str = ""
    default_ns: int = 0
    rate: float = 8000.0
    channels: int = 1
    bits: int = 0


@dataclass
class Media:
    """tracks, packets as (track, timestamp in ns, byte offset, bytes, key frame, lacing, cluster), and cues as (time in ns, track, cluster offset)."""

    tracks: dict[int, Track] = field(default_factory=dict)
    packets: list[tuple[int, int, int, int, bool, int, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    scale: int = 1_000_000
    duration: float | None = None
    doc_type: str = ""


def walk(data, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, element's offset, body's offset, body's end) of the elements between two places.  An unknown size reaches to the next top element."""
    while at < end:
        start = at
        kind, at = vint(data, at, True)
        size, at = vint(data, at, False)
        if size < 0:
            if kind not in (SEGMENT, CLUSTER):
                raise Bad("only segments and clusters may have an unknown size")
            stop = end
            if kind == CLUSTER:
                p = at
                while p < end:
                    inner, q = vint(data, p, True)
                    if inner in TOP:
                        break
                    n, q = vint(data, q, False)
                    p = q + n
                stop = min(p, end)
        else:
            stop = at + size
        if stop > end:
            raise Bad(f"element {kind:#x} at {start} ends behind its parent")
        yield kind, start, at, stop
        at = stop


def uint(data, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def real(data, a: int, b: int) -> float:
    return struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0] if b - a in (4, 8) else 0.0


def unlace(data, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """(offset, bytes) of the frames of a block whose header ends at `at`."""
    if kind == NO_LACE:
        return [(at, end - at)]
    if at >= end:
        raise Bad("lace is cut off")
    n, at = data[at] + 1, at + 1
    if kind == FIXED:
        if (end - at) % n:
            raise Bad("fixed lace doesn't divide its block")
        sizes = [(end - at) // n] * n
    else:
        sizes = []
        for i in range(n - 1):
            if kind == XIPH:
                size = 0
                while True:
                    if at >= end:
                        raise Bad("lace is cut off")
                    size, at, last = size + data[at], at + 1, data[at]
                    if last < 255:
                        break
            else:
                width = 9 - data[at].bit_length()
                raw, at = vint(data, at, False)
                size = raw if i == 0 else sizes[-1] + (raw if raw >= 0 else (1 << 7 * width) - 1) - ((1 << 7 * width - 1) - 1)
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0 or at + sum(sizes) != end:
        raise Bad("lace sizes don't fit their block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def parse(data: bytes) -> Media:
    """Everything but the samples.  Raises Bad where the bytes break the format."""
    media, seen = Media(), False
    for kind, _, a, b in walk(data, 0, len(data)):
        if kind == EBML:
            for k, _, x, y in walk(data, a, b):
                if k == DOC_TYPE:
                    media.doc_type = bytes(data[x:y]).rstrip(b"\0").decode("ascii", "replace")
        elif kind == SEGMENT:
            seen = True
            read_segment(data, a, b, media)
    if not seen or media.doc_type not in ("matroska", "webm"):
        raise Bad("no Matroska segment")
    return media


def read_segment(data: bytes, a: int, b: int, media: Media) -> None:
    for kind, start, x, y in walk(data, a, b):
        if kind == INFO:
            for k, _, p, q in walk(data, x, y):
                if k == TIMESTAMP_SCALE:
                    media.scale = uint(data, p, q)
                elif k == DURATION:
                    media.duration = real(data, p, q)
        elif kind == TRACKS:
            for k, _, p, q in walk(data, x, y):
                if k == TRACK_ENTRY:
                    track = read_track(data, p, q)
                    media.tracks[track.number] = track
        elif kind == CLUSTER:
            media.clusters.append(start - a)
            read_cluster(data, x, y, media, len(media.clusters) - 1)
        elif kind == CUES:
            for k, _, p, q in walk(data, x, y):
                if k == CUE_POINT:
                    when, found = 0, []
                    for kk, _, r, s in walk(data, p, q):
                        if kk == CUE_TIME:
                            when = uint(data, r, s)
                        elif kk == CUE_POSITIONS:
                            at = {k3: uint(data, t, u) for k3, _, t, u in walk(data, r, s)}
                            found.append((at.get(CUE_TRACK, 0), at.get(CUE_CLUSTER, 0)))
                    media.cues += [(when * media.scale, t, c) for t, c in found]


def read_track(data: bytes, a: int, b: int) -> Track:
    t = Track()
    for k, _, p, q in walk(data, a, b):
        if k == TRACK_NUMBER:
            t.number = uint(data, p, q)
        elif k == TRACK_TYPE:
            t.kind = uint(data, p, q)
        elif k == CODEC_ID:
            t.codec = bytes(data[p:q]).decode("ascii", "replace")
        elif k == DEFAULT_DURATION:
            t.default_ns = uint(data, p, q)
        elif k == AUDIO:
            for kk, _, r, s in walk(data, p, q):
                if kk == SAMPLING:
                    t.rate = real(data, r, s)
                elif kk == CHANNELS:
                    t.channels = uint(data, r, s)
                elif kk == BIT_DEPTH:
                    t.bits = uint(data, r, s)
    return t


def read_cluster(data: bytes, a: int, b: int, media: Media, cluster: int) -> None:
    base = 0
    for k, _, p, q in walk(data, a, b):
        if k == TIMESTAMP:
            base = uint(data, p, q)
        elif k == SIMPLE_BLOCK:
            read_block(data, p, q, base, None, media, cluster)
        elif k == BLOCK_GROUP:
            inner = [(kk, r, s) for kk, _, r, s in walk(data, p, q)]
            key = all(kk != REFERENCE for kk, _, _ in inner)
            for kk, r, s in inner:
                if kk == BLOCK:
                    read_block(data, r, s, base, key, media, cluster)


def read_block(data: bytes, a: int, b: int, base: int, key: bool | None, media: Media, cluster: int) -> None:
    track, at = vint(data, a, False)
    if at + 3 > b:
        raise Bad("block header is cut off")
    relative, flags = struct.unpack_from(">hB", data, at)
    lacing = flags >> 1 & 3
    known = media.tracks.get(track)
    step = known.default_ns if known else 0
    start = (base + relative) * media.scale
    for i, (offset, size) in enumerate(unlace(data, at + 3, b, lacing)):
        media.packets.append((track, start + i * step, offset, size, bool(flags & 0x80) if key is None else key, lacing, cluster))


def samples(data: bytes, media: Media, track: int = 1) -> bytes:
    return b"".join(data[o : o + n] for t, _, o, n, *_ in media.packets if t == track)


PACKETS = "track int, timestamp_ns long, byte_offset long, bytes long, keyframe boolean, lacing int, cluster int, problem string"


def packets(files: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row (id_col, PACKETS) for each packet of each file, in file order.

    A file that breaks the format gives one row with its `problem`; null files give none; a file without packets gives none.
    """
    kind = dict(files.dtypes)[id_col]

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            which, rows = [], []
            for i, data in enumerate(batch.column(1)):
                if data.is_valid:
                    try:
                        got = [(*p, None) for p in parse(data.as_py()).packets]
                    except Bad as e:
                        got = [(None,) * 7 + (str(e),)]
                    rows += got
                    which += [i] * len(got)
            if not rows:
                return None
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.string()]
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which)), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], [id_col, *(f.split()[0] for f in PACKETS.split(", "))])

        return each

    return map_arrow(files.select(id_col, media_col), make, f"`{id_col}` {kind}, {PACKETS}")


def pad(payload: bytes, unit: int = FRAME) -> bytes:
    """The bytes and blanks up to a positive multiple of the unit."""
    return payload.ljust(max(1, -(-len(payload) // unit)) * unit, b" ")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, media binary): every whole text as the 8-bit samples of one file.  Null is the empty text; copies and null ids stay."""
    kind = dict(docs.dtypes)[id_col]

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, media = [], []
            for x in batch.column(1):
                raw = (x.as_py() or "").encode()
                n.append(len(raw))
                media.append(mux(pad(raw)))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(media, pa.binary())], [id_col, "n_bytes", "media"])

        return each

    return map_arrow(docs.select(id_col, text_col), make, f"`{id_col}` {kind}, n_bytes long, media binary")


def feature(payload: bytes, media: Media) -> str:
    """Packets, clusters, cues, milliseconds, and of the samples as signed sound: mean, loudness, zero crossings, loudest packet's sum of squares."""
    x = np.frombuffer(payload, np.uint8).astype(np.int32) - 128
    energy = int((x.astype(np.int64) ** 2).sum())
    crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    sizes = np.array([p[3] for p in media.packets])
    peak = int(np.add.reduceat(x.astype(np.int64) ** 2, np.concatenate(([0], np.cumsum(sizes)[:-1]))).max())
    return f"packets={len(media.packets)};clusters={len(media.clusters)};cues={len(media.cues)};ms={len(x) * 1000 // RATE};mean={x.mean():.6f};rms={(energy / len(x)) ** 0.5:.6f};zc={crossings};peak={peak}"


def features(files: DataFrame, id_col: str = "doc_id", media_col: str = "media", keep: tuple[str, ...] = ("n_bytes",)) -> DataFrame:
    """Reads stored files: their samples' length, digest, the crc of the last 16, the file's own, and `feature`.

    A broken file raises, as its row could not be told from a right one.  Null files give null results.
    """
    kinds = dict(files.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in (id_col, *keep)] + ["payload_bytes long", "payload_sha256 string", "tail_crc32 long", "media_bytes long", "media_sha256 string", "feature string"])

    def make():
        def one(data: bytes | None) -> tuple:
            if data is None:
                return (None,) * 6
            media = parse(data)
            payload = samples(data, media)
            return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload, media)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [one(x.as_py()) for x in batch.column(1 + len(keep))]
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            return pa.RecordBatch.from_arrays([*batch.columns[: 1 + len(keep)], *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], [id_col, *keep, *names])

        return each

    return map_arrow(files.select(id_col, *keep, media_col), make, schema)


def op4_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(encode(table(spark, sf_dir, "documents")))
