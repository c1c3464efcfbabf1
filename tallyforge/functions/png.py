"""Pixels of PNG files, for the mean luminance of marks: 8-bit grey, RGB and their alpha forms without interlace."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def pixels(data: bytes) -> np.ndarray:
    """height x width x channels; other kinds of PNG, and what is none, raise ValueError."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, body, head = 8, b"", None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body += part
        at += 12 + n
    if head is None or head[2] != 8 or head[3] not in CHANNELS or head[6]:
        raise ValueError("this kind of PNG isn't read")
    width, height, c = head[0], head[1], CHANNELS[head[3]]
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * c)
    out = np.zeros((height, width * c), np.int64)
    for y in range(height):
        how, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        up = out[y - 1] if y else np.zeros(width * c, np.int64)
        if how == 0:
            out[y] = line
        elif how == 2:
            out[y] = (line + up) % 256
        else:
            for x in range(width * c):
                left = out[y, x - c] if x >= c else 0
                corner = up[x - c] if x >= c else 0
                if how == 1:
                    guess = left
                elif how == 3:
                    guess = (left + up[x]) // 2
                else:
                    p = left + up[x] - corner
                    guess = min((abs(p - left), 0, left), (abs(p - up[x]), 1, up[x]), (abs(p - corner), 2, corner))[2]
                out[y, x] = (line[x] + guess) % 256
    return out.reshape(height, width, c)


def mean_luminance(data: bytes) -> float | None:
    """Of the painted pixels (alpha above 0), in the web's relative luminance; None where nothing is painted."""
    p = pixels(data)
    c = p.shape[2]
    painted = p[..., -1] > 0 if c in (2, 4) else np.ones(p.shape[:2], bool)
    if not painted.any():
        return None
    rgb = (p[..., :3] if c >= 3 else np.repeat(p[..., :1], 3, 2))[painted] / 255
    linear = np.where(rgb <= 0.04045, rgb / 12.92, ((rgb + 0.055) / 1.055) ** 2.4)
    return float((linear @ np.array([0.2126, 0.7152, 0.0722])).mean())


def encode_grey(rows: np.ndarray) -> bytes:
    """A plain 8-bit grey PNG."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = b"".join(b"\0" + r.astype(np.uint8).tobytes() for r in rows)
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", rows.shape[1], rows.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
