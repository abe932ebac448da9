"""PNG files: chunks, and pixels of 8 bits without interlacing."""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    """(kind, payload) of a file's chunks; what is no such file has none, a cut one its whole chunks."""
    out, at = [], 8
    while data[:8] == MAGIC and at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        if at + 12 + size > len(data):
            break
        out.append((kind, data[at + 8 : at + 8 + size]))
        at += 12 + size
    return out


def written(parts: list[tuple[bytes, bytes]]) -> bytes:
    return MAGIC + b"".join(struct.pack(">I", len(p)) + k + p + struct.pack(">I", zlib.crc32(k + p)) for k, p in parts)


def with_chunk(data: bytes, kind: bytes, payload: bytes) -> bytes:
    """The file with one more chunk before its end, in place of any of that kind."""
    kept = [c for c in chunks(data) if c[0] != kind]
    ends = [c for c in kept if c[0] == b"IEND"]
    return written([c for c in kept if c[0] != b"IEND"] + [(kind, payload)] + ends)


def encode(pixels: np.ndarray) -> bytes:
    """Gray (height, width) or colour (height, width, 3) pixels."""
    p = np.asarray(pixels, dtype=np.uint8)
    rows = p.reshape(p.shape[0], -1)
    head = struct.pack(">IIBBBBB", p.shape[1], p.shape[0], 8, 2 if p.ndim == 3 else 0, 0, 0, 0)
    raw = np.concatenate([np.zeros((len(rows), 1), dtype=np.uint8), rows], axis=1).tobytes()
    return written([(b"IHDR", head), (b"IDAT", zlib.compress(raw)), (b"IEND", b"")])


def decode(data: bytes) -> np.ndarray | None:
    """Pixels (height, width, channels); None for what is not such a file."""
    parts = chunks(data)
    if not parts or parts[0][0] != b"IHDR":
        return None
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", parts[0][1][:13])
    if depth != 8 or colour not in CHANNELS or interlaced:
        return None
    step = CHANNELS[colour]
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(p for k, p in parts if k == b"IDAT")), dtype=np.uint8)
        raw = raw.reshape(height, 1 + width * step).astype(np.int64)
    except (zlib.error, ValueError):
        return None
    out = np.zeros((height + 1, width + 1, step), dtype=np.int64)  # a row above and a column before are zero
    for y in range(height):
        kind, line = raw[y, 0], raw[y, 1:].reshape(width, step)
        if kind in (0, 2):
            out[y + 1, 1:] = (line + (out[y, 1:] if kind == 2 else 0)) & 255
            continue
        for x in range(width):
            left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
            near = np.abs(np.stack([up - corner, left - corner, left + up - 2 * corner])).argmin(0)
            add = left if kind == 1 else (left + up) // 2 if kind == 3 else np.choose(near, [left, up, corner])
            out[y + 1, x + 1] = (line[x] + add) & 255
    return out[1:, 1:].astype(np.uint8)
