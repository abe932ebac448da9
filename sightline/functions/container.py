"""The media container: fixed header, identity, hashes, vectors, watermark, custody chain, image, checksum."""

from __future__ import annotations

import hashlib
import struct
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

#: Fixed values of the format: magic, version, end mark, flags, layers in order, image formats, custody events.
MAGIC, VERSION, END = bytes.fromhex("8953444e410d0a1a"), 1, b"EOF!"
ENCRYPTED, WATERMARKED, SIGNED, TAMPER_EVIDENT, EMBARGOED = 1, 2, 4, 8, 16
LAYERS = ("clip", "phash", "hog", "color", "dct", "spatial")
IMAGE_FORMATS = {"png": 0x504E4700, "jpeg": 0x4A504547, "webp": 0x57454250, "h265": 0x48323635}
EVENTS = ("REGISTERED", "DISTRIBUTED", "LICENSED", "VIOLATION", "DMCA_FILED")
_HEADER, _IDENTITY, _CRYPTO, _ENTRY = struct.Struct(">8sHII"), struct.Struct(">16s16sQQ32sH"), struct.Struct(">64s32s32s12s16s"), struct.Struct(">QB16s32s")

SCHEMA = (
    "version int, flags int, asset_uuid string, org_uuid string, signed_at bigint, embargo_until bigint, fingerprint binary, org_name string, signature binary, image_hash binary, vector_hash binary, "
    "nonce binary, tag binary, identity binary, vectors_raw binary, vectors map<string,array<float>>, watermark_seed bigint, watermark binary, custody array<struct<ts_ns:bigint,event:int,actor:binary,prev:binary>>, "
    "image_format bigint, image binary, custody_valid boolean, image_valid boolean, error string"
)


def pack_vectors(vectors: dict) -> bytes:
    parts = []
    for layer in LAYERS:
        raw = b"" if vectors.get(layer) is None else np.asarray(vectors[layer], dtype="<f4").tobytes()
        parts.append(struct.pack(">I", len(raw)) + raw)
    return b"".join(parts)


def unpack_vectors(raw: bytes) -> dict:
    """Layers in order, each a length and float32 values; a length of 0 is a missing layer, an early end leaves the rest out."""
    out, at = {}, 0
    for layer in LAYERS:
        if at + 4 > len(raw):
            break
        (size,) = struct.unpack_from(">I", raw, at)
        out[layer] = np.frombuffer(raw[at + 4 : at + 4 + size], dtype="<f4").tolist() if size else None
        at += 4 + size
    return out


def chained(events: list[tuple[int, int, bytes]]) -> list[tuple[int, int, bytes, bytes]]:
    """Custody entries, each with the hash of the one before; the first has zeros."""
    out, before = [], bytes(32)
    for ts, event, actor in events:
        out.append((ts, event, actor, before))
        before = hashlib.sha3_256(_ENTRY.pack(ts, event, actor, before)).digest()
    return out


def chain_valid(entries: list) -> bool:
    return all(b[3] == hashlib.sha3_256(_ENTRY.pack(*a)).digest() for a, b in zip(entries, entries[1:]))


def pack(asset: str, org: str, org_name: str, signed_at: int, image: bytes, vectors: dict, image_format: int = IMAGE_FORMATS["png"], watermark_seed: int = 0, watermark: bytes = b"", custody: list | None = None, embargo_until: int = 0, fingerprint: bytes = bytes(32), signature: bytes = bytes(64), nonce: bytes = bytes(12), sealed: tuple[bytes, bytes] | None = None) -> bytes:
    """A container's bytes. ``sealed`` has the encrypted vectors and their tag; keys, clocks and nonces are the caller's, so equal inputs give equal bytes."""
    name, plain = org_name.encode(), pack_vectors(vectors)
    org_id = uuid.UUID(org).bytes
    identity = _IDENTITY.pack(uuid.UUID(asset).bytes, org_id, signed_at, embargo_until, fingerprint, len(name)) + name
    held, tag = sealed or (plain, bytes(16))
    flags = ENCRYPTED * bool(sealed) | WATERMARKED * bool(watermark) | SIGNED * any(signature) | TAMPER_EVIDENT | EMBARGOED * (embargo_until > signed_at)
    entries = custody if custody is not None else chained([(signed_at, 0, hashlib.md5(org_id).digest())])
    body = identity + _CRYPTO.pack(signature, hashlib.sha3_256(image).digest(), hashlib.sha3_256(plain).digest(), nonce, tag)
    body += struct.pack(">I", len(held)) + held + struct.pack(">II", watermark_seed, len(watermark)) + watermark
    body += struct.pack(">I", len(entries)) + b"".join(_ENTRY.pack(*e) for e in entries) + struct.pack(">IQ", image_format, len(image)) + image
    whole = _HEADER.pack(MAGIC, VERSION, 18 + len(body), flags) + body
    return whole + hashlib.sha3_256(whole).digest() + END


def unpack(data: bytes) -> dict:
    """A container's parts. A file that is too short, has other magic, no end mark or another checksum gives only ``error``."""
    try:
        if len(data) < 54:
            raise ValueError("too small")
        magic, version, _, flags = _HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("wrong magic")
        if data[-4:] != END:
            raise ValueError("no end mark")
        if hashlib.sha3_256(data[:-36]).digest() != data[-36:-4]:
            raise ValueError("checksum differs")
        asset, org, signed_at, embargo, fingerprint, length = _IDENTITY.unpack_from(data, 18)
        at = 18 + _IDENTITY.size + length
        identity = data[18:at]
        signature, image_hash, vector_hash, nonce, tag = _CRYPTO.unpack_from(data, at)
        at += _CRYPTO.size
        (size,) = struct.unpack_from(">I", data, at)
        held, at = data[at + 4 : at + 4 + size], at + 4 + size
        seed, size = struct.unpack_from(">II", data, at)
        watermark, at = data[at + 8 : at + 8 + size], at + 8 + size
        (count,) = struct.unpack_from(">I", data, at)
        entries = [_ENTRY.unpack_from(data, at + 4 + i * _ENTRY.size) for i in range(count)]
        at += 4 + count * _ENTRY.size
        image_format, size = struct.unpack_from(">IQ", data, at)
        image = data[at + 12 : at + 12 + size]
        return {
            "version": version, "flags": flags, "asset_uuid": str(uuid.UUID(bytes=asset)), "org_uuid": str(uuid.UUID(bytes=org)), "signed_at": signed_at, "embargo_until": embargo, "fingerprint": fingerprint,
            "org_name": identity[_IDENTITY.size :].decode(), "signature": signature, "image_hash": image_hash, "vector_hash": vector_hash, "nonce": nonce, "tag": tag, "identity": identity, "vectors_raw": held,
            "vectors": None if flags & ENCRYPTED else unpack_vectors(held), "watermark_seed": seed, "watermark": watermark, "custody": [dict(zip(("ts_ns", "event", "actor", "prev"), e)) for e in entries],
            "image_format": image_format, "image": image, "custody_valid": chain_valid(entries), "image_valid": hashlib.sha3_256(image).digest() == image_hash, "error": None,
        }
    except (ValueError, struct.error, UnicodeDecodeError) as e:
        return {"error": str(e)}


def parsed(content):
    """The parts of each container, as a struct column."""

    @F.pandas_udf(SCHEMA)
    def parts(content: pd.Series) -> pd.DataFrame:
        names = [x.split()[0] for x in _fields(SCHEMA)]
        docs = [unpack(bytes(c)) if c is not None else {"error": "null"} for c in content]
        return pd.DataFrame({n: pd.Series([d.get(n) for d in docs], dtype=object) for n in names})

    return parts(content)


def _fields(ddl: str) -> list[str]:
    out, depth = [""], 0
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def decrypted(nonce, sealed, tag, key, identity):
    """Decrypted vectors as a column expression: AES-GCM with the identity block as associated data."""
    return F.aes_decrypt(F.concat(nonce, sealed, tag), key, F.lit("GCM"), F.lit("DEFAULT"), identity)


def opened(blob, key, associated):
    """What was sealed as nonce, ciphertext and tag in one; null if the key or the associated data are others."""
    return F.try_aes_decrypt(blob, key, F.lit("GCM"), F.lit("DEFAULT"), associated)


def png_chunk(data: bytes, kind: bytes = b"dnAx") -> bytes | None:
    """The payload of an image's first private chunk of a kind; None without one."""
    at = 8
    while data[:8] == b"\x89PNG\r\n\x1a\n" and at + 8 <= len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        if name == kind:
            return data[at + 8 : at + 8 + size]
        at += 12 + size
    return None
