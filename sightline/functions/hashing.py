"""Hashes: keys, request fingerprints, ring positions, commitments and Bloom positions."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def key_hash(key: Column) -> Column:
    return F.sha2(key, 256)


def usable_key(key: Column) -> Column:
    return F.length(key).between(16, 128)


def request_fingerprint(method: Column, url: Column, body: Column) -> Column:
    return F.sha2(F.concat(method, url, F.coalesce(body, F.lit(""))), 256)


def ring_position(key: Column) -> Column:
    """The first four bytes of the MD5 sum as an unsigned number."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def commitment(asset_id: Column, canonical_json: Column, owner: Column, suffix: str = "") -> Column:
    """Asset, hash of the canonical JSON and hash of the owner, joined by bars and hashed."""
    return F.sha2(F.concat_ws("|", asset_id, F.sha2(canonical_json, 256), F.sha2(F.concat(owner, F.lit(suffix)), 256)), 256)


def bloom_size(capacity: int, rate: float) -> tuple[int, int]:
    """Bits and hash functions."""
    bits = math.ceil(-capacity * math.log(rate) / math.log(2) ** 2)
    return bits, max(1, round(bits / capacity * math.log(2)))


def bloom_positions(bits: int, hashes: int):
    """A function of a string column: its positions, from 8 bytes of SHA-256 and (odd) 8 bytes of MD5."""

    @F.pandas_udf("array<bigint>")
    def positions(items: pd.Series) -> pd.Series:
        import hashlib

        def own(item: str) -> list[int]:
            data = item.encode()
            first, step = int.from_bytes(hashlib.sha256(data).digest()[:8], "big"), int.from_bytes(hashlib.md5(data).digest()[:8], "big") | 1
            return [(first + i * step) % bits for i in range(hashes)]

        return items.map(lambda x: None if x is None else own(x))

    return positions


def sha3_256(content: Column) -> Column:
    """Hexadecimal SHA3-256 of bytes."""

    @F.pandas_udf("string")
    def hashed(content: pd.Series) -> pd.Series:
        import hashlib

        return content.map(lambda b: None if b is None else hashlib.sha3_256(bytes(b)).hexdigest())

    return hashed(content)


def stream_bits(subscriber: str, segments: int) -> Sequence[int]:
    """The A/B variant of each segment that a subscriber gets."""
    import hashlib

    import numpy as np

    return np.random.RandomState(int(hashlib.sha256(subscriber.encode()).hexdigest()[:8], 16)).randint(0, 2, segments).tolist()
