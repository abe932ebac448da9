"""Vector and hash similarities as column expressions, computed in double."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the fingerprint layers.
WEIGHTS = {"clip": 0.40, "phash": 0.15, "color": 0.10, "hog": 0.05, "dct": 0.15, "spatial": 0.15}
#: Added to the weights of a transformed copy; the sum then exceeds 1 and the score is not clamped.
TRANSFORMED_WEIGHTS = {"clip": 0.15, "spatial": 0.05}
HASH_BITS = 64


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product; null where the sizes differ."""
    return F.when(F.size(a) == F.size(b), total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine with 1e-8 added to each norm, so that a zero vector gives 0."""
    return dot(a, b) / ((norm(a) + 1e-8) * (norm(b) + 1e-8))


def scaled(a: Column) -> Column:
    """The vector over its norm plus 1e-8: inner products of such vectors are ``cosine``'s values."""
    return F.transform(F.arrays_zip(a.alias("x"), F.array_repeat(norm(a) + 1e-8, F.size(a)).alias("n")), lambda z: z["x"].cast("double") / z["n"])


def normalize(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    size = norm(a)
    return F.when(size > 0, F.transform(a, lambda x: x.cast("double") / size)).otherwise(a)


def hamming(hi_a: Column, lo_a: Column, hi_b: Column, lo_b: Column) -> Column:
    """Differing bits of two hashes held as two longs."""
    return F.bit_count(hi_a.bitwiseXOR(hi_b)) + F.bit_count(lo_a.bitwiseXOR(lo_b))


def hash_halves(hex_hash: Column) -> tuple[Column, Column]:
    """A 16-digit hexadecimal hash as two longs of 32 bits each: a signed long cannot hold its top bit."""
    padded = F.lpad(hex_hash, 16, "0")
    return F.conv(F.substring(padded, 1, 8), 16, 10).cast("long"), F.conv(F.substring(padded, 9, 8), 16, 10).cast("long")


def hash_similarity(distance: Column) -> Column:
    return 1.0 - distance / float(HASH_BITS)


def sign_bits(values: Column, first: int, count: int = 32) -> Column:
    """The signs of ``count`` values from position ``first`` (from 1) as a long, the first value highest."""
    return F.aggregate(F.slice(values, first, count), F.lit(0).cast("long"), lambda a, x: a * 2 + F.when(x > 0, 1).otherwise(0))


def fusion_score(similarities: Mapping[str, Column], transformed: Column | None = None, weights: Mapping[str, float] = WEIGHTS) -> Column:
    """Weighted sum of the layers' similarities; a missing layer counts 0."""
    out = F.lit(0.0)
    for layer, weight in weights.items():
        w = F.lit(weight)
        if transformed is not None and layer in TRANSFORMED_WEIGHTS:
            w = F.when(transformed, weight + TRANSFORMED_WEIGHTS[layer]).otherwise(weight)
        out = out + w * F.coalesce(similarities[layer], F.lit(0.0))
    return out


def clipped_similarity(distance: Column) -> Column:
    """1 less the distance clipped to 0..1, as audio and sequence matches use it."""
    return 1.0 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), distance))


def unpack_float32(raw: Column) -> Column:
    """Little-endian float32 bytes as an array."""

    @F.pandas_udf("array<float>")
    def unpacked(raw: pd.Series) -> pd.Series:
        import numpy as np

        return raw.map(lambda b: None if b is None else np.frombuffer(b, dtype="<f4"))

    return unpacked(raw)


def pack_float32(values: Column) -> Column:
    @F.pandas_udf("binary")
    def packed(values: pd.Series) -> pd.Series:
        import numpy as np

        return values.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())

    return packed(values)
