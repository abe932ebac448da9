"""Severity levels: thresholds, ranks, upgrades and match rules as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rising ladder, rank of a name (an unknown one ranks 2), threshold sets, proof types from the strongest.
LADDER = ("MISS", "LOW", "MEDIUM", "HIGH", "CRITICAL")
UNKNOWN_RANK = 2
SETTINGS = (0.96, 0.87, 0.74, 0.60)
FUSION_THRESHOLDS = (0.96, 0.88, 0.75)
CLASSIFY_THRESHOLDS = (0.94, 0.85, 0.72)
PROOFS = ("CONTAINER_MATCH", "CRYPTOGRAPHIC_LAYER_MATCH", "TEMPORAL_WATERMARK_MATCH", "AUDIO_WATERMARK_MATCH", "STREAM_FINGERPRINT_MATCH", "FORENSIC_VISUAL_MATCH", "DORK_DOMAIN_HIT")
#: Watch and none are kept as LOW and MISS in stored tables.
STORED = {"WATCH": "LOW", "NONE": "MISS"}


def rank(severity: Column) -> Column:
    out = F.lit(UNKNOWN_RANK)
    for i, name in enumerate(LADDER):
        out = F.when(severity == name, i).otherwise(out)
    return out


def at_least(severity: Column, least: str) -> Column:
    """Severity of the least name's rank or more: the set of names is folded before the plan is made."""
    floor = LADDER.index(least.upper()) if least.upper() in LADDER else UNKNOWN_RANK
    return severity.isin(*[name for i, name in enumerate(LADDER) if i >= floor])


def classify(score: Column, critical: Column | float, high: Column | float, medium: Column | float) -> Column:
    """Four levels; a score on a threshold reaches it."""
    return F.when(score >= critical, "CRITICAL").when(score >= high, "HIGH").when(score >= medium, "MEDIUM").otherwise("MISS")


def classify_watch(score: Column, thresholds: Sequence[float] = SETTINGS) -> Column:
    """Five levels, with WATCH and NONE below MEDIUM."""
    critical, high, medium, watch = thresholds
    return F.when(score >= critical, "CRITICAL").when(score >= high, "HIGH").when(score >= medium, "MEDIUM").when(score >= watch, "WATCH").otherwise("NONE")


def stored(severity: Column) -> Column:
    return F.when(severity == "WATCH", "LOW").when(severity == "NONE", "MISS").otherwise(severity)


def within_embargo(as_of: Column, until: Column) -> Column:
    """Whether ``as_of`` lies before an ISO time; false where it is null or malformed. A trailing Z is dropped, the time taken as UTC."""
    return F.coalesce(as_of < F.try_to_timestamp(F.regexp_replace(until, "Z+$", "")), F.lit(False))


def upgrade(severity: Column) -> Column:
    """One level up; CRITICAL and unknown names stay."""
    at = F.array_position(F.array(*[F.lit(x) for x in LADDER]), severity)
    return F.when(at == 0, severity).otherwise(F.element_at(F.array(*[F.lit(x) for x in LADDER]), F.least(at + 1, F.lit(len(LADDER))).cast("int")))


def embargo_severity(severity: Column, active: Column) -> tuple[Column, Column]:
    """The upgraded severity, and whether it changed: a miss is never upgraded."""
    new = F.when(active & (severity != "MISS"), upgrade(severity)).otherwise(severity)
    return new, new != severity


def thresholds(width: Column, height: Column, transformed: Column, base: Sequence[float] = SETTINGS) -> tuple[Column, Column, Column]:
    """Critical, high and medium for an image: lower for under 160000 pixels and for transformed copies."""
    small = width * height < 400 * 400
    critical, high, medium = base[:3]
    return (
        F.lit(critical) - F.when(small, 0.02).otherwise(0.0) - F.when(transformed, 0.01).otherwise(0.0),
        F.lit(high) - F.when(small, 0.03).otherwise(0.0) - F.when(transformed, 0.02).otherwise(0.0),
        F.lit(medium) - F.when(small, 0.05).otherwise(0.0),
    )


def regional_boost(score: Column, regions: Column) -> Column:
    """Lift a score by its regional scores: any above .92 (score above .65) to .82, or a mean above .75 (score above .60) to .76. No regions: no lift."""
    most, mean = F.array_max(regions), F.aggregate(regions, F.lit(0.0), lambda a, x: a + x) / F.size(regions)
    return F.when(F.coalesce(F.size(regions), F.lit(0)) <= 0, score).when((most > 0.92) & (score > 0.65), F.greatest(score, F.lit(0.82))).when((mean > 0.75) & (score > 0.60), F.greatest(score, F.lit(0.76))).otherwise(score)


def is_transformed(clip: Column, dct_product: Column) -> Column:
    return (clip > 0.85) & F.coalesce(dct_product < 0.3, F.lit(True))


def is_clone(clip: Column, phash_similarity: Column) -> Column:
    return (clip > 0.90) & (phash_similarity < 0.50)


def match_status(severity: Column, score: Column, watch: float = SETTINGS[3]) -> Column:
    """The severity of a kept match, RE_EVAL_NEEDED for a miss above the watch threshold, null for a match that is dropped."""
    return F.when(severity != "MISS", severity).when(score > watch, "RE_EVAL_NEEDED")


def video_severity(frames: Column, cryptographic: Column) -> Column:
    return F.when(cryptographic, "CRITICAL").when(frames >= 2, "HIGH").otherwise("LOW")


def proof_rank(proof: Column) -> Column:
    """Position from the strongest, 1; unknown proofs come last."""
    at = F.array_position(F.array(*[F.lit(p) for p in PROOFS]), proof)
    return F.when(at == 0, len(PROOFS) + 1).otherwise(at)
