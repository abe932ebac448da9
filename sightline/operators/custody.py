"""Custody chains: linking, checking and proofs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import severity as sev

ZERO = "0" * 64


def entry_hash(*parts: Column) -> Column:
    """SHA-256 of the joined parts: the form that SQL engines share. Containers use SHA3 (``functions.container``)."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def checked(entries: DataFrame, asset: str, order: list, own: str, previous: str, strict: bool = False) -> DataFrame:
    """Per asset: entries and whether every entry names the hash of the one before; strict: the first names zeros. Chains of one are valid."""
    before = F.lag(own).over(Window.partitionBy(asset).orderBy(*order))
    first = F.lit(True) if not strict else F.col(previous) == ZERO
    linked = F.when(before.isNull(), first).otherwise(F.col(previous) == before)
    return entries.withColumn("_linked", linked).groupBy(asset).agg(F.count(F.lit(1)).alias("entries"), F.bool_and("_linked").alias("valid"))


def strongest_proof(proofs: DataFrame, key: str) -> DataFrame:
    return proofs.groupBy(key).agg(F.min_by("proof_type", sev.proof_rank(F.col("proof_type"))).alias("proof_type"))


def cascade(container: Column, chunk: Column, packet: Column) -> Column:
    """The first layer that verifies, of container, image chunk and metadata packet."""
    return F.when(container, "CONTAINER_MATCH").when(chunk | packet, "CRYPTOGRAPHIC_LAYER_MATCH").otherwise("NONE")


def decided(valid: Column, fusion: Column, least: float = 0.75) -> tuple[Column, Column]:
    """Score and severity of an upload: a verified container is certain; else a fusion score above the threshold is HIGH."""
    score = F.when(valid, 1.0).otherwise(fusion)
    return score, F.when(valid, "CRITICAL").when(fusion > least, "HIGH").otherwise("MISS")


#: What a stored proof must have.
PROOF_PARTS = ("asset_id", "commitment", "signature", "timestamp", "algo", "v")


def complete_proof(proof: Column) -> Column:
    """Whether a proof (JSON) has all of its parts."""
    out = F.lit(True)
    for part in PROOF_PARTS:
        out &= F.get_json_object(proof, f"$.{part}").isNotNull()
    return out
