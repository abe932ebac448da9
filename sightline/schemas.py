"""Schemas of the domain tables (DDL text) and checks of their enumerations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORGANIZATIONS = "org_id string, org_name string, api_key_hash string, public_key_pem string, key_fingerprint string, private_key_encrypted binary, aes_key_encrypted binary, authorized_domains array<string>, active boolean, created_at timestamp"
REGISTERED_ASSETS = "asset_id string, org_id string, asset_type string, original_filename string, dna_vector binary, watermark_seed bigint, container_path string, metadata string, registered_at timestamp"
SIGHTINGS = "sighting_id string, asset_id string, platform string, source_url string, author_handle string, fusion_score double, severity string, layer_scores map<string,double>, proof_type string, embargo_violation boolean, dmca_generated boolean, evidence_path string, detected_at timestamp"
CUSTODY_LOG = "log_id string, asset_id string, event_type string, actor_hash string, prev_entry_hash string, entry_hash string, logged_at timestamp"
SESSIONS = "session_id string, session_data string, updated_at timestamp"
STREAM_ASSIGNMENTS = "stream_id string, subscriber_id string, org_id string, asset_id string, bit_sequence array<tinyint>, assigned_at timestamp, event_metadata string"
LEAKER_IDENTIFICATIONS = "id string, sighting_id string, subscriber_id string, stream_id string, confidence double, matched_segments int, total_segments int, identified_at timestamp"
ASSETS_DNA = "index_id bigint, asset_id string, clip array<double>, hog array<double>, color array<double>, dct array<double>, spatial array<double>, phash_hi bigint, phash_lo bigint, metadata string"
MEDIA_ITEMS = "source_url string, platform string, post_id string, author_handle string, media_bytes binary, media_type string, detected_at string, media_url string, domain string"

#: Fixed values of the enumerated columns.
ALLOWED = {
    "severity": ("CRITICAL", "HIGH", "MEDIUM", "LOW", "MISS"),
    "asset_type": ("image", "video", "clip"),
    "proof_type": ("CONTAINER_MATCH", "CRYPTOGRAPHIC_LAYER_MATCH", "FORENSIC_VISUAL_MATCH"),
}


def valid(column: str, of: Column | None = None) -> Column:
    """Whether an enumerated column holds one of its values; null counts as valid, as a CHECK does."""
    own = of if of is not None else F.col(column)
    return own.isNull() | own.isin(*ALLOWED[column])


def violations(df: DataFrame) -> DataFrame:
    """Rows that break the check of any enumerated column they have."""
    bad = F.lit(False)
    for column in ALLOWED:
        if column in df.columns:
            bad |= ~valid(column)
    return df.where(bad)
