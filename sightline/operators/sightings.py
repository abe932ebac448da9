"""Queries and mutations of the sighting store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import severity as sev
from ..functions import texts


def recent(sightings: DataFrame, assets: DataFrame, as_of, org_id=None, hours: int = 24, min_severity: str = "MEDIUM", limit: int = 500) -> DataFrame:
    """An organisation's newest sightings of a least severity in the last hours."""
    if not 1 <= hours <= 720:
        raise ValueError("hours must be from 1 to 720")
    if min_severity is not None and min_severity.upper() not in sev.LADDER:
        raise ValueError(f"no severity {min_severity}")
    since = F.lit(as_of) - F.make_interval(hours=F.lit(hours))
    own = assets if org_id is None else assets.where(F.col("org_id") == org_id)
    rows = sightings.where((F.col("detected_at") >= since) & sev.at_least(F.col("severity"), min_severity or "MEDIUM"))
    return rows.join(own, "asset_id").orderBy(F.desc("detected_at"), "sighting_id").limit(limit)


def checked_arguments(hours: Column, severity: Column) -> tuple[Column, Column]:
    """Whether a listing's arguments are valid (hours from 1 to 720, a known severity or none), and the severity that is meant."""
    name = F.upper(F.coalesce(severity, F.lit("MEDIUM")))
    return hours.between(1, 720) & name.isin(*sev.LADDER), name


def listed(sightings: DataFrame) -> DataFrame:
    """Sightings as they are returned: ids as text, times in ISO form."""
    return sightings.withColumns({"sighting_id": F.col("sighting_id").cast("string"), "asset_id": F.col("asset_id").cast("string"), "detected_at": F.date_format("detected_at", "yyyy-MM-dd'T'HH:mm:ss")})


def assets_to_rescan(sightings: DataFrame, as_of, hours: int = 168) -> DataFrame:
    since = F.lit(as_of) - F.make_interval(hours=F.lit(hours))
    return sightings.where(F.col("severity").isin("HIGH", "CRITICAL") & (F.col("detected_at") >= since)).select("asset_id").distinct()


def active_windows(assets: DataFrame, as_of, limit: int = 100) -> DataFrame:
    """Assets whose broadcast window holds ``as_of``, ordered by the window's text."""
    start, end = texts.window_bounds(F.col("broadcast_window"))
    now = F.lit(as_of).cast("timestamp")
    rows = assets.where(F.col("broadcast_window").isNotNull() & (start <= now) & (now <= end))
    return rows.orderBy("broadcast_window", "asset_id").limit(limit)


def embargoed(assets: DataFrame, as_of) -> DataFrame:
    return assets.where(sev.within_embargo(F.lit(as_of).cast("timestamp"), F.col("embargo_until")))


def alerts(sightings: DataFrame, limit: int = 30) -> DataFrame:
    """The best-scored sightings of high and critical severity."""
    return sightings.where(F.col("severity").isin("HIGH", "CRITICAL")).orderBy(F.desc("fusion_score"), "sighting_id").limit(limit)


def upsert(rows: DataFrame, updates: DataFrame, key: str, at: str) -> DataFrame:
    """Insert or replace by key: the newest row of each key stays."""
    both = rows.unionByName(updates)
    return both.groupBy(key).agg(F.max_by(F.struct(*[c for c in both.columns if c != key]), F.col(at)).alias("row")).select(key, "row.*")


def marked(rows: DataFrame, key: str, values: DataFrame, **columns) -> DataFrame:
    """Set columns on the rows whose key is among ``values``."""
    hit = values.select(F.col(values.columns[0]).alias(key)).distinct().withColumn("_hit", F.lit(True))
    out = rows.join(hit, key, "left")
    for name, value in columns.items():
        old = F.col(name) if name in rows.columns else F.lit(None)
        out = out.withColumn(name, F.when(F.col("_hit"), value).otherwise(old))
    return out.drop("_hit")


def best_per(rows: DataFrame, keys: list[str], score: str = "fusion_score") -> DataFrame:
    """The best-scored row of each key; ties go to the smaller values of the other columns."""
    order = [F.desc(score), *[c for c in rows.columns if c not in keys and c != score and rows.schema[c].dataType.typeName() not in ("array", "map", "struct")]]
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")


def storable(items: DataFrame) -> DataFrame:
    """Items that the storage stage keeps: a severity other than MISS, and an asset."""
    return items.where(F.col("severity").isNotNull() & (F.col("severity") != "MISS") & F.col("asset_id").isNotNull())
