"""Domain tables over the star-schema test tables: events stand for sightings, embeddings for fingerprints, pages for crawls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import severity as sev
from .functions import similarity as sim
from .functions import urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = ((F.col("event_id") * 7919) % 1000).cast("double") / 1000
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("sighting_id"), F.col("user_id").alias("asset_id"), F.col("event_type").alias("platform"), F.col("ts").alias("detected_at"), score.alias("fusion_score"), "value", "props"
    )
    return rows.withColumn("severity", sev.stored(sev.classify_watch(F.col("fusion_score"))))


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One asset per user; windows, embargoes and leagues follow from the id."""
    ids = table(spark, sf_dir, "events").select(F.col("user_id").alias("asset_id")).distinct()
    a = F.col("asset_id")
    day = F.lpad((a % 28 + 1).cast("string"), 2, "0")
    start, end = F.concat(F.lit("2024-01-"), day, F.lit("T00:00:00")), F.concat(F.lit("2024-01-"), day, F.lit("T23:59:59"))
    window = F.when(a % 7 == 3, "not a window").when(a % 3 == 0, F.concat(start, F.lit("Z / "), end, F.lit("Z")))
    league = F.element_at(F.array(*[F.lit(x) for x in ("IPL 2024", "nba", "Premier League", "Chess", "UEFA Cup")]), (a % 5 + 1).cast("int"))
    return ids.select(
        "asset_id", (a % 5).alias("org_id"), F.when(a % 2 == 0, "image").otherwise("video").alias("asset_type"), F.concat(F.lit("asset-"), a.cast("string"), F.lit(".png")).alias("original_filename"),
        window.alias("broadcast_window"), F.when(a % 4 == 0, F.concat(F.lit("2024-01-"), day, F.lit("T12:00:00Z"))).when(a % 4 == 1, "soon").alias("embargo_until"), league.alias("league"),
    )


def as_of(spark: SparkSession, sf_dir: str):
    """The newest event's time: the clock of all time-dependent queries."""
    return table(spark, sf_dir, "events").agg(F.max("ts")).head()[0]


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One asset per embedding; layers are parts of it, the perceptual hash its signs."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("asset_id"), F.transform("embedding", lambda x: x.cast("double")).alias("clip"))
    return layered(rows)


def layered(rows: DataFrame) -> DataFrame:
    parts = {"spatial": (1, 16), "dct": (17, 16), "hog": (33, 16), "color": (49, 9)}
    rows = rows.select("*", *[F.slice("clip", *at).alias(name) for name, at in parts.items()])
    return rows.select("*", sim.sign_bits(F.col("clip"), 1).alias("phash_hi"), sim.sign_bits(F.col("clip"), 33).alias("phash_lo"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixed copy of every asset: (1 - a) of its own vector and a of its partner's, a by id; size and regions by id too."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("own"))
    count = rows.count()
    other = rows.select(F.col("query_id").alias("partner"), F.col("own").alias("far"))
    mixed = rows.withColumn("partner", (7 * F.col("query_id") + 3) % count).join(other, "partner")
    share = (F.col("query_id") % 6).cast("double") / 10
    mixed = mixed.select("query_id", F.zip_with("own", "far", lambda x, y: (1 - share) * x.cast("double") + share * y.cast("double")).alias("clip"))
    q = F.col("query_id")
    return layered(mixed).select("*", (300 + q * 37 % 300).alias("width"), (300 + q * 53 % 300).alias("height"), F.array(*[F.slice("clip", 16 * r + 1, 9) for r in range(4)]).alias("regions"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl requests: one for each page, in id order, with priority and time by id."""
    p = F.col("page_id")
    rows = table(spark, sf_dir, "pages").select(p.alias("seq"), "url", urls.host(F.col("url")).alias("host"), urls.apex(F.col("url")).alias("domain"), (p * 13 % 1000).alias("priority"), (p * 7 % 90).alias("age"))
    return rows
