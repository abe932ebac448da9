"""Stored tables and files: sightings by day, evidence texts, proofs, crawl jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_PROOF = "FORENSIC_VISUAL_MATCH"
JOB = "url string, org_id string, asset_id string, priority int"


def append_sightings(df: DataFrame, path: str) -> None:
    """Append sightings, partitioned by the day they were detected, each day's rows clustered by asset. Without a proof they are visual matches."""
    proof = F.coalesce(F.col("proof_type"), F.lit(DEFAULT_PROOF)) if "proof_type" in df.columns else F.lit(DEFAULT_PROOF)
    dated = df.withColumn("proof_type", proof).withColumn("day", F.to_date("detected_at"))
    dated.repartition("day", F.pmod(F.hash("asset_id"), F.lit(8))).sortWithinPartitions("day", "asset_id").write.mode("append").partitionBy("day").parquet(path)


def sightings(spark: SparkSession, path: str, since=None) -> DataFrame:
    """Stored sightings; with ``since``, only the days that can hold later ones are listed and read."""
    rows = spark.read.parquet(path)
    return rows if since is None else rows.where((F.col("day") >= F.to_date(F.lit(since))) & (F.col("detected_at") >= F.lit(since)))


def write_reports(df: DataFrame, path: str, text: str = "report") -> None:
    """Evidence texts, each ended by a line of its own."""
    df.select(F.concat(F.col(text), F.lit("\n---")).alias("value")).write.mode("overwrite").text(path)


def write_proofs(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def jobs(spark: SparkSession, path: str, per_batch: int = 100) -> DataFrame:
    """Crawl jobs as they arrive as JSON lines in a folder; malformed lines give null columns."""
    return spark.readStream.schema(JOB).option("maxFilesPerTrigger", per_batch).json(path)


def index_of(spark: SparkSession, path: str, empty: DataFrame) -> DataFrame:
    """The stored index, or an empty one where none was written yet."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.read.parquet(path) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path)) else empty.limit(0)


def looked_up(rows: DataFrame, wanted: DataFrame, key: str, json: str | None = None, schema: str | None = None, at: str | None = None) -> DataFrame:
    """The row of every wanted key, and whether there is one (``found``); a JSON column comes decoded, a time as ISO text."""
    if json:
        rows = rows.withColumn(json, F.from_json(json, schema))
    if at:
        rows = rows.withColumn(at, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"))
    return wanted.join(rows.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))
