"""The crawl stream: admission, dispatch, detection and storage as one Structured Streaming query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import severity as sev
from ..functions import urls
from ..operators import crawl, sightings, stats
from ..sources import stores


def deduplicated(stream: DataFrame, key: str, at: str, delay: str = "1 day") -> DataFrame:
    """Each key's first row within ``delay`` of event time, for which its state is kept."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def deduplicated_for_ever(stream: DataFrame, key: str) -> DataFrame:
    """Each key's first row, whenever it comes; the state grows with the number of keys."""
    return stream.dropDuplicates([key])


def velocity(stream: DataFrame, key: str, at: str, delay: str = "1 hour") -> DataFrame:
    """Counts of each key's quarter hours; late rows beyond the delay are dropped."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    return timed.groupBy(key, F.window(at, "15 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("window_start"), "n")


def classified(stream: DataFrame, score: str) -> DataFrame:
    return stream.withColumn("severity", sev.stored(sev.classify_watch(F.col(score)))).where("severity <> 'MISS'")


def stored(stream: DataFrame, folder: str, checkpoint: str):
    """Append each batch to its own partition of a table: a batch that is run again replaces what it wrote before."""
    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_once(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> None:
    """Process all that is there and end."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def critical(stream: DataFrame) -> DataFrame:
    """Critical rows as messages: one JSON value each."""
    return stream.where("severity = 'CRITICAL'").select(F.to_json(F.struct("*")).alias("value"))


def critical_to_kafka(stream: DataFrame, servers: str, topic: str, checkpoint: str):
    """Critical rows as JSON on a topic."""
    return critical(stream).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()


def first_of_day(stream: DataFrame, key: str, at: str, delay: str = "1 day") -> DataFrame:
    """key, day: one row for each key and day. State is kept until the day is ``delay`` old, so the rows do not depend on how they come in batches."""
    days = stream.select(key, F.date_trunc("day", F.col(at).cast("timestamp")).alias("_day")).withWatermark("_day", delay)
    return days.dropDuplicates([key, "_day"]).select(key, F.col("_day").cast("date").alias("day"))


def _timed(stream: DataFrame, at: str, delay: str) -> DataFrame:
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)


def sliding(stream: DataFrame, key: str, at: str, size: str = "1 hour", step: str = "15 minutes", delay: str = "1 hour") -> DataFrame:
    """Counts of windows that overlap."""
    counts = _timed(stream, at, delay).groupBy(key, F.window(at, size, step).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(key, F.col("w.start").alias("window_start"), "n")


def sessions(stream: DataFrame, key: str, at: str, gap: str, delay: str = "1 hour") -> DataFrame:
    """Counts of sessions: rows of a key that follow each other within the gap."""
    counts = _timed(stream, at, delay).groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(key, F.col("w.start").alias("session_start"), "n")


def spiking(counts: DataFrame, means: DataFrame, key: str, factor: float = 3.0) -> DataFrame:
    """Counts as they come, flagged against stored means."""
    return counts.join(means, key).withColumn("spike", F.col("n") > factor * F.col("hourly_mean")).drop("hourly_mean")


def crawl_stages(items: DataFrame, folder: str, detect: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The item pipeline over a stream until all is read; what it stored.

    ``items``: event_id, asset_id, media_url, media_bytes and what ``detect`` needs to add ``severity``. The
    stages, in order: what is known of the url is looked up; items without a url are dropped; of each url
    the first item goes on; items without bytes are dropped; the platform is named; the signature is made; items
    that are not known yet are detected; good matches' watermarks are checked; alerts are marked; matches
    are stored, and results kept by url. A batch that runs again sees what came before it and replaces what it wrote.
    """
    spark = items.sparkSession

    def run(batch: DataFrame, number: int) -> None:
        nothing = spark.createDataFrame([], "media_url string, known string, batch int")
        known = stores.index_of(spark, f"{folder}/results", nothing).where(F.col("batch") < number)
        rows = batch.join(known.groupBy("media_url").agg(F.max("known").alias("known")), "media_url", "left")
        rows = rows.where("media_url is not null and media_url <> ''")
        rows = crawl.first_seen(rows, F.col("media_url"), ["event_id"])
        results = rows.select("media_url")
        rows = rows.where("media_bytes is not null and known is null")
        rows = rows.withColumns({"simulated": urls.simulated_platform(F.col("media_url")), "signature": F.sha2("media_bytes", 256)})
        rows = detect(rows).persist()
        good = F.col("severity").isin("HIGH", "CRITICAL")
        kept = sightings.storable(rows.withColumns({"watermark_checked": good, "alert": good}))
        kept.drop("media_bytes", "known").write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        found = results.join(rows.select("media_url", F.col("severity").alias("known")), "media_url", "left")
        found.withColumn("known", F.coalesce("known", F.lit("MISS"))).write.mode("overwrite").parquet(f"{folder}/results/batch={number}")
        rows.unpersist()

    items.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def counted(df: DataFrame, folder: str, **metrics: Column) -> dict[str, int]:
    """Write the table, and the metrics that were observed while it was written."""
    seen = Observation()
    df.observe(seen, *[m.alias(name) for name, m in metrics.items()]).write.parquet(folder)
    return dict(seen.get)


def staged(stream: DataFrame, *stages: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Stages in order, each a function of a DataFrame."""
    for stage in stages:
        stream = stream.transform(stage)
    return stream


spikes = stats.velocity_spikes
