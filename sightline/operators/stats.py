"""Statistics over pixels, signals and event rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, population deviation and biased skewness; 0 for a constant channel."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.coalesce(F.skewness(value), F.lit(0.0)).alias("skew"))


def histogram(df: DataFrame, keys: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts by bin and their share of the whole vector's length; values outside are dropped, the right edge is in the last bin."""
    own = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(value).between(low, high)).groupBy(*keys, own.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    length = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(*keys)))
    return counts.withColumn("share", F.col("n") / length)


def pair_chi_square(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Chi-square of values 2i against 2i + 1, over pairs with a mean above 5."""
    counts = df.groupBy(*keys, F.floor(F.col(value) / 2).alias("pair")).agg(F.count_if(F.col(value) % 2 == 0).alias("even"), F.count_if(F.col(value) % 2 == 1).alias("odd"))
    mean = (F.col("even") + F.col("odd")) / 2
    part = (F.pow(F.col("even") - mean, 2) + F.pow(F.col("odd") - mean, 2)) / mean
    return counts.where(mean > 5).groupBy(*keys).agg(F.sum(part).alias("chi2"), (F.count(F.lit(1)) * 2 - 1).alias("free"))


def majority_bits(df: DataFrame, keys: list[str], index: str, vote: Column, bits: int = 144) -> DataFrame:
    """Each payload bit by majority of its repetitions; a draw is 0."""
    return df.groupBy(*keys, (F.col(index) % bits).alias("bit")).agg((F.sum(vote) > 0).cast("int").alias("value"))


def symbol_bits(df: DataFrame, key: str, frame: str, value: str, size: int = 15) -> DataFrame:
    """Bits of non-overlapping symbols by the sign of their mean; the last symbol is left out, even if it fits."""
    count = F.max(frame).over(Window.partitionBy(key)) + 1
    rows = df.withColumn("_count", count).withColumn("symbol", F.floor(F.col(frame) / size)).where(F.col("symbol") * size < F.col("_count") - size)
    return rows.groupBy(key, "symbol").agg((F.avg(value) > 0).cast("int").alias("bit"))


def hourly_means(df: DataFrame, key: str, at: str) -> DataFrame:
    """Each key's mean number of rows in the hours that have any."""
    return df.groupBy(key, F.window(at, "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(F.avg("n").alias("hourly_mean"))


def velocity_spikes(df: DataFrame, key: str, at: str, factor: float = 3.0) -> DataFrame:
    """Quarter hours of a key with more rows than ``factor`` times its mean hour."""
    quarter = df.groupBy(key, F.window(at, "15 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("window_start"), "n")
    return quarter.join(hourly_means(df, key, at), key).withColumn("spike", F.col("n") > factor * F.col("hourly_mean"))


def scene_cuts(df: DataFrame, key: str, frame: str, mean: str, least: float = 30.0) -> DataFrame:
    """Frames whose mean luminance differs from the one before by more than the threshold."""
    before = F.lag(mean).over(Window.partitionBy(key).orderBy(frame))
    return df.withColumn("change", F.abs(F.col(mean) - before)).where(F.col("change") > least)


def video_matches(frames: DataFrame) -> DataFrame:
    """Frame matches of a video grouped by asset: times in order, proofs, severity."""
    from ..functions import severity as sev

    out = frames.groupBy("video_id", "asset_id").agg(F.sort_array(F.collect_list("t")).alias("times"), F.sort_array(F.collect_set("proof_type")).alias("proofs"), F.count(F.lit(1)).alias("frames"), F.bool_or(F.col("proof_type").isin("CONTAINER_MATCH", "CRYPTOGRAPHIC_LAYER_MATCH")).alias("cryptographic"))
    return out.withColumn("severity", sev.video_severity(F.col("frames"), F.col("cryptographic")))


def leakers(observed: DataFrame, assigned: DataFrame) -> DataFrame:
    """For each observed copy the subscriber whose bits agree best, of equal ones the smallest: assigned streams of the same asset are compared bit by bit.

    Different streams are compared once for each asset: copies of equal bits have one answer, and of
    subscribers of equal bits only the smallest can be it.
    """
    holders = assigned.groupBy("asset_id", "bit_sequence").agg(F.min("subscriber_id").alias("subscriber_id"))
    both = observed.select("asset_id", "bits").distinct().join(holders, "asset_id")
    same = F.size(F.filter(F.zip_with("bits", "bit_sequence", lambda a, b: a == b), lambda x: x))
    # The stream is one column, so that its groups need an exchange of their own and a large asset's join can be split.
    pairs = both.select(F.struct("asset_id", "bits").alias("stream"), "subscriber_id", same.alias("matched"))
    best = pairs.groupBy("stream").agg(F.max_by(F.struct("subscriber_id", "matched"), F.struct("matched", -F.col("subscriber_id"))).alias("best"))
    rows = observed.select("sighting_id", F.struct("asset_id", "bits").alias("stream")).join(best, "stream")
    rows = rows.select("sighting_id", "stream.asset_id", "best.subscriber_id", "best.matched", F.size("stream.bits").alias("total")).withColumn("confidence", F.col("matched") / F.col("total"))
    best = F.max_by(F.struct("asset_id", "subscriber_id", "matched", "total", "confidence"), F.struct("confidence", -F.col("subscriber_id")))
    return rows.groupBy("sighting_id").agg(best.alias("best")).select("sighting_id", "best.*")


def frame_changes(df: DataFrame, key: str, frame: str, pixels: str, least: float = 30.0) -> DataFrame:
    """Scene cuts by pixels: frames whose mean absolute difference from the one before exceeds the threshold, with that difference."""
    before = F.lag(pixels).over(Window.partitionBy(key).orderBy(frame))
    change = F.aggregate(F.zip_with(pixels, before, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, x: a + x) / F.size(pixels)
    return df.withColumn("change", change).where(F.col("change") > least)


def confidence(df: DataFrame, keys: list[str], correlation: str) -> DataFrame:
    """Mean absolute correlation: how sure a watermark is."""
    return df.groupBy(*keys).agg(F.avg(F.abs(correlation)).alias("confidence"))


def luminance_series(df: DataFrame, key: str, frame: str, value: str) -> DataFrame:
    """The mean luminance of a video's frames as one series, in the order of frames."""
    means = df.groupBy(key, frame).agg(F.avg(value).alias("mean"))
    return means.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(frame, "mean"))), lambda x: x["mean"]).alias("series"))
