"""Periodic sweeps, and the retry policy of tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Each sweep's first minute of the day and minutes between runs.
SWEEPS = {"posts": (0, 120), "feeds": (30, 360), "rescan": (180, 1440), "windows": (0, 15)}
#: Each task's retries, and its soft and hard limits in seconds.
TASKS = {"match": (3, 120, 180), "video": (2, 300, 360), "rescan": (1, 600, 660), "evidence": (2, 60, 90), "persist": (3, 30, 45)}


def due(spark: SparkSession, since, until) -> DataFrame:
    """sweep, at: every run after ``since`` and up to ``until``; a sweep that missed runs can make them up from here."""
    rows = spark.createDataFrame([(k, *v) for k, v in SWEEPS.items()], "sweep string, first int, every int")
    start, end = F.unix_seconds(F.lit(since).cast("timestamp")), F.unix_seconds(F.lit(until).cast("timestamp"))
    day = F.lit(86_400)
    rows = rows.withColumn("day", F.explode(F.sequence(F.floor(start / day), F.floor(end / day))))
    rows = rows.withColumn("at", F.explode(F.transform(F.sequence(F.col("first"), F.lit(1439), F.col("every")), lambda m: F.col("day") * day + m * 60)))
    return rows.where((F.col("at") > start) & (F.col("at") <= end)).select("sweep", F.timestamp_seconds("at").alias("at"))


def _of(task: Column, part: int) -> Column:
    return F.create_map(*[F.lit(x) for name, limits in TASKS.items() for x in (name, limits[part])])[task]


def outcome(task: Column, failures: Column, seconds: Column) -> tuple[Column, Column]:
    """Attempts that a task makes if its first ``failures`` ones fail and each takes ``seconds``, and how it ends: done, warned (beyond the soft limit), killed (beyond the hard one) or failed."""
    retries = _of(task, 0)
    attempts = F.least(failures, retries) + 1
    ended = F.when(seconds > _of(task, 2), "killed").when(failures > retries, "failed").when(seconds > _of(task, 1), "warned").otherwise("done")
    return F.when(seconds > _of(task, 2), retries + 1).otherwise(attempts), ended
