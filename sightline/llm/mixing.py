"""Mixing sources to target weights by a time-varying curriculum.

Each source has a schedule over the training run, rate(t) = target * (1 + slope * (2t - 1)) for t in
0..1, whose integral over the whole run is the source's target in words. The slopes are centred, so that
the sources' rates add up to the same total at any time: a time is then a share of all words to be
trained on, and a position, which is that share of the total, is the number of the training word.

The words that a source has delivered by time t are target * (t + slope * (t^2 - t)). A document that
starts after u words of its source stands where that demand reaches u: its position is the inverse of
the integral at u. What has no position before the run's end is not taken. Documents are then sorted by
ranges of position; as positions count words, equal ranges hold equal numbers of them.

Running sums are taken in two steps, over buckets of a source and inside each bucket, so a source with
a third of all rows is spread over as many tasks as its rows need.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE_SPACE, Workspace, fresh

WEIGHTS = (5.0, 2.0, 1.0)
#: Slopes of the sources' weights over time before they are centred, in the sources' order, repeating: late, early, even. From -0.5 to 0.5.
SLOPES = (0.5, -0.5, 0.0)
SHARE, MOST = 1.5, 2.0
BUCKET_ROWS = 5_000
#: Documents of more than this part of their source's target are placed first, so that a source's end falls on a small one.
LARGE = 0.01
#: The table of sources is sent to all tasks up to this many rows; beyond, rows are joined with it by source.
MAX_BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    """Number of runs of other than white space; null text has none."""
    text = F.coalesce(text, F.lit(""))
    return F.size(F.array_remove(F.split(text, WHITE_SPACE, -1), "")).cast("long")


def _repeated(values: Sequence[float], nth: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (nth % len(values) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, slopes: Sequence[float] = SLOPES, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, size, rows, target, slope, total of ``sizes`` (source, size, rows): one row per source.

    Sources by code point, null last, take the weights in turn, and by them share ``share`` times all
    sizes. None gets more than ``most`` times its size: sources in the order in which a rising level fills
    them, the first ones are full, and the rest share by weight what those leave.
    """
    every = [Window.unboundedPreceding, Window.unboundedFollowing]
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("nth", F.row_number().over(by_name) - 1)
    rows = rows.withColumns({"weight": _repeated(weights, F.col("nth")), "slope": _repeated(slopes, F.col("nth"))})
    rows = rows.withColumn("full_at", most * F.col("size") / F.col("weight"))
    by_fill = Window.orderBy("full_at", "nth")
    full = F.coalesce(F.sum("size").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = share * F.sum("size").over(by_fill.rowsBetween(*every)) - most * full
    rows = rows.withColumns({"place": F.row_number().over(by_fill), "level": left / F.sum("weight").over(by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))})
    # The first source that its level does not fill, if there is one: it and all after it get that level.
    open_ = F.when(F.col("level") < F.col("full_at"), F.struct("place", "level"))
    rows = rows.withColumn("open", F.min(open_).over(by_fill.rowsBetween(*every)))
    target = F.when(F.col("open").isNull() | (F.col("place") < F.col("open.place")), most * F.col("size")).otherwise(F.col("open.level") * F.col("weight"))
    rows = rows.withColumn("target", target.cast("double"))
    rows = rows.withColumns({"total": F.sum("target").over(by_fill.rowsBetween(*every)), "pull": F.sum(F.col("target") * F.col("slope")).over(by_fill.rowsBetween(*every))})
    centred = F.when(F.col("total") > 0, F.col("slope") - F.col("pull") / F.col("total")).otherwise(0.0)
    return rows.select("source", "size", "rows", "target", centred.alias("slope"), "total")


def shuffled(doc_id: Column, text: Column) -> Column:
    """A row's place in the order by hash: 32 bits of the MD5 sum of its id and its text's, so that rows without an id are dealt out as well."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("long").cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))), 1, 8), 16, 10).cast("long")


def position(words: Column, target: Column, slope: Column) -> Column:
    """The time at which a source's delivered words reach ``words``: the root of slope*t^2 + (1 - slope)*t = words / target in 0..1."""
    part, b = F.least(F.lit(1.0), words / target), F.lit(1.0) - slope
    return F.when(words <= 0, 0.0).otherwise(2 * part / (b + F.sqrt(F.greatest(F.lit(0.0), b * b + 4 * slope * part))))


def plan_mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, slopes: Sequence[float] = SLOPES, share: float = SHARE) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, total, content, positions (of each copy taken: the training word at which it starts).

    Whole documents are taken in an order by hash until the source's target is reached: a copy is
    taken if more than half of it lies before the target, the first copy of all before any second. No
    document is taken more than twice. Null text and text of white space have size 0 and are taken
    once at most; a null source is a source of its own, ordered last. Repeated rows are separate
    rows, ordered by their content and so alike in every run. An empty table gives an empty plan.
    """
    space = Workspace(docs.sparkSession, "mix")
    text = F.col("text").cast("string")
    sized = space.table(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"), _content(F.col("source"), text).alias("content"), shuffled(F.col("doc_id"), text).alias("order")),
        "sized",
    )
    sources = space.table(source_targets(sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")), weights, slopes, share), "sources")
    facts = sources.select(F.col("source").alias("of"), F.col("size").alias("source_size"), "target", "slope", "total", F.ceil(F.col("rows") / BUCKET_ROWS).cast("long").alias("buckets"))
    rows = sized.join(F.broadcast(facts) if sources.count() <= MAX_BROADCAST_SOURCES else facts, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    large = F.col("size") > LARGE * F.col("target")
    rows = rows.withColumn("bucket", F.when(large, -1).otherwise(F.pmod(F.col("order"), F.col("buckets")))).withColumn("first", F.when(large, -F.col("size")).otherwise(0))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = sums.withColumn("before", F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select(F.col("source").alias("of"), F.col("bucket").alias("at"), F.coalesce("before", F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "bucket").orderBy("first", "order", "doc_id", "size", "content").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("own", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(before, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("at")))
    start = F.col("before") + F.col("own")
    starts = F.filter(F.array(*[start + k * F.col("source_size") for k in range(int(MOST))]), lambda s: (2 * s + F.col("size") < 2 * F.col("target")))
    starts = F.when(F.col("size") == 0, F.slice(starts, 1, 1)).otherwise(starts)
    placed = F.transform(starts, lambda s: F.round(F.col("total") * position(s, F.col("target"), F.col("slope"))).cast("long"))
    return rows.select("doc_id", "source", "size", "source_size", "target", "total", "content", placed.alias("positions"))


def taken_words(plan: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (words of all copies that have a position), position (of the first copy; null if none), in ranges of position, those without one last."""
    rows = plan.withColumn("position", F.get("positions", F.lit(0))).withColumn("taken", F.col("size") * F.size("positions"))
    rows = _by_position(rows, F.col("position"), F.col("total"), F.col("content"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "position")


def _by_position(rows: DataFrame, at: Column, total: Column, spread: Column) -> DataFrame:
    """Sorted by ranges of position. Equal ranges hold equal numbers of words, so none have to be sampled. Rows without a position, which have no order, are spread over all ranges' ends."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    range_ = F.least(F.floor(at * parts / F.greatest(total, F.lit(1.0))), F.lit(parts - 1))
    return rows.repartitionById(parts, F.coalesce(range_, F.pmod(spread, F.lit(parts))).cast("int")).sortWithinPartitions(at.asc_nulls_last(), spread)


def _content(source: Column, text: Column) -> Column:
    return F.xxhash64(F.lit(7), F.col("doc_id").cast("long"), text.cast("string"), source.cast("string"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, sorted by ranges of position, with ``docs``' own columns.

    Rows find their positions by id and content. Rows alike in both are numbered, so each gets its own.
    """
    plan = plan_mix(docs, **options).where(F.size("positions") > 0)
    key, content, lists, number, position_, total = fresh(docs.columns, "_key", "_hash", "_lists", "_number", "_position", "_total")
    found = plan.groupBy(F.coalesce("doc_id", F.lit(-1)).alias(key), F.col("content").alias(content)).agg(F.sort_array(F.collect_list("positions")).alias(lists), F.first("total").alias(total))
    rows = docs.withColumns({key: F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), content: _content(F.col("source"), F.col("text"))})
    rows = rows.withColumn(number, F.row_number().over(Window.partitionBy(key, content).orderBy(key)))
    placed = rows.join(found, [key, content]).where(F.col(number) <= F.size(lists)).withColumn(position_, F.explode(F.element_at(lists, F.col(number))))
    return _by_position(placed, F.col(position_), F.col(total), F.col(content)).select(*[F.col(f"`{c}`") for c in docs.columns])
