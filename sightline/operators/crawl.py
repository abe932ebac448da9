"""Crawl-side processing: admission, routing, rate limits, queues and caches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing, urls


# ---- routing ----------------------------------------------------------------------------------


def policies(spark: SparkSession, rows: Sequence[tuple[str, bool, float]] = urls.POLICIES) -> DataFrame:
    return spark.createDataFrame(list(rows), "policy string, allowed boolean, rps double")


def with_policy(df: DataFrame, domain: str, table: DataFrame) -> DataFrame:
    """Add the policy of the nearest listed ancestor of the domain, or of ``*``: allowed at the default rate if none.

    A longest-suffix join: each distinct domain meets the table once for each of its suffixes.
    """
    labels = F.split(F.lower(domain), "[.]")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    names = df.select(domain).distinct().select(F.col(domain).alias("_domain"), F.explode(F.concat(suffixes, F.array(F.lit("*")))).alias("policy"))
    met = names.join(F.broadcast(table) if table.count() <= 100_000 else table, "policy")
    depth = F.when(F.col("policy") == "*", 0).otherwise(F.size(F.split("policy", "[.]")))
    best = met.groupBy("_domain").agg(F.max_by(F.struct("policy", "allowed", "rps"), depth).alias("_p"))
    out = df.join(best, F.col(domain) == F.col("_domain"), "left")
    return out.select(*[F.col(c) for c in df.columns], F.col("_p.policy").alias("policy"), F.coalesce("_p.allowed", F.lit(True)).alias("allowed"), F.coalesce("_p.rps", F.lit(urls.DEFAULT_RPS)).alias("rps"))


def ring(spark: SparkSession, nodes: Sequence[str], points: int = 150) -> DataFrame:
    """The points of a consistent hash ring: node and position."""
    each = spark.createDataFrame([(n,) for n in nodes], "node string").select("node", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("v"))
    return each.select("node", hashing.ring_position(F.concat("node", F.lit(":vn"), F.col("v").cast("string"))).alias("position"))


def routed(df: DataFrame, key: str, points: DataFrame) -> DataFrame:
    """Add the node of the first ring point at or after the key's position; past the last, the first.

    An as-of join by one sorted pass: points and distinct keys are put on one line, cut at fixed
    positions, and each key takes the next point, within its stretch or else from those that follow.
    """
    line = points.groupBy("position").agg(F.min("node").alias("node"))
    keys = df.select(F.col(key).alias("_key")).distinct().withColumn("position", hashing.ring_position(F.col("_key")))
    both = keys.select("_key", "position", F.lit(None).cast("string").alias("node"), F.lit(0).alias("kind")).unionByName(line.select(F.lit(None).cast("string").alias("_key"), "position", "node", F.lit(1).alias("kind")))
    both = both.withColumn("stretch", F.shiftright("position", 24))
    after = Window.partitionBy("stretch").orderBy("position", "kind").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    both = both.withColumn("next", F.first("node", ignorenulls=True).over(after)).where("kind = 0")
    firsts = line.groupBy(F.shiftright("position", 24).alias("s")).agg(F.min_by("node", "position").alias("first")).collect()  # at most 256 stretches
    starts = sorted((r["s"], r["first"]) for r in firsts)
    later = [next((n for s, n in starts if s > at), starts[0][1]) for at in range(256)] if starts else [None] * 256
    fallback = F.element_at(F.array(*[F.lit(n) for n in later]), (F.col("stretch") + 1).cast("int"))
    found = both.select("_key", F.coalesce("next", fallback).alias("node"))
    return df.join(found, F.col(key) == F.col("_key"), "left").drop("_key")


# ---- admission --------------------------------------------------------------------------------


def first_seen(df: DataFrame, key: Column, order: list) -> DataFrame:
    """Each key's first row in arrival order."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_nth = 1").drop("_nth")


def queue_order(df: DataFrame, age: str = "age") -> DataFrame:
    """Add score and place of a crawl queue: priority and boost less cooldown, first come first among equals."""
    score = F.col("priority") + urls.boost(F.col("domain")) - urls.cooldown(F.col(age).cast("double"))
    return df.withColumn("score", score)


def fixed_window_limit(df: DataFrame, key: str, at: str, limit: int, size: str = "1 hour") -> DataFrame:
    """Requests of each key and window, and whether they exceed the limit."""
    return df.groupBy(key, F.window(at, size).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("window_start"), "n", (F.col("n") > limit).alias("limited"))


def in_order(df: DataFrame, key: str, order: list[str], columns: list[str], start: Callable[[], Callable], result: str) -> DataFrame:
    """Add the column ``result`` (DDL): for each row of a key, in order, what a state gives for its ``columns``.

    ``start`` makes the state of a key, a function of the columns' values. A key's rows depend on all before
    them, so they are streamed through one task in sorted batches, never held together.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    name = result.split()[0]

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = object(), None
        for frame in frames:
            out = []
            for k, *values in zip(frame[key], *(frame[c] for c in columns)):
                if k != last:
                    last, state = k, start()
                out.append(state(*values))
            yield frame.assign(**{name: pd.Series(out, index=frame.index, dtype=object)})

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(fold, f"{fields}, {result}")


def seconds(at: str) -> Column:
    return F.unix_micros(F.col(at).cast("timestamp")) / 1_000_000


def bucket(rate: float | None = None) -> Callable[[], Callable]:
    """A bucket of max(2 * rate, 1) tokens, refilled at ``rate`` a second up to that, one token a request. Without a rate, each request brings its own."""

    def start() -> Callable:
        tokens, last = None, 0.0

        def passes(t: float, own: float = rate) -> bool:
            nonlocal tokens, last
            most = max(2 * own, 1.0)
            tokens, last = most if tokens is None else min(most, tokens + (t - last) * own), t
            passed = tokens >= 1.0
            tokens -= passed
            return passed

        return passes

    return start


def token_bucket(df: DataFrame, key: str, at: str, order: str, rate: float) -> DataFrame:
    """Add ``passed``: whether a key's bucket has a token for the request."""
    rows = in_order(df.withColumn("_seconds", seconds(at)), key, ["_seconds", order], ["_seconds"], bucket(rate), "passed boolean")
    return rows.drop("_seconds")


def admitted(df: DataFrame, domain: str, policy_table: DataFrame) -> DataFrame:
    """The domain gate's first half: blocked domains are dropped; the rest keep their policy's rate."""
    return with_policy(df, domain, policy_table).where("allowed")


def gated(df: DataFrame, domain: str, at: str, order: str, policy_table: DataFrame) -> DataFrame:
    """The domain gate: every request with ``outcome`` blocked (by its policy), limited (by its domain's bucket of the policy's rate) or passed."""
    judged = with_policy(df, domain, policy_table).withColumn("_seconds", seconds(at))
    open_ = in_order(judged.where("allowed"), domain, ["_seconds", order], ["_seconds", "rps"], bucket(), "passed boolean")
    open_ = open_.withColumn("outcome", F.when(F.col("passed"), "passed").otherwise("limited")).drop("passed")
    return open_.unionByName(judged.where("not allowed").withColumn("outcome", F.lit("blocked"))).drop("_seconds")


def ttl_hits(df: DataFrame, key: str, at: str, order: str, ttl: int) -> DataFrame:
    """Add ``hit``: whether a stored response younger than the time to live answers the request; one that is not answered is stored anew."""

    def start() -> Callable:
        stored = None

        def hit(t: float) -> bool:
            nonlocal stored
            fresh = stored is not None and t - stored < ttl
            stored = stored if fresh else t
            return fresh

        return hit

    return in_order(df.withColumn("_seconds", seconds(at)), key, ["_seconds", order], ["_seconds"], start, "hit boolean").drop("_seconds")


def alarms(df: DataFrame, key: str, order: list, every: int = 6) -> DataFrame:
    """Rows at which a key's running count passes its threshold, which starts it anew."""
    running = F.count(F.lit(1)).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("n", running).where(F.col("n") % every == 0)


def lru_hits(df: DataFrame, key: str, order: str, capacity: int) -> DataFrame:
    """Add ``hit``: whether a least-recently-used cache answers each request; one cache per shard, so rows must carry ``shard``."""

    def start() -> Callable:
        from collections import OrderedDict

        cache: OrderedDict = OrderedDict()

        def hit(k) -> bool:
            held = k in cache
            cache[k] = True
            cache.move_to_end(k)
            if len(cache) > capacity:
                cache.popitem(last=False)
            return held

        return hit

    return in_order(df, "shard", [order], [key], start, "hit boolean")


def hit_rate(hits: DataFrame, by: str) -> DataFrame:
    return hits.groupBy(by).agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.avg(F.col("hit").cast("double")).alias("rate"))


def cooled(pushes: DataFrame, pops: DataFrame, domain: str, at: str) -> DataFrame:
    """Add ``score`` to requests as they are pushed: priority and boost less what is left of the cooldown since the domain's last pop at or before. Both sides are sorted once per domain and hour; what was popped in earlier hours is carried over."""
    both = pushes.withColumns({"_kind": F.lit(1), "_popped": F.lit(None).cast("double")}).unionByName(pops.select(domain, at, F.lit(0).alias("_kind"), seconds(at).alias("_popped")), allowMissingColumns=True)
    both = both.withColumn("_hour", F.date_trunc("hour", at))
    carried = pops.groupBy(domain, F.date_trunc("hour", at).alias("_hour")).agg(F.max(seconds(at)).alias("_last"))
    hours = both.select(domain, "_hour").distinct().join(carried, [domain, "_hour"], "left")
    before = F.max("_last").over(Window.partitionBy(domain).orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1))
    rows = both.join(hours.withColumn("_before", before).drop("_last"), [domain, "_hour"])
    inside = Window.partitionBy(domain, "_hour").orderBy(F.col(at), "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.coalesce(F.max("_popped").over(inside), F.col("_before"))
    score = F.col("priority") + urls.boost(F.col(domain)) - F.coalesce(urls.cooldown(seconds(at) - last), F.lit(0.0))
    return rows.withColumn("score", score).where("_kind = 1").drop("_kind", "_popped", "_hour", "_before")


def scheduled(requests: DataFrame, fingerprint: Column, seq: str) -> DataFrame:
    """The crawl scheduler: requests seen before are filtered, the others queued by score and then by arrival. Adds ``outcome``, and ``place`` in each shard's queue."""
    first = F.min(seq).over(Window.partitionBy("_print"))
    rows = requests.withColumn("_print", fingerprint).withColumn("outcome", F.when(F.col(seq) == first, "enqueued").otherwise("filtered"))
    place = F.row_number().over(Window.partitionBy("shard", "outcome").orderBy(F.desc("score"), seq))
    return rows.withColumn("place", F.when(F.col("outcome") == "enqueued", place)).drop("_print")


def dispatch(cached: Column, has_bytes: Column, media_type: Column, has_url: Column) -> Column:
    """Where an item goes: pass, video, drop or fingerprint."""
    return F.when(cached, "pass").when(~has_bytes & (media_type == "video") & has_url, "video").when(~has_bytes, "drop").otherwise("fingerprint")
