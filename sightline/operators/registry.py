"""Registry of organisations, assets, seeds and results: registration, lookups and cached answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing
from ..functions import similarity as sim
from ..workspace import kept
from .crawl import in_order


def registered(index: DataFrame, assets: DataFrame, key: str) -> DataFrame:
    """Append assets to the index: unit vectors, and ids that go on from the index's last.

    Ids are dealt in two steps, over buckets of a hash of ``key`` and inside each by key, so that no task numbers all rows.
    """
    last = index.agg(F.max("index_id")).head()[0]
    before = 0 if last is None else last + 1
    buckets = 64
    rows = assets.withColumn("_bucket", F.pmod(hashing.ring_position(F.col(key).cast("string")), F.lit(buckets)))
    sizes = dict(rows.groupBy("_bucket").count().collect())  # one row for each bucket
    offsets = []
    for b in range(buckets):
        offsets.append(before)
        before += sizes.get(b, 0)
    nth = F.row_number().over(Window.partitionBy("_bucket").orderBy(key))
    first = F.element_at(F.array(*[F.lit(x).cast("long") for x in offsets]), (F.col("_bucket") + 1).cast("int"))
    new = rows.withColumn("index_id", first + nth - 1).withColumn("clip", sim.normalize(F.col("clip"))).drop("_bucket")
    return index.unionByName(new.select(*index.columns))


def organisations(orgs: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """The active organisation of each request's API key, if the key is of allowed length; null where there is none. The public key comes with it."""
    known = orgs.where("active").select(F.col("api_key_hash").alias("_hash"), "org_id", "public_key_pem")
    rows = requests.withColumn("_hash", F.when(hashing.usable_key(F.col(key)), hashing.key_hash(F.col(key))))
    return rows.join(known, "_hash", "left").drop("_hash")


def public_keys(assets: DataFrame, orgs: DataFrame) -> DataFrame:
    """Each asset with its organisation's public key, by which its signature is checked; null where the organisation has none."""
    return assets.join(orgs.select("org_id", "public_key_pem"), "org_id", "left")


def organisation(orgs: DataFrame, key: Column) -> DataFrame:
    """The active organisation of an API key of allowed length."""
    return orgs.where(hashing.usable_key(key) & (F.col("api_key_hash") == hashing.key_hash(key)) & F.col("active"))


EMPTY_LOG = "{asset} {kind}, position long, content string, prev string, own string"
ZERO = "0" * 64


def entry_hash(content: str, previous: str, algorithm: str) -> str:
    import hashlib

    return hashlib.new(algorithm, f"{content}|{previous}".encode()).hexdigest()


def appended(log: DataFrame, entries: DataFrame, asset: str, order: list[str], content: str, algorithm: str = "sha3_256") -> DataFrame:
    """The log (asset, position, content, prev, own) with new entries chained to it: every entry holds the hash of the one before.

    Stored entries stay as they are: each asset's chain goes on from its last. A hash depends on all before
    it, so an asset's new entries are streamed in order; assets are independent.
    """
    last = log.groupBy(asset).agg(F.max_by(F.struct("position", "own"), "position").alias("_last"))
    rows = entries.select(asset, *order, F.col(content).alias("content")).join(last, asset, "left")
    rows = rows.select(asset, *order, "content", F.coalesce("_last.position", F.lit(-1)).alias("_position"), F.coalesce("_last.own", F.lit(ZERO)).alias("_own"))

    def start():
        state = None

        def step(position, own, text):
            nonlocal state
            position, own = (int(position), own) if state is None else state
            state = position + 1, entry_hash(text, own, algorithm)
            return {"position": state[0], "prev": own, "own": state[1]}

        return step

    new = in_order(rows, asset, order, ["_position", "_own", "content"], start, "_entry struct<position:bigint,prev:string,own:string>")
    return log.unionByName(new.select(asset, "_entry.position", "content", "_entry.prev", "_entry.own"))


def custody(log: DataFrame, asset: str) -> DataFrame:
    """The custody log as it is listed: by asset and position."""
    return log.orderBy(asset, "position")


def answered(requests: DataFrame, results: DataFrame, url: str) -> DataFrame:
    """Requests with what an earlier answer of the same url gives, and whether there is one."""
    key = F.sha2(F.col(url), 256)
    stored = results.withColumn("_key", F.sha2(F.col(url), 256)).drop(url)
    return requests.withColumn("_key", key).join(stored.withColumn("cache_hit", F.lit(True)), "_key", "left").drop("_key").withColumn("cache_hit", F.coalesce("cache_hit", F.lit(False)))


def timeline(sightings: DataFrame, at: str, size: str = "1 day") -> DataFrame:
    return sightings.groupBy(F.window(at, size).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "CRITICAL").alias("critical")).select(F.col("w.start").alias("day"), "n", "critical")


def pages_reached(links: DataFrame, start: DataFrame) -> DataFrame:
    """Pages reached by following next-page links from any of ``start``, until there are no new ones; pages of a cycle are reached once."""
    seen = last = kept(start.select(F.col(start.columns[0]).alias("page")).distinct(), "pages")
    links = kept(links.select("page", "next"), "links")
    while True:
        last = kept(last.join(links, "page").select(F.col("next").alias("page")).distinct().join(seen, "page", "left_anti"), "pages")
        if last.isEmpty():
            return seen
        seen = kept(seen.union(last), "pages")


def populated(stored: DataFrame, items: DataFrame, url: str) -> DataFrame:
    """The results table after a stage: for each url the newest result (by ``at``) of what is stored and what was just computed."""
    both = stored.unionByName(items).withColumn("_key", F.sha2(F.col(url), 256))
    return both.groupBy("_key").agg(F.max_by(F.struct(*[c for c in both.columns if c != "_key"]), "at").alias("r")).select("r.*")
