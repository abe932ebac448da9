"""Spread graphs: parents, depth, statistics and export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import kept


def default_parents(nodes: DataFrame, asset: str, node: str, order: list, parent: str | None = None) -> DataFrame:
    """Add each node's parent: the given one, or the asset's earliest node for all later ones."""
    earliest = nodes.groupBy(F.col(asset).alias("_asset")).agg(F.min_by(node, F.struct(*order)).alias("_earliest"))
    rows = nodes.join(earliest, F.col(asset).eqNullSafe(F.col("_asset")))
    fallback = F.when(F.col(node) != F.col("_earliest"), F.col("_earliest"))
    return rows.withColumn("parent_id", F.coalesce(F.col(parent), fallback) if parent else fallback).drop("_asset", "_earliest")


def derived_edges(pairs: DataFrame, score: str, least: float = 0.87) -> DataFrame:
    """Edges from original to copy where the score is high enough."""
    return pairs.where(F.col(score) >= least)


def depths(edges: DataFrame, node: str = "node_id", parent: str = "parent_id") -> DataFrame:
    """Depth of each node of a forest by pointer jumping: after i rounds a node knows its ancestor 2^i steps up, so long chains take few joins. A parent that is no node counts as a root above."""
    state = kept(edges.select(F.col(node).alias("node"), F.col(parent).alias("up"), F.when(F.col(parent).isNull(), 0).otherwise(1).alias("depth")), "depths")
    for _ in range(64):
        if state.where("up is not null").isEmpty():
            return state.select(F.col("node").alias(node), "depth")
        far = state.select(F.col("node").alias("up"), F.col("up").alias("far"), F.col("depth").alias("more"))
        state = kept(state.join(far, "up", "left").select("node", F.col("far").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "depths")
    raise ValueError("the edges have a cycle")


def spread_stats(nodes: DataFrame, asset: str, reach: str, platform: str) -> DataFrame:
    return nodes.groupBy(asset).agg(F.count(F.lit(1)).alias("incidents"), F.sum(reach).alias("reach"), F.count_distinct(platform).alias("platforms"))


def platform_counts(sightings: DataFrame) -> DataFrame:
    return sightings.groupBy("asset_id", "platform").agg(F.count(F.lit(1)).alias("n"))


def node_link(nodes: DataFrame, edges: DataFrame, asset: str) -> DataFrame:
    """One row per asset: its nodes and its links, each in id order."""
    own = nodes.groupBy(asset).agg(F.sort_array(F.collect_list("node_id")).alias("nodes"))
    links = edges.where("parent_id is not null").groupBy(asset).agg(F.sort_array(F.collect_list(F.struct("parent_id", "node_id"))).alias("links"))
    return own.join(links, asset, "left")


def platform_summary(assets: DataFrame, sightings: DataFrame) -> DataFrame:
    """Per asset: width (sightings), depth (1 if there are any) and the counts of its platforms as a map; zeros for an asset without."""
    counts = platform_counts(sightings).groupBy("asset_id").agg(F.sum("n").alias("width"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("platform", "n")))).alias("platforms"))
    rows = assets.select("asset_id").distinct().join(counts, "asset_id", "left")
    return rows.select("asset_id", F.coalesce("width", F.lit(0)).alias("width"), F.when(F.col("width") > 0, 1).otherwise(0).alias("depth"), F.coalesce("platforms", F.expr("cast(map() as map<string,bigint>)")).alias("platforms"))


def asset_nodes(assets: DataFrame, content: str) -> DataFrame:
    """A node of the graph for each asset, with the hash of its content."""
    return assets.select(F.concat(F.lit("asset:"), F.col("asset_id").cast("string")).alias("node_id"), F.lit("Asset").alias("type"), F.sha2(F.col(content).cast("string"), 256).alias("dna_hash"))
