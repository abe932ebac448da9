"""Landed crawl results: media links of pages, feeds, posts and search hits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls

#: Seconds at which a video is sampled.
SAMPLE_TIMES = (0, 5, 15, 30)
MEDIA = r"""<(img|video|source)\b[^>]*?\b(?:data-lazy-src|data-src|src)\s*=\s*["']([^"']+)["']"""
LINK = r"""<a\b[^>]*?\bhref\s*=\s*["']([^"']+)["']"""
NEXT = r"""<a\b[^>]*\bclass\s*=\s*["'][^"']*\bnext-page\b[^"']*["'][^>]*\bhref\s*=\s*["']([^"']+)["']"""


def media_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """url, kind (img, video, source), media_url of all media of each page, as seen from the page."""
    found = F.transform(F.arrays_zip(F.regexp_extract_all(html, F.lit(MEDIA), F.lit(1)).alias("kind"), F.regexp_extract_all(html, F.lit(MEDIA), F.lit(2)).alias("link")), lambda x: x)
    rows = pages.select(url, F.explode(found).alias("x")).select(url, "x.kind", "x.link")
    return rows.select(url, "kind", urls.join_url(F.col(url), F.col("link")).alias("media_url"))


def article_media(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """The same for article pages, without icons and tracking pixels."""
    return media_links(pages, url, html).where(urls.is_media(F.col("media_url")))


def post_sources(posts: DataFrame) -> DataFrame:
    """What to download of each post: its thumbnail, else its image; posts with neither are dropped."""
    return posts.withColumn("source", F.coalesce("thumbnail_url", "image_url")).where("source is not null")


def suspected(searches: DataFrame, images: DataFrame, licensed: Sequence[str]) -> DataFrame:
    """url, sources, class: hits of phrase and image searches, one row for each url."""
    both = searches.select("url", F.lit("search").alias("source")).unionByName(images.select("url", F.lit("image").alias("source")))
    rows = both.groupBy("url").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    return rows.withColumn("class", urls.domain_class(urls.host(F.col("url")), urls.apex(F.col("url")).isin(*licensed)))


def sampled(frames: DataFrame, key: str, at: str, frame: str, times: Sequence[int] = SAMPLE_TIMES) -> DataFrame:
    """The frames at the sampling times, each with its place among those that could be read and its own time; ``duration`` is the video's last time."""
    rows = frames.withColumn("duration", F.max(at).over(Window.partitionBy(key))).where(F.col(at).isin(*times) & F.col(frame).isNotNull())
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(at)) - 1)


def page_links(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, position and href of all links of each page."""
    return pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(LINK), F.lit(1))).alias("position", "href"))


def next_page(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, NEXT, 1), F.lit(""))


def feed_links(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """Links of RSS items and Atom entries; entries without one are dropped."""
    items = F.regexp_extract_all(xml, F.lit(r"(?s)<(?:item|entry)\b.*?</(?:item|entry)>"), F.lit(0))
    rows = feeds.select(*[c for c in feeds.columns if c != xml], F.explode(items).alias("_item"))
    own = F.coalesce(F.nullif(F.regexp_extract("_item", r"(?s)<link[^>]*>\s*([^<\s]+)\s*</link>", 1), F.lit("")), F.nullif(F.regexp_extract("_item", r"""<link[^>]*\bhref=["']([^"']+)["']""", 1), F.lit("")))
    return rows.withColumn("link", own).where("link is not null").drop("_item")


def recent_posts(posts: DataFrame, as_of, hours: int = 48, per_tag: int = 50) -> DataFrame:
    """The newest posts of each tag with bytes and, if hours are given, of the last hours."""
    rows = posts.where("media_bytes is not null")
    if hours:
        rows = rows.where(F.col("taken_at") >= F.lit(as_of) - F.make_interval(hours=F.lit(hours)))
    nth = F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("taken_at"), "post_id"))
    return rows.withColumn("_nth", nth).where(F.col("_nth") <= per_tag).drop("_nth")


def frames(videos: DataFrame, every: int = 5) -> DataFrame:
    """One row for each sampled frame, its time kept with it: videos with an array of frames."""
    return videos.select("video_id", F.posexplode("frames").alias("i", "frame")).select("video_id", (F.col("i") * every).alias("t"), "frame")


def jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, partitions: int, **options) -> DataFrame:
    """A relational table read in ranges of a column."""
    return spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=partitions, properties=options)
