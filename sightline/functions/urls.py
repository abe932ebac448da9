"""Hosts, domains and media links as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Known piracy hosts, boosts of the crawl queue by apex domain, routing policy (domain, allowed, requests a second).
PIRACY = ("streameast.live", "sportsurge.net", "laola1.tv", "vipleague.lc", "buffstreams.sx", "totalsportek.pro")
BOOSTS = {"imgur.com": 200, "unsplash.com": 180, "pexels.com": 180, "flickr.com": 160, "pinterest.com": 150, "500px.com": 140, "behance.net": 130, "deviantart.com": 120, "pixabay.com": 110, "artstation.com": 150, "shutterstock.com": 100, "stock.adobe.com": 100}
POLICIES = (
    ("instagram.com", False, 0.0), ("facebook.com", False, 0.0), ("whatsapp.com", False, 0.0),
    ("imgur.com", True, 5.0), ("unsplash.com", True, 3.0), ("pexels.com", True, 3.0), ("pinterest.com", True, 2.0), ("reddit.com", True, 2.0), ("deviantart.com", True, 1.5), ("youtube.com", True, 1.0),
    ("tiktok.com", True, 1.0), ("tineye.com", True, 2.0), ("bing.com", True, 2.0), ("pixabay.com", True, 3.0), ("artstation.com", True, 2.0), ("shutterstock.com", True, 1.0),
)
DEFAULT_RPS = 2.0
NO_MEDIA_ENDINGS = ("svg", "ico", "gif", "webp")
NO_MEDIA_WORDS = ("1x1", "pixel", "tracking")


def host(url: Column) -> Column:
    """The part between the second and third slash; it may keep a port."""
    return F.get(F.split(url, "/"), F.lit(2))


def apex(url: Column) -> Column:
    """The last two labels of the host; a url without ``//`` is its own domain."""
    own = F.split_part(F.split_part(F.split_part(url, F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1)), F.lit("?"), F.lit(1))
    labels = F.split(own, "[.]")
    return F.when(~F.contains(url, F.lit("//")), url).when(F.size(labels) >= 2, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(own)


def reversed_labels(domain: Column) -> Column:
    return F.reverse(F.split(F.lower(domain), "[.]"))


def boost(domain: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in BOOSTS.items() for x in pair])[domain], F.lit(0))


def cooldown(age_seconds: Column) -> Column:
    """500 falling to 0 over a minute."""
    return F.greatest(F.lit(0.0), 500.0 - age_seconds * (500.0 / 60.0))


def is_media(url: Column) -> Column:
    """An http(s) link with a host that does not look like an icon or a tracking pixel."""
    low = F.lower(url)
    bad = low.rlike(r"\.(" + "|".join(NO_MEDIA_ENDINGS) + r")($|[?#])") | low.rlike("|".join(NO_MEDIA_WORDS))
    return F.coalesce(low.rlike("^https?://[^/?#]+") & ~bad, F.lit(False))


def usable_response(content_type: Column, body: Column, least: int = 100) -> Column:
    """An image by its content type, and long enough to be one."""
    return F.coalesce(F.lower(content_type).rlike("image|octet-stream") & (F.octet_length(body) >= least), F.lit(False))


def permitted(host_name: Column, domains: Sequence[str]) -> Column:
    """Whether any permitted string occurs in the host."""
    return F.exists(F.array(*[F.lit(d) for d in domains]), lambda d: F.instr(host_name, d) > 0) if domains else F.lit(False)


def domain_class(host_name: Column, licensed: Column) -> Column:
    piracy = F.lit(False)
    for name in PIRACY:
        piracy |= F.contains(host_name, F.lit(name))
    return F.when(piracy, "CRITICAL_PIRACY").when(licensed, "LICENSED").otherwise("UNKNOWN")


def blocked(url: Column, words: Sequence[str]) -> Column:
    """Whether any of the words occurs in the url."""
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(url, w)) if words else F.lit(False)


#: Platforms whose processing is simulated, by what their urls hold; size of the canvas (width, height).
PLATFORM_WORDS = ("instagram", "tiktok")
CANVAS = {"instagram": (1080, 1080), "tiktok": (1080, 1920), "twitter": (1200, 675)}


def simulated_platform(url: Column) -> Column:
    """The platform whose processing a crawled url's media went through; null if none is known."""
    out = F.lit(None).cast("string")
    for word in reversed(PLATFORM_WORDS):
        out = F.when(F.contains(url, F.lit(word)), word).otherwise(out)
    return out


def join_url(base: Column, link: Column) -> Column:
    """The link as seen from its page."""

    @F.pandas_udf("string")
    def joined(base: pd.Series, link: pd.Series) -> pd.Series:
        from urllib.parse import urljoin

        return pd.Series([None if b is None or x is None else urljoin(b, x) for b, x in zip(base, link)])

    return joined(base, link)
