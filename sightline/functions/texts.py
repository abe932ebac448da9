"""Windows, hashtags, search queries, reports and embedded tags as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hashtags by league, in the order in which names are looked for.
HASHTAGS = (
    ("IPL", ("ipl", "iplt20", "cricket")), ("NBA", ("nba", "basketball", "nbahighlights")), ("NFL", ("nfl", "football", "nflhighlights")),
    ("FIFA", ("fifa", "football", "fifaworldcup")), ("Premier League", ("premierleague", "epl", "football")), ("UEFA", ("uefaliga", "championsleague", "football")),
)
DEFAULT_HASHTAGS = ("sportshighlights",)


def hashtags(league: Column) -> Column:
    """Tags of the first league whose name occurs, whatever its case."""
    out = F.array(*[F.lit(t) for t in DEFAULT_HASHTAGS])
    for name, tags in reversed(HASHTAGS):
        out = F.when(F.contains(F.lower(league), F.lit(name.lower())), F.array(*[F.lit(t) for t in tags])).otherwise(out)
    return out


def window_bounds(window: Column) -> tuple[Column, Column]:
    """Start and end of a text ``start / end``; null where either is malformed. A trailing Z is dropped."""
    return tuple(F.try_to_timestamp(F.regexp_replace(F.trim(F.split_part(window, F.lit("/"), F.lit(i))), "Z+$", "")) for i in (1, 2))


def percent(score: Column) -> Column:
    return F.format_string("%.2f%%", score * 100)


#: Search phrases, with the names of what is put in, at most so many of them, and of players and keywords.
SEARCHES = (
    'filetype:jpg "{org}" -{domain}',
    'filetype:png "{event}" -{domain}',
    'inurl:upload "{league}" highlight',
    'site:reddit.com "{org}" highlights',
    'site:twitter.com "{event}" media',
    'site:instagram.com "{hashtag}"',
    '"stolen from" OR "found online" "{org}" sport',
    '"{asset}" OR "{seal}"',
    'site:streameast.live OR site:sportsurge.net "{league}"',
    '"{event}" "stream" OR "download" OR "full match" -"{domain}"',
)
PLAYER_SEARCH = '"{player}" "{event}" highlight -{domain}'
KEYWORD_SEARCH = '"{event}" {keywords} -{domain}'
MOST_SEARCHES, MOST_PLAYERS, MOST_KEYWORDS = 12, 2, 3


def _filled(template: str, values: dict[str, Column]) -> Column:
    """A template with columns put in; a part is a literal or a name."""
    import string

    parts = []
    for text, name, _, _ in string.Formatter().parse(template):
        parts += [F.lit(text)] if text else []
        parts += [values[name]] if name else []
    return F.concat(*parts)


def search_queries(org: Column, event: Column, league: Column, domain: Column, hashtag: Column, asset_id: Column, seal: Column, players: Column, keywords: Column) -> Column:
    """Search phrases for an asset: the templates, one for each of the first players, one for the first keywords, joined by OR, if there are any; the first dozen of all."""
    values = {"org": org, "event": event, "league": league, "domain": domain, "hashtag": hashtag, "asset": F.substring(asset_id, 1, 8), "seal": F.substring(seal, 1, 8)}
    fixed = F.array(*[_filled(t, values) for t in SEARCHES])
    named = F.transform(F.slice(players, 1, MOST_PLAYERS), lambda p: _filled(PLAYER_SEARCH, values | {"player": p}))
    worded = F.when(F.size(keywords) > 0, F.array(_filled(KEYWORD_SEARCH, values | {"keywords": F.array_join(F.slice(keywords, 1, MOST_KEYWORDS), " OR ")})))
    return F.slice(F.concat(fixed, named, F.coalesce(worded, F.expr("cast(array() as array<string>)"))), 1, MOST_SEARCHES)


#: The embedded packet's tags.
PACKET_TAGS = ("AssetID", "OrgID", "Signature", "SignedAt", "PublicKeyURL")


def packet(values: dict[str, Column], prefix: str = "smc") -> Column:
    """A metadata packet with a value for each tag."""
    inner = [F.concat(F.lit(f"<{prefix}:{tag}>"), F.coalesce(values[tag], F.lit("")), F.lit(f"</{prefix}:{tag}>")) for tag in PACKET_TAGS]
    return F.concat(F.lit('<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description rdf:about="">'), *inner, F.lit("</rdf:Description></rdf:RDF></x:xmpmeta>"))


def notice(violation: Column, date: Column, owner: Column, platform: Column, url: Column, score: Column, severity: Column, metrics: Column) -> Column:
    """A takedown notice in Markdown, with the graph metrics (a struct or map) as JSON."""
    return F.concat_ws(
        "\n", F.lit("# Takedown notice"), F.format_string("Date: %s", date), F.format_string("Violation: %s", violation), F.format_string("Owner: %s", owner),
        F.format_string("Platform: %s, url: %s", platform, url), F.format_string("Score: %s, severity: %s", percent(score), severity), F.concat(F.lit("Spread: "), F.to_json(metrics)),
    )


def evidence_report(report_id: Column, asset_id: Column, owner: Column, source: Column, severity: Column, scores: dict[str, Column], commitment: Column, generated: Column) -> Column:
    """The evidence text of one sighting, in Markdown."""
    from .similarity import WEIGHTS

    rows = [F.format_string("| %s | %s | %s |", F.lit(name), percent(scores[name]), F.lit(f"{WEIGHTS[name]:.0%}")) for name in WEIGHTS]
    head = [F.lit("# Evidence"), F.format_string("Report: %s", report_id), F.format_string("Generated: %s", generated), F.lit("## Asset"), F.format_string("Asset: %s, owner: %s", asset_id, owner), F.lit("## Copy")]
    tail = [F.format_string("| fusion | %s | 100%% |", percent(scores["fusion"])), F.lit("## Ownership"), F.format_string("Commitment: %s", F.coalesce(commitment, F.lit("pending")))]
    found = [F.format_string("Source: %s, severity: %s", source, severity), F.lit("## Layers"), F.lit("| layer | match | weight |"), F.lit("| --- | --- | --- |")]
    return F.concat_ws("\n", *head, *found, *rows, *tail)


def embedded_tag(packet: Column, name: str) -> Column:
    """The value of a tag in an embedded metadata packet, as an element or an attribute."""
    element = F.regexp_extract(packet, rf"<(?:\w+:)?{name}>([^<]*)</", 1)
    attribute = F.regexp_extract(packet, rf'(?:\w+:)?{name}="([^"]*)"', 1)
    return F.coalesce(F.nullif(element, F.lit("")), F.nullif(attribute, F.lit("")))
