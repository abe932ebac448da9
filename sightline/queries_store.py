"""Registered queries of the store: sources, sinks, registry, custody, crawl state, streams and schedules."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import views
from .functions import hashing, texts, urls
from .functions import severity as sev
from .operators import crawl, custody, graph, registry, sightings, stats
from .queries import _ASSETS, _REQUESTS, _SIGHTINGS, _nodes, _streamed, query
from .sources import crawled, stores
from .streaming import pipeline, schedule, stateful
from .workspace import fresh_folder, kept


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "events")


# ---- lookups and projections ------------------------------------------------------------------


@query("""SELECT c_custkey AS wanted, e.event_id IS NOT NULL AS found, CAST(json_extract(props, '$.k') AS BIGINT) AS k, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at
FROM customer LEFT JOIN events e ON e.event_id = 7 * c_custkey""")
def asset_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by key, their JSON decoded and their time as ISO text; keys that are not there give nulls."""
    wanted = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("wanted"), (F.col("c_custkey") * 7).alias("event_id"))
    found = stores.looked_up(_events(spark, sf_dir).select("event_id", "props", "ts"), wanted, "event_id", json="props", schema="k long", at="ts")
    return found.select("wanted", "found", "props.k", F.col("ts").alias("at"))


@query("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS size, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS total, CAST(embedding[64] AS DOUBLE) AS last FROM embeddings")
def vector_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored vectors as bytes, read back as numbers."""
    from .functions import similarity as sim

    raw = views.table(spark, sf_dir, "embeddings").select("vec_id", sim.pack_float32(F.col("embedding")).alias("raw"))
    v = F.transform(sim.unpack_float32(F.col("raw")), lambda x: x.cast("double"))
    return raw.select("vec_id", v.alias("v")).select("vec_id", F.size("v").alias("size"), F.round(sim.total(F.col("v")), 5).alias("total"), F.get("v", F.lit(63)).alias("last"))


@query(f"WITH {_SIGHTINGS} SELECT CAST(sighting_id AS VARCHAR) AS sighting_id, CAST(asset_id AS VARCHAR) AS asset_id, platform, strftime(detected_at, '%Y-%m-%dT%H:%M:%S') AS detected_at, severity FROM sightings")
def sighting_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sightings.listed(views.sightings(spark, sf_dir)).select("sighting_id", "asset_id", "platform", "detected_at", "severity")


@query("""WITH r AS (SELECT event_id, CAST(event_id % 900 AS INTEGER) - 50 AS hours, CASE event_id % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'severe' WHEN 3 THEN NULL ELSE 'Low' END AS severity FROM events)
SELECT event_id, hours BETWEEN 1 AND 720 AND (severity IS NULL OR upper(severity) IN ('MISS', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL')) AS valid, upper(coalesce(severity, 'MEDIUM')) AS severity,
  CASE upper(coalesce(severity, 'MEDIUM')) WHEN 'MISS' THEN 0 WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'CRITICAL' THEN 4 ELSE 2 END AS rank FROM r""")
def request_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments of listing calls: which are valid, and what they mean."""
    e = F.col("event_id")
    rows = _events(spark, sf_dir).select("event_id", (e % 900 - 50).cast("int").alias("hours"), F.when(e % 5 == 0, "high").when(e % 5 == 1, "CRITICAL").when(e % 5 == 2, "severe").when(e % 5 == 4, "Low").alias("severity"))
    valid, severity = sightings.checked_arguments(F.col("hours"), F.col("severity"))
    return rows.select("event_id", valid.alias("valid"), severity.alias("severity"), sev.rank(severity).alias("rank"))


@query("""WITH k AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'short' WHEN 1 THEN 'key-of-organisation-' || c_custkey WHEN 2 THEN 'key-of-organisation-' || (c_custkey + 1) ELSE repeat('x', 129) END AS key FROM customer),
o AS (SELECT c_custkey AS org_id, sha256('key-of-organisation-' || c_custkey) AS hash, 'PEM ' || c_custkey AS pem FROM customer WHERE c_custkey % 3 <> 0)
SELECT c_custkey AS request, org_id, pem AS public_key_pem FROM k LEFT JOIN o ON o.hash = sha256(k.key) AND length(k.key) BETWEEN 16 AND 128""")
def api_key_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The organisation of each request's key, among active ones."""
    c = F.col("c_custkey")
    name = F.lit("key-of-organisation-")
    rows = views.table(spark, sf_dir, "customer")
    orgs = rows.select(c.alias("org_id"), hashing.key_hash(F.concat(name, c.cast("string"))).alias("api_key_hash"), F.concat(F.lit("PEM "), c.cast("string")).alias("public_key_pem"), (c % 3 != 0).alias("active"))
    key = F.when(c % 4 == 0, "short").when(c % 4 == 1, F.concat(name, c.cast("string"))).when(c % 4 == 2, F.concat(name, (c + 1).cast("string"))).otherwise(F.repeat(F.lit("x"), 129))
    return registry.organisations(orgs, rows.select(c.alias("request"), key.alias("key")), "key").select("request", "org_id", "public_key_pem")


@query(f"WITH {_ASSETS} SELECT asset_id, CASE WHEN org_id < 4 THEN 'PEM ' || org_id END AS public_key_pem FROM assets")
def asset_public_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    orgs = spark.range(4).select(F.col("id").alias("org_id"), F.concat(F.lit("PEM "), F.col("id").cast("string")).alias("public_key_pem"))
    return registry.public_keys(views.assets(spark, sf_dir).select("asset_id", "org_id"), orgs).select("asset_id", "public_key_pem")


@query("""WITH r AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'Application/Octet-Stream' WHEN 2 THEN 'text/html' END AS kind, page_id * 7 % 220 AS size FROM pages)
SELECT page_id, coalesce(page_id % 4 < 2 AND size >= 100, false) AS usable FROM r""")
def usable_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched responses that can be images: by content type and length."""
    p = F.col("page_id")
    kind = F.when(p % 4 == 0, "image/png").when(p % 4 == 1, "Application/Octet-Stream").when(p % 4 == 2, "text/html")
    body = F.encode(F.repeat(F.lit("x"), (p * 7 % 220).cast("int")), "utf-8")
    return views.table(spark, sf_dir, "pages").select("page_id", urls.usable_response(kind, body).alias("usable"))


@query(f"WITH {_REQUESTS} SELECT seq, array_to_string(list_reverse(string_split(lower(host), '.')), '.') AS labels, contains(url, '/en/') OR contains(url, 'blog') AS blocked FROM requests")
def reversed_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.requests(spark, sf_dir).select("seq", F.array_join(urls.reversed_labels(F.col("host")), ".").alias("labels"), urls.blocked(F.col("url"), ["/en/", "blog"]).alias("blocked"))


_BOOSTED = ", ".join(f"('{d}', {b})" for d, b in urls.BOOSTS.items())


@query(f"""WITH b AS (SELECT * FROM (VALUES {_BOOSTED}) AS t(domain, boost)), d AS (SELECT *, row_number() OVER (ORDER BY domain) - 1 AS n FROM (SELECT domain FROM b UNION ALL SELECT 'other.example')),
e AS (SELECT event_id, d.domain FROM events JOIN d ON d.n = event_id % 13) SELECT event_id, domain, coalesce(boost, 0) AS boost FROM e LEFT JOIN b USING (domain)""")
def domain_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = sorted([*urls.BOOSTS, "other.example"])
    rows = _events(spark, sf_dir).select("event_id", F.get(F.array(*[F.lit(n) for n in names]), (F.col("event_id") % 13).cast("int")).alias("domain"))
    return rows.withColumn("boost", urls.boost(F.col("domain")))


_PHRASES = ", ".join("'" + t.replace("'", "''") + "'" for t in texts.SEARCHES)


@query(f"""WITH {_ASSETS}, t AS (SELECT asset_id, league, 'asset-' || lpad(CAST(asset_id AS VARCHAR), 6, '0') AS name, asset_id % 4 AS players, asset_id % 5 AS keywords FROM assets),
f AS (SELECT t.*, list_transform([{_PHRASES}], lambda q: replace(replace(replace(replace(replace(replace(replace(q, '{{org}}', 'Org'), '{{event}}', 'Final ' || asset_id), '{{league}}', league), '{{domain}}', 'own.example'), '{{hashtag}}', 'tag'), '{{asset}}', substr(name, 1, 8)), '{{seal}}', '00ff00ff')) AS fixed FROM t),
n AS (SELECT *, list_transform(range(0, least(players, 2)), lambda i: '"Player ' || i || '" "Final ' || asset_id || '" highlight -own.example') AS named,
  CASE WHEN keywords > 0 THEN ['"Final ' || asset_id || '" ' || array_to_string(list_transform(range(0, least(keywords, 3)), lambda i: 'word' || i), ' OR ') || ' -own.example'] ELSE [] END AS worded FROM f)
SELECT asset_id, CAST(unnest(range(1, len(list_concat(list_concat(fixed, named), worded)[1:12]) + 1)) AS INTEGER) AS nth, unnest(list_concat(list_concat(fixed, named), worded)[1:12]) AS phrase FROM n""")
def search_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("asset_id")
    name = F.concat(F.lit("asset-"), F.lpad(a.cast("string"), 6, "0"))
    players = F.transform(F.slice(F.sequence(F.lit(0), F.lit(3)), F.lit(1), (a % 4).cast("int")), lambda i: F.concat(F.lit("Player "), i.cast("string")))
    keywords = F.transform(F.slice(F.sequence(F.lit(0), F.lit(4)), F.lit(1), (a % 5).cast("int")), lambda i: F.concat(F.lit("word"), i.cast("string")))
    found = texts.search_queries(F.lit("Org"), F.concat(F.lit("Final "), a.cast("string")), F.col("league"), F.lit("own.example"), F.lit("tag"), name, F.lit("00ff00ff00ff"), players, keywords)
    return views.assets(spark, sf_dir).select("asset_id", F.posexplode(found).alias("i", "phrase")).select("asset_id", (F.col("i") + 1).alias("nth"), "phrase")


# ---- landed sources ---------------------------------------------------------------------------

_MEDIA_PAGES = """p AS (SELECT page_id, 'https://site' || page_id % 9 || '.example/a/' || page_id AS url FROM pages),
m AS (SELECT page_id, 'https://site' || page_id % 9 || '.example' AS root, url, unnest(['img', 'img', 'img', 'video', 'source', 'img']) AS kind,
  unnest(['/m/' || page_id || '.jpg', 'rel/' || page_id || '.png', 'https://cdn.example/pixel' || page_id || '.png', '/v/' || page_id || '.mp4', 'https://cdn.example/' || page_id || '.webm', '/icons/x.svg']) AS link FROM p),
joined AS (SELECT page_id, url, kind, CASE WHEN starts_with(link, 'https:') THEN link WHEN starts_with(link, '/') THEN root || link ELSE root || '/a/' || link END AS media_url FROM m)"""


def _media_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id").cast("string")
    url = F.concat(F.lit("https://site"), (F.col("page_id") % 9).cast("string"), F.lit(".example/a/"), p)
    media = F.concat(
        F.lit('<p><img class="a" src="/m/'), p, F.lit('.jpg"><img data-src=\'rel/'), p, F.lit(".png'><img src=\"https://cdn.example/pixel"), p, F.lit('.png"></p><video controls src="/v/'), p,
        F.lit('.mp4"><source src="https://cdn.example/'), p, F.lit('.webm"></video><img alt="" data-lazy-src="/icons/x.svg">'),
    )
    return views.table(spark, sf_dir, "pages").select("page_id", url.alias("url"), F.concat("html", media).alias("html"))


@query(f"WITH {_MEDIA_PAGES} SELECT url, kind, media_url FROM joined")
def page_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All media of crawled pages, as seen from the page."""
    return crawled.media_links(_media_pages(spark, sf_dir))


@query(f"WITH {_MEDIA_PAGES} SELECT url, kind, media_url FROM joined WHERE NOT contains(media_url, 'pixel') AND NOT ends_with(media_url, '.svg')")
def article_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media of article pages without icons and tracking pixels."""
    return crawled.article_media(_media_pages(spark, sf_dir))


@query("""SELECT page_id, count(*) AS links, count(DISTINCT href) AS targets FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"'']+)["'']', 1)) AS href FROM pages) GROUP BY page_id""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawled.page_links(views.table(spark, sf_dir, "pages"), "page_id").groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), F.count_distinct("href").alias("targets"))


@query("""SELECT o_custkey AS feed, 'https://n.example/' || o_orderkey AS link FROM orders WHERE o_orderkey % 4 <> 3""")
def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of RSS items and Atom entries; some entries have none."""
    k = F.col("o_orderkey")
    url = F.concat(F.lit("https://n.example/"), k.cast("string"))
    item = F.when(k % 4 == 0, F.concat(F.lit("<item><title>t</title><link>"), url, F.lit("</link></item>"))).when(k % 4 == 1, F.concat(F.lit('<entry><link rel="alternate" href="'), url, F.lit('"/></entry>'))).when(k % 4 == 2, F.concat(F.lit("<item>\n<link> "), url, F.lit("\n</link>\n</item>"))).otherwise("<item><title>no link</title></item>")
    feeds = views.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("feed")).agg(F.concat(F.lit("<rss><channel><link>https://n.example/</link>"), F.array_join(F.collect_list(item), ""), F.lit("</channel></rss>")).alias("xml"))
    return crawled.feed_links(feeds)


_POSTS = "posts AS (SELECT event_id AS post_id, event_type AS tag, ts AS taken_at FROM events WHERE event_id % 3 <> 0)"


@query(f"""WITH {_POSTS}, c AS (SELECT max(ts) AS now FROM events) SELECT post_id, tag FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY taken_at DESC, post_id) AS n FROM posts, c WHERE taken_at >= now - INTERVAL 48 HOUR) WHERE n <= 50""")
def tag_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest posts of each tag in two days that have bytes."""
    return crawled.recent_posts(_posts(spark, sf_dir), views.as_of(spark, sf_dir)).select("post_id", "tag")


@query(f"WITH {_POSTS} SELECT post_id, tag FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY taken_at DESC, post_id) AS n FROM posts) WHERE n <= 20")
def tag_posts_any_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawled.recent_posts(_posts(spark, sf_dir), None, hours=0, per_tag=20).select("post_id", "tag")


def _posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return _events(spark, sf_dir).select(e.alias("post_id"), F.col("event_type").alias("tag"), F.col("ts").alias("taken_at"), F.when(e % 3 != 0, F.encode(e.cast("string"), "utf-8")).alias("media_bytes"))


@query("""SELECT event_id AS post_id, CASE WHEN event_id % 2 = 0 THEN 'thumb/' || event_id ELSE 'image/' || event_id END AS source FROM events WHERE event_id % 2 = 0 OR event_id % 3 = 0""")
def post_downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to download of each post: its thumbnail, else its image; posts with neither are dropped."""
    e = F.col("event_id")
    rows = _events(spark, sf_dir).select(e.alias("post_id"), F.when(e % 2 == 0, F.concat(F.lit("thumb/"), e.cast("string"))).alias("thumbnail_url"), F.when(e % 3 == 0, F.concat(F.lit("image/"), e.cast("string"))).alias("image_url"))
    return crawled.post_sources(rows).select("post_id", "source")


@query("SELECT 'https://j.example/' || o_orderkey AS url, CAST(o_custkey % 5 AS VARCHAR) AS org_id, CAST(o_custkey AS VARCHAR) AS asset_id, CAST(o_orderkey % 10 AS INTEGER) AS priority FROM orders")
def crawl_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that arrive as JSON lines, read as a stream."""
    base = fresh_folder(spark, "jobs")
    o = views.table(spark, sf_dir, "orders")
    o.select(F.concat(F.lit("https://j.example/"), F.col("o_orderkey").cast("string")).alias("url"), (F.col("o_custkey") % 5).cast("string").alias("org_id"), F.col("o_custkey").cast("string").alias("asset_id"), (F.col("o_orderkey") % 10).alias("priority")).write.json(f"{base}/in")
    pipeline.run_once(stores.jobs(spark, f"{base}/in"), f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out")


@query("""WITH RECURSIVE n AS (SELECT page_id AS page, page_id + 7 AS next FROM pages WHERE page_id % 50 < 40), r AS (SELECT DISTINCT page_id AS page FROM pages WHERE page_id % 100 = 3 UNION SELECT n.next FROM r JOIN n ON n.page = r.page) SELECT page FROM r""")
def paginated_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that are reached from the start pages by their links to the next."""
    p = F.col("page_id")
    link = F.when(p % 50 < 40, F.concat(F.lit('<a class="btn next-page" href="'), (p + 7).cast("string"), F.lit('">next</a>'))).otherwise("")
    pages = views.table(spark, sf_dir, "pages").select("page_id", F.concat("html", link).alias("html"))
    links = pages.select(p.alias("page"), crawled.next_page(F.col("html")).cast("long").alias("next")).where("next is not null")
    return registry.pages_reached(links, pages.where("page_id % 100 = 3").select("page_id"))


@query(f"""WITH {_REQUESTS}, hits AS (SELECT url, host, domain, 'search' AS source, seq FROM requests WHERE seq % 2 = 0 UNION ALL SELECT url, host, domain, 'image', seq FROM requests WHERE seq % 3 = 0)
SELECT url, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, CASE WHEN any_value(domain) = 'example.org' THEN 'LICENSED' ELSE 'UNKNOWN' END AS class FROM hits GROUP BY url""")
def suspected_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed hits of phrase and image searches, one row for each url, classed by domain."""
    rows = views.requests(spark, sf_dir)
    return crawled.suspected(rows.where("seq % 2 = 0").select("url"), rows.where("seq % 3 = 0").select("url"), ["example.org"])


# ---- sinks ------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT vec_id AS asset_id, ('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 8))::BIGINT % 64 AS bucket, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)
SELECT asset_id, row_number() OVER (ORDER BY asset_id % 2, bucket, asset_id) - 1 AS index_id, round(v[1] / sqrt(list_inner_product(v, v)), 6) AS first FROM a""")
def register_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All assets registered in two rounds: unit vectors under dense ids."""
    rows = views.fingerprints(spark, sf_dir)
    empty = rows.limit(0).select(F.lit(0).cast("long").alias("index_id"), "asset_id", "clip")
    half = registry.registered(empty, rows.where("asset_id % 2 = 0"), "asset_id")
    both = registry.registered(kept(half, "index"), rows.where("asset_id % 2 = 1"), "asset_id")
    return both.select("asset_id", "index_id", F.round(F.get("clip", F.lit(0)), 6).alias("first"))


@query("SELECT count(*) AS assets, min(vec_id) AS first, max(vec_id) AS last, 0 AS before FROM embeddings")
def index_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index, stored and loaded; before that there is an empty one."""
    at = fresh_folder(spark, "index")
    rows = views.fingerprints(spark, sf_dir).select("asset_id", "clip")
    before = stores.index_of(spark, at, rows).count()
    rows.write.parquet(at)
    return stores.index_of(spark, at, rows).agg(F.count(F.lit(1)).alias("assets"), F.min("asset_id").alias("first"), F.max("asset_id").alias("last")).withColumn("before", F.lit(before).cast("int"))


@query(f"WITH {_SIGHTINGS} SELECT sighting_id, asset_id, severity, 'FORENSIC_VISUAL_MATCH' AS proof_type FROM sightings, clock WHERE detected_at >= now - INTERVAL 72 HOUR")
def stored_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sightings appended in two writes, and those of the last three days read back."""
    at = fresh_folder(spark, "sightings")
    rows = views.sightings(spark, sf_dir).select("sighting_id", "asset_id", "severity", "detected_at")
    for part in (0, 1):
        stores.append_sightings(rows.where(F.col("sighting_id") % 2 == part), at)
    since = views.as_of(spark, sf_dir) - datetime.timedelta(hours=72)
    return stores.sightings(spark, at, since).select("sighting_id", "asset_id", "severity", "proof_type")


@query(f"WITH {_SIGHTINGS} SELECT sighting_id, 'Date: ' || strftime(detected_at, '%Y-%m-%d') AS date, 'Score: ' || printf('%.2f%%', fusion_score * 100) || ', severity: CRITICAL' AS score, 'Spread: {{\"width\":' || n || ',\"depth\":1}}' AS spread FROM sightings JOIN (SELECT asset_id, count(*) AS n FROM sightings GROUP BY 1) USING (asset_id) WHERE severity = 'CRITICAL'")
def takedown_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices with their asset's spread, written as text files and read back."""
    at = fresh_folder(spark, "notices")
    rows = views.sightings(spark, sf_dir)
    spread = graph.platform_summary(rows, rows).select("asset_id", F.struct("width", "depth").alias("metrics"))
    named = rows.where("severity = 'CRITICAL'").join(spread, "asset_id")
    text = texts.notice(F.col("sighting_id"), F.date_format("detected_at", "yyyy-MM-dd"), F.lit("owner"), F.col("platform"), F.lit("https://x.example"), F.col("fusion_score"), F.col("severity"), F.col("metrics"))
    stores.write_reports(named.select(text.alias("report")), at)
    read = spark.read.option("lineSep", "\n---\n").text(at).where("value like '# Takedown%'")
    line = F.split("value", "\n")
    return read.select(F.regexp_extract("value", r"Violation: (\d+)", 1).cast("long").alias("sighting_id"), F.get(line, F.lit(1)).alias("date"), F.get(line, F.lit(5)).alias("score"), F.get(line, F.lit(6)).alias("spread"))


@query("""SELECT user_id AS asset_id, min(event_id) AS entry, sha256(user_id || '|' || sha256(arg_min(props, event_id)) || '|' || sha256('owner' || user_id || 'salt')) AS commitment, user_id % 10 <> 0 AS complete FROM events GROUP BY user_id""")
def ownership_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs written as JSON files, read back and checked for their parts; some lack one."""
    at = fresh_folder(spark, "proofs")
    rows = _events(spark, sf_dir).groupBy(F.col("user_id").alias("asset_id")).agg(F.min("event_id").alias("entry"), F.min_by("props", "event_id").alias("props"))
    asset = F.col("asset_id").cast("string")
    made = rows.select("asset_id", "entry", hashing.commitment(asset, F.col("props"), F.concat(F.lit("owner"), asset), "salt").alias("commitment"), F.when(F.col("asset_id") % 10 != 0, "00").alias("signature"), F.lit("2024-01-01T00:00:00Z").alias("timestamp"), F.lit("RSA-PSS").alias("algo"), F.lit("1").alias("v"))
    stores.write_proofs(made, at)
    read = spark.read.text(at)
    return read.select(F.get_json_object("value", "$.asset_id").cast("long").alias("asset_id"), F.get_json_object("value", "$.entry").cast("long").alias("entry"), F.get_json_object("value", "$.commitment").alias("commitment"), custody.complete_proof(F.col("value")).alias("complete"))


@query(f"WITH {_ASSETS} SELECT asset_id, CASE WHEN asset_id % 3 = 0 THEN asset_id * 1000003 % 4294967296 ELSE 0 END AS seed FROM assets WHERE asset_id % 2 = 0")
def seed_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watermark seeds registered for some assets, and looked up for others."""
    assets = views.assets(spark, sf_dir).select("asset_id").withColumn("seed", F.lit(0).cast("long"))
    marked = sightings.marked(assets, "asset_id", assets.where("asset_id % 3 = 0").select("asset_id"), seed=F.col("asset_id") * 1000003 % 4294967296)
    wanted = assets.where("asset_id % 2 = 0").select("asset_id")
    return stores.looked_up(marked, wanted, "asset_id").select("asset_id", "seed")


@query(f"WITH {_SIGHTINGS} SELECT sighting_id, '{{\"sighting_id\":' || sighting_id || ',\"severity\":\"CRITICAL\"}}' AS value FROM sightings WHERE severity = 'CRITICAL'")
def critical_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of the critical topic, as the stream makes them."""

    def messages(stream: DataFrame) -> DataFrame:
        score = ((F.col("event_id") * 7919) % 1000).cast("double") / 1000
        rows = stream.select(F.col("event_id").alias("sighting_id"), sev.stored(sev.classify_watch(score)).alias("severity"))
        return pipeline.critical(rows)

    found = _streamed(spark, sf_dir, messages)
    return found.select(F.get_json_object("value", "$.sighting_id").cast("long").alias("sighting_id"), "value")


# ---- custody ----------------------------------------------------------------------------------

_CHAIN = """WITH RECURSIVE e AS (SELECT user_id AS asset_id, CAST(event_id AS VARCHAR) AS content, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 2, ts, event_id) - 1 AS position FROM events),
chain AS (SELECT asset_id, position, content, repeat('0', 64) AS prev, sha256(content || '|' || repeat('0', 64)) AS own FROM e WHERE position = 0
UNION ALL SELECT e.asset_id, e.position, e.content, c.own, sha256(e.content || '|' || c.own) FROM chain c JOIN e ON e.asset_id = c.asset_id AND e.position = c.position + 1)"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("asset_id"), "ts", "event_id", F.col("event_id").cast("string").alias("content"))
    empty = spark.createDataFrame([], registry.EMPTY_LOG.format(asset="asset_id", kind="long"))
    half = kept(registry.appended(empty, rows.where("event_id % 2 = 0"), "asset_id", ["ts", "event_id"], "content", "sha256"), "log")
    return registry.appended(half, rows.where("event_id % 2 = 1"), "asset_id", ["ts", "event_id"], "content", "sha256")


@query(f"{_CHAIN} SELECT asset_id, position, content, prev, own FROM chain")
def custody_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries appended in two rounds to each asset's chain, listed in order."""
    return registry.custody(_log(spark, sf_dir), "asset_id")


@query(f"""{_CHAIN}, stored AS (SELECT *, CASE WHEN CAST(content AS BIGINT) % 97 = 5 THEN 'tampered' ELSE prev END AS held FROM chain),
checked AS (SELECT *, lag(own) OVER (PARTITION BY asset_id ORDER BY position) AS before FROM stored)
SELECT asset_id, count(*) AS entries, bool_and(before IS NULL OR held = before) AS valid FROM checked GROUP BY asset_id""")
def custody_chain_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of which some entries were changed after they were written."""
    log = kept(_log(spark, sf_dir), "log").withColumn("prev", F.when(F.col("content").cast("long") % 97 == 5, "tampered").otherwise(F.col("prev")))
    return custody.checked(log, "asset_id", ["position"], "own", "prev")


@query("""WITH s AS (SELECT event_id, event_id % 7 = 0 AS valid, CAST((event_id * 7919) % 1000 AS DOUBLE) / 1000 AS fusion FROM events)
SELECT event_id, CASE WHEN valid THEN 1.0 ELSE fusion END::DOUBLE AS score, CASE WHEN valid THEN 'CRITICAL' WHEN fusion > 0.75 THEN 'HIGH' ELSE 'MISS' END AS severity FROM s""")
def upload_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    score, severity = custody.decided(e % 7 == 0, ((e * 7919) % 1000).cast("double") / 1000)
    return _events(spark, sf_dir).select("event_id", score.alias("score"), severity.alias("severity"))


@query("""SELECT event_id // 20 AS video_id, user_id % 7 AS asset_id, count(*) AS frames, string_agg(event_id % 20 * 5, ',' ORDER BY event_id) AS times, string_agg(DISTINCT CASE WHEN event_type = 'purchase' THEN 'CONTAINER_MATCH' ELSE 'FORENSIC_VISUAL_MATCH' END, ',' ORDER BY CASE WHEN event_type = 'purchase' THEN 'CONTAINER_MATCH' ELSE 'FORENSIC_VISUAL_MATCH' END) AS proofs,
CASE WHEN bool_or(event_type = 'purchase') THEN 'CRITICAL' WHEN count(*) >= 2 THEN 'HIGH' ELSE 'LOW' END AS severity FROM events GROUP BY ALL""")
def video_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    proof = F.when(F.col("event_type") == "purchase", "CONTAINER_MATCH").otherwise("FORENSIC_VISUAL_MATCH")
    rows = _events(spark, sf_dir).select(F.floor(F.col("event_id") / 20).alias("video_id"), (F.col("user_id") % 7).alias("asset_id"), (F.col("event_id") % 20 * 5).alias("t"), proof.alias("proof_type"))
    return stats.video_matches(rows).select("video_id", "asset_id", "frames", F.array_join("times", ",").alias("times"), F.array_join("proofs", ",").alias("proofs"), "severity")


# ---- graphs -----------------------------------------------------------------------------------


@query("""WITH n AS (SELECT user_id AS asset_id, event_id, CASE WHEN event_id >= 3 THEN CAST(floor((event_id - 3) / 6.0) * 3 + event_id % 3 AS BIGINT) END AS parent FROM events)
SELECT asset_id, string_agg(event_id, ',' ORDER BY event_id) AS nodes, coalesce(string_agg(parent || '-' || event_id, ',' ORDER BY parent || '-' || event_id) FILTER (WHERE parent IS NOT NULL), '') AS links FROM n GROUP BY asset_id""")
def graph_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _nodes(spark, sf_dir)
    links = F.array_sort(F.transform(F.coalesce("links", F.expr("cast(array() as array<struct<parent_id:bigint,node_id:bigint>>)")), lambda x: F.concat(x["parent_id"].cast("string"), F.lit("-"), x["node_id"].cast("string"))))
    return graph.node_link(rows, rows, "asset_id").select("asset_id", F.array_join("nodes", ",").alias("nodes"), F.array_join(links, ",").alias("links"))


@query("""WITH a AS (SELECT DISTINCT user_id AS asset_id FROM events UNION SELECT 1000000 + n_nationkey FROM nation), c AS (SELECT user_id AS asset_id, event_type, count(*) AS n FROM events GROUP BY ALL),
s AS (SELECT asset_id, sum(n)::BIGINT AS width, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS platforms FROM c GROUP BY asset_id)
SELECT asset_id, coalesce(width, 0) AS width, CAST(width > 0 IS TRUE AS INTEGER) AS depth, coalesce(platforms, '') AS platforms FROM a LEFT JOIN s USING (asset_id)""")
def platform_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width, depth and platforms of every asset's spread, unknown ones included."""
    rows = views.sightings(spark, sf_dir)
    assets = rows.select("asset_id").union(views.table(spark, sf_dir, "nation").select(F.col("n_nationkey") + 1000000))
    found = graph.platform_summary(assets, rows)
    joined = F.array_join(F.transform(F.array_sort(F.map_entries("platforms")), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",")
    return found.withColumn("platforms", joined)


@query("SELECT 'asset:' || vec_id AS node_id, 'Asset' AS type, sha256(CAST(label AS VARCHAR)) AS dna_hash FROM embeddings")
def asset_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("asset_id"), "label")
    return graph.asset_nodes(rows, "label")


# ---- rates and crawl state --------------------------------------------------------------------

_TTL = """WITH RECURSIVE r AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
c AS (SELECT user_id, event_id, n, t AS stored, false AS hit FROM r WHERE n = 1
UNION ALL SELECT r.user_id, r.event_id, r.n, CASE WHEN r.t - c.stored < {ttl} THEN c.stored ELSE r.t END, r.t - c.stored < {ttl} FROM c JOIN r ON r.user_id = c.user_id AND r.n = c.n + 1)"""


@query(f"{_TTL.format(ttl='86400 * 1000000::BIGINT')} SELECT user_id, event_id, hit FROM c")
def ttl_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that a response stored at most a day ago answers."""
    return crawl.ttl_hits(_events(spark, sf_dir).select("user_id", "event_id", "ts"), "user_id", "ts", "event_id", 86400).select("user_id", "event_id", "hit")


@query("""WITH r AS (SELECT event_id, event_id % 8 AS shard, floor(value) AS k FROM events), p AS (SELECT shard, k, event_id, lag(event_id) OVER (PARTITION BY shard, k ORDER BY event_id) AS before FROM r),
n AS (SELECT p.event_id, count(DISTINCT r.k) AS others FROM p JOIN r ON r.shard = p.shard AND r.event_id > p.before AND r.event_id < p.event_id GROUP BY p.event_id),
h AS (SELECT p.shard, p.before IS NOT NULL AND coalesce(n.others, 0) < 20 AS hit FROM p LEFT JOIN n USING (event_id))
SELECT shard, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses, avg(CAST(hit AS INTEGER)) AS rate FROM h GROUP BY shard""")
def cache_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("event_id", (F.col("event_id") % 8).alias("shard"), F.floor("value").alias("k"))
    return crawl.hit_rate(crawl.lru_hits(rows, "k", "event_id", 20), "shard")


@query("""SELECT event_id, user_id % 40 * 2 AS score, user_id % 40 < 20 AS cache_hit FROM events WHERE user_id % 40 < 20 UNION ALL SELECT event_id, -1, false FROM events WHERE user_id % 40 >= 20""")
def cache_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests answered from what earlier ones of the same url gave."""
    url = F.concat(F.lit("https://h.example/"), (F.col("user_id") % 40).cast("string"))
    requests = _events(spark, sf_dir).select("event_id", url.alias("url"))
    stored = spark.range(20).select(F.concat(F.lit("https://h.example/"), F.col("id").cast("string")).alias("url"), (F.col("id") * 2).alias("score"))
    return registry.answered(requests, stored, "url").select("event_id", F.coalesce("score", F.lit(-1)).alias("score"), "cache_hit")


@query("""SELECT 'https://h.example/' || user_id AS url, max(event_id) AS at, CASE WHEN arg_max(event_id, event_id) % 3 = 0 THEN 'HIGH' ELSE 'MISS' END AS severity FROM events GROUP BY user_id""")
def cache_populated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results stored by url: the newest of each."""
    rows = _events(spark, sf_dir).select(F.concat(F.lit("https://h.example/"), F.col("user_id").cast("string")).alias("url"), F.col("event_id").alias("at"), F.when(F.col("event_id") % 3 == 0, "HIGH").otherwise("MISS").alias("severity"))
    return registry.populated(rows.where("at % 2 = 0"), rows.where("at % 2 = 1"), "url").select("url", "at", "severity")


_RPS = "CASE user_id % 5 WHEN 0 THEN 0.0 WHEN 1 THEN 0.0005 WHEN 2 THEN 0.001 WHEN 3 THEN 5.0 ELSE 2.0 END::DOUBLE"


@query(f"""WITH RECURSIVE r AS (SELECT 'd' || user_id % 5 AS domain, {_RPS} AS rps, event_id, epoch_us(ts) / 1000000.0::DOUBLE AS t, row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts, event_id) AS n FROM events),
b AS (SELECT domain, event_id, n, t, greatest(2 * rps, 1.0::DOUBLE) AS held FROM r WHERE n = 1
UNION ALL SELECT r.domain, r.event_id, r.n, r.t, least(greatest(2 * r.rps, 1.0::DOUBLE), b.held - CASE WHEN b.held >= 1 THEN 1 ELSE 0 END + (r.t - b.t) * r.rps) FROM b JOIN r ON r.domain = b.domain AND r.n = b.n + 1)
SELECT event_id, domain, CASE WHEN domain = 'd0' THEN 'blocked' WHEN held >= 1 THEN 'passed' ELSE 'limited' END AS outcome FROM b""")
def domain_gate_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole domain gate: blocked, limited by the domain's bucket, or passed."""
    table = crawl.policies(spark, (("d0", False, 0.0), ("d1", True, 0.0005), ("d2", True, 0.001), ("d3", True, 5.0)))
    rows = _events(spark, sf_dir).select("event_id", "ts", F.concat(F.lit("d"), (F.col("user_id") % 5).cast("string")).alias("domain"))
    return crawl.gated(rows, "domain", "ts", "event_id", table).select("event_id", "domain", "outcome")


@query("""WITH pushes AS (SELECT event_id AS seq, CASE event_id % 3 WHEN 0 THEN 'imgur.com' WHEN 1 THEN 'flickr.com' ELSE 'other.example' END AS domain, event_id % 100 AS priority, ts FROM events WHERE event_id % 4 <> 0),
pops AS (SELECT CASE event_id % 3 WHEN 0 THEN 'imgur.com' WHEN 1 THEN 'flickr.com' ELSE 'other.example' END AS domain, ts FROM events WHERE event_id % 4 = 0)
SELECT seq, round(priority + CASE p.domain WHEN 'imgur.com' THEN 200 WHEN 'flickr.com' THEN 160 ELSE 0 END - coalesce(greatest(0.0::DOUBLE, 500.0::DOUBLE - (epoch_us(p.ts) / 1000000.0::DOUBLE - epoch_us(q.ts) / 1000000.0::DOUBLE) * (500.0::DOUBLE / 60.0)), 0), 4) AS score
FROM pushes p ASOF LEFT JOIN pops q ON q.domain = p.domain AND q.ts <= p.ts""")
def queue_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of requests as they are pushed, after the domain's last pop."""
    e = F.col("event_id")
    rows = _events(spark, sf_dir).select(e.alias("seq"), F.when(e % 3 == 0, "imgur.com").when(e % 3 == 1, "flickr.com").otherwise("other.example").alias("domain"), (e % 100).alias("priority"), "ts")
    return crawl.cooled(rows.where("seq % 4 <> 0"), rows.where("seq % 4 = 0"), "domain", "ts").select("seq", F.round("score", 4).alias("score"))


_SCHEDULED = """q AS (SELECT event_id AS seq, user_id % 3 AS shard, sha256('GET' || 'https://h.example/' || user_id || '/' || event_id % 50) AS print, event_id % 1000 AS score FROM events),
s AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY print ORDER BY seq) = 1 THEN 'enqueued' ELSE 'filtered' END AS outcome FROM q)"""


def _scheduled(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    url = F.concat(F.lit("https://h.example/"), F.col("user_id").cast("string"), F.lit("/"), (e % 50).cast("string"))
    rows = _events(spark, sf_dir).select(e.alias("seq"), (F.col("user_id") % 3).alias("shard"), url.alias("url"), (e % 1000).alias("score"))
    return crawl.scheduled(rows, hashing.request_fingerprint(F.lit("GET"), F.col("url"), F.lit(None).cast("string")), "seq")


@query(f"WITH {_SCHEDULED} SELECT seq, outcome, CASE WHEN outcome = 'enqueued' THEN CAST(row_number() OVER (PARTITION BY shard, outcome ORDER BY score DESC, seq) AS INTEGER) END AS place FROM s")
def scheduler_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests through the duplicate filter into their shard's queue."""
    return _scheduled(spark, sf_dir).select("seq", "outcome", "place")


@query(f"""WITH {_SCHEDULED}, p AS (SELECT *, row_number() OVER (PARTITION BY shard, outcome ORDER BY score DESC, seq) AS place FROM s)
SELECT shard, count(*) FILTER (WHERE outcome = 'filtered') AS filtered, count(*) FILTER (WHERE outcome = 'enqueued') AS enqueued, count(*) FILTER (WHERE outcome = 'enqueued' AND place <= 100) AS dequeued FROM p GROUP BY shard""")
def scheduler_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each shard's scheduler has filtered, queued and, of the first hundred, given out."""
    rows = _scheduled(spark, sf_dir)
    return rows.groupBy("shard").agg(F.count_if(F.col("outcome") == "filtered").alias("filtered"), F.count_if(F.col("outcome") == "enqueued").alias("enqueued"), F.count_if(F.col("place") <= 100).alias("dequeued"))


@query("""WITH s AS (SELECT min(ts) AS a, max(ts) AS b FROM events), d AS (SELECT unnest(generate_series(date_trunc('day', a), date_trunc('day', b), INTERVAL 1 DAY)) AS day FROM s),
w AS (SELECT * FROM (VALUES ('posts', 0, 120), ('feeds', 30, 360), ('rescan', 180, 1440), ('windows', 0, 15)) AS t(sweep, first, every)),
r AS (SELECT sweep, day + to_minutes(m) AS run FROM d, w, unnest(range(first, 1440, every)) AS u(m)) SELECT sweep, run FROM r, s WHERE run > a AND run <= b""")
def sweeps_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of the periodic sweeps over the time that the events span."""
    span = _events(spark, sf_dir).agg(F.min("ts").alias("a"), F.max("ts").alias("b")).head()
    return schedule.due(spark, span["a"], span["b"]).withColumnRenamed("at", "run")


@query("""WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'match' WHEN 1 THEN 'video' WHEN 2 THEN 'rescan' WHEN 3 THEN 'evidence' ELSE 'persist' END AS task, event_id * 3 % 6 AS failures, event_id * 13 % 700 AS s FROM events),
l AS (SELECT * FROM (VALUES ('match', 3, 120, 180), ('video', 2, 300, 360), ('rescan', 1, 600, 660), ('evidence', 2, 60, 90), ('persist', 3, 30, 45)) AS v(task, retries, soft, hard))
SELECT event_id, CAST(CASE WHEN s > hard THEN retries + 1 ELSE least(failures, retries) + 1 END AS BIGINT) AS attempts, CASE WHEN s > hard THEN 'killed' WHEN failures > retries THEN 'failed' WHEN s > soft THEN 'warned' ELSE 'done' END AS ended FROM t JOIN l USING (task)""")
def retry_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    task = F.get(F.array(*[F.lit(t) for t in schedule.TASKS]), (e % 5).cast("int"))
    attempts, ended = schedule.outcome(task, e * 3 % 6, e * 13 % 700)
    return _events(spark, sf_dir).select("event_id", attempts.cast("long").alias("attempts"), ended.alias("ended"))


# ---- streams ----------------------------------------------------------------------------------


@query("SELECT DISTINCT user_id, CAST(date_trunc('day', ts) AS DATE) AS day FROM events")
def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crawl stream over events: one row for each user and day, whatever batches they come in."""
    return _streamed(spark, sf_dir, lambda s: pipeline.first_of_day(s.select("user_id", "ts"), "user_id", "ts")).select("user_id", "day")


@query("""WITH h AS (SELECT event_type, avg(n) AS mean FROM (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS w, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type),
q AS (SELECT event_type, time_bucket(INTERVAL 15 MINUTE, ts) AS window_start, count(*) AS n FROM events GROUP BY ALL HAVING time_bucket(INTERVAL 15 MINUTE, any_value(ts)) + INTERVAL 15 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events))
SELECT event_type, window_start, n, n > 3 * mean AS spike FROM q JOIN h USING (event_type)""")
def stream_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarter hours as the stream counts them, against the stored hourly means."""
    hours = stats.hourly_means(_events(spark, sf_dir), "event_type", "ts")
    return _streamed(spark, sf_dir, lambda s: pipeline.spiking(pipeline.velocity(s, "event_type", "ts"), hours, "event_type")).select("event_type", "window_start", "n", "spike")


@query("""WITH w AS (SELECT event_type, unnest(generate_series(time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 45 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts), INTERVAL 15 MINUTE)) AS window_start FROM events)
SELECT event_type, window_start, count(*) AS n FROM w GROUP BY ALL HAVING window_start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of hours that begin every quarter hour."""
    return _streamed(spark, sf_dir, lambda s: pipeline.sliding(s, "event_type", "ts"))


@query("""WITH g AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER w + INTERVAL 6 HOUR, true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, session HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user, ended by six quiet hours."""
    return _streamed(spark, sf_dir, lambda s: pipeline.sessions(s, "user_id", "ts", "6 hours"))


@query("""WITH r AS (SELECT CASE event_id % 3 WHEN 0 THEN 'imgur.com' WHEN 1 THEN 'flickr.com' ELSE 'other.example' END AS domain, event_id % 100 AS priority, epoch_us(ts) / 1000000.0::DOUBLE AS seconds FROM events),
l AS (SELECT *, seconds - lag(seconds) OVER (PARTITION BY domain ORDER BY seconds) AS age FROM r)
SELECT domain, seconds, round(priority + CASE domain WHEN 'imgur.com' THEN 200 WHEN 'flickr.com' THEN 160 ELSE 0 END - coalesce(greatest(0.0::DOUBLE, 500.0::DOUBLE - age * 500.0::DOUBLE / 60.0), 0), 4) AS score FROM l""")
def stream_queue_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue scores in a stream: each request cools its domain down."""

    def scored(stream: DataFrame) -> DataFrame:
        e = F.col("event_id")
        rows = stream.select(F.when(e % 3 == 0, "imgur.com").when(e % 3 == 1, "flickr.com").otherwise("other.example").alias("domain"), (e % 100).alias("priority"), crawl.seconds("ts").alias("seconds"))
        return stateful.queue_scores(rows, "domain", "seconds")

    return _streamed(spark, sf_dir, scored).withColumn("score", F.round("score", 4))


_STAGES = f"""i AS (SELECT event_id, user_id, event_type AS platform, CASE WHEN event_id % 11 <> 0 THEN 'https://' || CASE event_id % 3 WHEN 0 THEN 'www.instagram.com' WHEN 1 THEN 'cdn.tiktok.com' ELSE 'site.example' END || '/' || event_id % 4000 END AS media_url, event_id % 7 <> 0 AS has_bytes, CAST((event_id * 7919) % 1000 AS DOUBLE) / 1000 AS score FROM events),
v AS (SELECT *, row_number() OVER (PARTITION BY media_url ORDER BY event_id) AS nth FROM i WHERE media_url IS NOT NULL),
d AS (SELECT *, CASE WHEN contains(media_url, 'instagram') THEN 'instagram' WHEN contains(media_url, 'tiktok') THEN 'tiktok' END AS simulated, CASE WHEN score >= 0.96 THEN 'CRITICAL' WHEN score >= 0.87 THEN 'HIGH' WHEN score >= 0.74 THEN 'MEDIUM' WHEN score >= 0.60 THEN 'LOW' ELSE 'MISS' END AS severity FROM v WHERE nth = 1 AND has_bytes)
SELECT event_id, simulated, severity, severity IN ('HIGH', 'CRITICAL') AS watermark_checked, severity IN ('HIGH', 'CRITICAL') AS alert FROM d WHERE severity <> 'MISS'"""


@query(f"WITH {_STAGES}")
def stream_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the item pipeline over a stream: cache, validation, duplicates, bytes, platform, signature, detection, watermark, alert, storage, results."""
    base = fresh_folder(spark, "stages")
    e = F.col("event_id")
    host = F.when(e % 3 == 0, "www.instagram.com").when(e % 3 == 1, "cdn.tiktok.com").otherwise("site.example")
    events = spark.readStream.schema(_events(spark, sf_dir).schema).option("pathGlobFilter", "*events*.parquet").parquet(sf_dir)
    items = events.select("event_id", F.col("user_id").alias("asset_id"), F.when(e % 11 != 0, F.concat(F.lit("https://"), host, F.lit("/"), (e % 4000).cast("string"))).alias("media_url"), F.when(e % 7 != 0, F.encode(e.cast("string"), "utf-8")).alias("media_bytes"), (((e * 7919) % 1000).cast("double") / 1000).alias("score"))
    return pipeline.crawl_stages(items, base, lambda s: s.withColumn("severity", sev.stored(sev.classify_watch(F.col("score"))))).select("event_id", "simulated", "severity", "watermark_checked", "alert")


@query("""SELECT 'received' AS metric, count(*) AS n FROM events UNION ALL SELECT 'critical', count(*) FILTER (WHERE (event_id * 7919) % 1000 >= 960) FROM events UNION ALL SELECT 'platforms', count(DISTINCT event_type) FROM events""")
def stage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that are taken while items pass, without a second pass."""
    score = ((F.col("event_id") * 7919) % 1000).cast("double") / 1000
    rows = _events(spark, sf_dir).withColumn("severity", sev.classify_watch(score))
    found = pipeline.counted(rows, fresh_folder(spark, "metrics"), received=F.count(F.lit(1)), critical=F.count_if(F.col("severity") == "CRITICAL"), platforms=F.size(F.collect_set("event_type")).cast("long"))
    return spark.createDataFrame(sorted(found.items()), "metric string, n long")
