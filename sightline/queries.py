"""Registered queries over the test tables, each with the same query as DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import views
from .functions import hashing, texts, urls
from .functions import severity as sev
from .functions import similarity as sim
from .operators import crawl, custody, graph, registry, sightings, stats
from .plans import detection
from .streaming import pipeline
from .workspace import fresh_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- shared SQL -------------------------------------------------------------------------------

_LEVEL = "CASE WHEN {s} >= 0.96 THEN 'CRITICAL' WHEN {s} >= 0.87 THEN 'HIGH' WHEN {s} >= 0.74 THEN 'MEDIUM' WHEN {s} >= 0.60 THEN '{watch}' ELSE '{none}' END"
_STORED = _LEVEL.format(s="CAST((event_id * 7919) % 1000 AS DOUBLE) / 1000", watch="LOW", none="MISS")
_SIGHTINGS = f"""sightings AS (SELECT event_id AS sighting_id, user_id AS asset_id, event_type AS platform, ts AS detected_at,
  CAST((event_id * 7919) % 1000 AS DOUBLE) / 1000 AS fusion_score, value, props, {_STORED} AS severity FROM events),
clock AS (SELECT max(ts) AS now FROM events)"""
_ASSETS = """assets AS (SELECT asset_id, asset_id % 5 AS org_id, CASE WHEN asset_id % 2 = 0 THEN 'image' ELSE 'video' END AS asset_type,
  'asset-' || asset_id || '.png' AS original_filename,
  CASE WHEN asset_id % 7 = 3 THEN 'not a window' WHEN asset_id % 3 = 0 THEN '2024-01-' || lpad(CAST(asset_id % 28 + 1 AS VARCHAR), 2, '0') || 'T00:00:00Z / 2024-01-' || lpad(CAST(asset_id % 28 + 1 AS VARCHAR), 2, '0') || 'T23:59:59Z' END AS broadcast_window,
  CASE WHEN asset_id % 4 = 0 THEN '2024-01-' || lpad(CAST(asset_id % 28 + 1 AS VARCHAR), 2, '0') || 'T12:00:00Z' WHEN asset_id % 4 = 1 THEN 'soon' END AS embargo_until,
  list_extract(['IPL 2024', 'nba', 'Premier League', 'Chess', 'UEFA Cup'], CAST(asset_id % 5 + 1 AS INTEGER)) AS league
  FROM (SELECT DISTINCT user_id AS asset_id FROM events))"""
_LAYERS = """clip[1:16] AS spatial, clip[17:32] AS dct, clip[33:48] AS hog, clip[49:57] AS color,
  CAST(list_sum(list_transform(range(0, 32), lambda i: CASE WHEN clip[i + 1] > 0 THEN (1::BIGINT << (31 - i)) ELSE 0 END)) AS BIGINT) AS phash_hi,
  CAST(list_sum(list_transform(range(0, 32), lambda i: CASE WHEN clip[i + 33] > 0 THEN (1::BIGINT << (31 - i)) ELSE 0 END)) AS BIGINT) AS phash_lo"""
_DNA = f"""base AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS clip FROM embeddings),
fingerprints AS (SELECT vec_id AS asset_id, clip, {_LAYERS} FROM base),
mixed AS (SELECT b.vec_id AS query_id, list_transform(range(1, 65), lambda i: (1 - CAST(b.vec_id % 6 AS DOUBLE) / 10) * b.clip[i] + CAST(b.vec_id % 6 AS DOUBLE) / 10 * p.clip[i]) AS clip
  FROM base b JOIN base p ON p.vec_id = (7 * b.vec_id + 3) % (SELECT count(*) FROM base)),
probes AS (SELECT query_id, clip, {_LAYERS}, 300 + query_id * 37 % 300 AS width, 300 + query_id * 53 % 300 AS height FROM mixed)"""


def _cos(a: str, b: str) -> str:
    return f"(list_inner_product({a}, {b}) / ((sqrt(list_inner_product({a}, {a})) + 1e-8) * (sqrt(list_inner_product({b}, {b})) + 1e-8)))"


_TOP = """scored AS (SELECT q.query_id, a.asset_id, list_inner_product(q.clip, a.clip) / (sqrt(list_inner_product(q.clip, q.clip)) * sqrt(list_inner_product(a.clip, a.clip))) AS clip_raw FROM {probes} q CROSS JOIN fingerprints a),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(clip_raw, 9) DESC, asset_id) AS rank FROM scored)"""
_FUSED = f"""pairs AS (SELECT t.query_id, t.asset_id, t.clip_raw, t.rank, q.width, q.height,
  {_cos("q.clip", "a.clip")} AS clip_score, {_cos("q.spatial", "a.spatial")} AS spatial_score, {_cos("q.dct", "a.dct")} AS dct_score, {_cos("q.hog", "a.hog")} AS hog_score, {_cos("q.color", "a.color")} AS color_score,
  1 - (bit_count(xor(q.phash_hi, a.phash_hi)) + bit_count(xor(q.phash_lo, a.phash_lo))) / 64.0::DOUBLE AS phash_score,
  list_inner_product(q.dct, a.dct) AS dct_product,
  {_cos("q.clip[1:9]", "a.color")} AS r0, {_cos("q.clip[17:25]", "a.color")} AS r1, {_cos("q.clip[33:41]", "a.color")} AS r2, {_cos("q.clip[49:57]", "a.color")} AS r3
  FROM kept t JOIN probes q USING (query_id) JOIN fingerprints a USING (asset_id)),
marked AS (SELECT *, clip_raw > 0.85 AND dct_product < 0.3 AS transformed, greatest(r0, r1, r2, r3) AS most, (r0 + r1 + r2 + r3) / 4 AS mean FROM pairs),
summed AS (SELECT *, (0.40 + CASE WHEN transformed THEN 0.15 ELSE 0 END)::DOUBLE * clip_score + 0.15::DOUBLE * phash_score + 0.10::DOUBLE * color_score + 0.05::DOUBLE * hog_score + 0.15::DOUBLE * dct_score
  + (0.15 + CASE WHEN transformed THEN 0.05 ELSE 0 END)::DOUBLE * spatial_score AS global_score FROM marked),
lifted AS (SELECT *, CASE WHEN most > 0.92 AND global_score > 0.65 THEN greatest(global_score, 0.82) WHEN mean > 0.75 AND global_score > 0.60 THEN greatest(global_score, 0.76) ELSE global_score END AS fusion_score,
  0.96::DOUBLE - CASE WHEN width * height < 160000 THEN 0.02::DOUBLE ELSE 0 END - CASE WHEN transformed THEN 0.01::DOUBLE ELSE 0 END AS critical,
  0.87::DOUBLE - CASE WHEN width * height < 160000 THEN 0.03::DOUBLE ELSE 0 END - CASE WHEN transformed THEN 0.02::DOUBLE ELSE 0 END AS high,
  0.74::DOUBLE - CASE WHEN width * height < 160000 THEN 0.05::DOUBLE ELSE 0 END AS medium FROM summed),
graded AS (SELECT *, CASE WHEN fusion_score >= critical THEN 'CRITICAL' WHEN fusion_score >= high THEN 'HIGH' WHEN fusion_score >= medium THEN 'MEDIUM' ELSE 'MISS' END AS severity FROM lifted),
fused AS (SELECT *, CASE WHEN severity <> 'MISS' THEN severity WHEN fusion_score > 0.60 THEN 'RE_EVAL_NEEDED' END AS status, clip_score > 0.90 AND phash_score < 0.50 AS is_ai_clone FROM graded)"""
_DETECT, _DETECT_WIDE = (f"WITH {_DNA}, {_TOP.format(probes='probes')}, kept AS (SELECT * FROM top WHERE rank <= {k}), {_FUSED}" for k in (50, 250))


# ---- sightings --------------------------------------------------------------------------------


@query(f"""WITH {_SIGHTINGS}, {_ASSETS} SELECT sighting_id, asset_id, platform, detected_at, fusion_score, severity, original_filename FROM sightings JOIN assets USING (asset_id), clock
WHERE org_id = 2 AND detected_at >= now - INTERVAL 240 HOUR AND severity IN ('MEDIUM', 'HIGH', 'CRITICAL') ORDER BY detected_at DESC, sighting_id LIMIT 500""")
def recent_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sightings.recent(views.sightings(spark, sf_dir), views.assets(spark, sf_dir), views.as_of(spark, sf_dir), org_id=2, hours=240)
    return rows.select("sighting_id", "asset_id", "platform", "detected_at", "fusion_score", "severity", "original_filename")


@query(f"WITH {_SIGHTINGS} SELECT severity, count(*) AS n, round(avg(fusion_score), 6) AS mean_score FROM sightings GROUP BY severity")
def severity_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.sightings(spark, sf_dir).groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("fusion_score"), 6).alias("mean_score"))


@query(f"WITH {_SIGHTINGS} SELECT DISTINCT asset_id FROM sightings, clock WHERE severity IN ('HIGH', 'CRITICAL') AND detected_at >= now - INTERVAL 168 HOUR")
def rescan_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sightings.assets_to_rescan(views.sightings(spark, sf_dir), views.as_of(spark, sf_dir))


@query(f"""WITH {_SIGHTINGS}, {_ASSETS} SELECT asset_id, broadcast_window FROM assets, (SELECT TIMESTAMP '2024-01-10 12:00:00' AS now)
WHERE broadcast_window LIKE '%/%' AND try_cast(rtrim(trim(split_part(broadcast_window, '/', 1)), 'Z') AS TIMESTAMP) <= now AND now <= try_cast(rtrim(trim(split_part(broadcast_window, '/', 2)), 'Z') AS TIMESTAMP)
ORDER BY broadcast_window, asset_id LIMIT 100""")
def broadcast_windows_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sightings.active_windows(views.assets(spark, sf_dir), "2024-01-10 12:00:00").select("asset_id", "broadcast_window")


@query(f"""WITH {_SIGHTINGS}, {_ASSETS}, held AS (SELECT sighting_id, severity, coalesce(TIMESTAMP '2024-01-15 00:00:00' < try_cast(rtrim(embargo_until, 'Z') AS TIMESTAMP), false) AS active FROM sightings JOIN assets USING (asset_id)),
up AS (SELECT sighting_id, severity AS old, CASE WHEN active AND severity <> 'MISS' THEN CASE severity WHEN 'LOW' THEN 'MEDIUM' WHEN 'MEDIUM' THEN 'HIGH' ELSE 'CRITICAL' END ELSE severity END AS severity FROM held)
SELECT sighting_id, severity, severity <> old AS embargo_violation FROM up""")
def embargo_upgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.sightings(spark, sf_dir).join(views.assets(spark, sf_dir), "asset_id")
    active = sev.within_embargo(F.lit("2024-01-15 00:00:00").cast("timestamp"), F.col("embargo_until"))
    new, changed = sev.embargo_severity(F.col("severity"), active)
    return rows.select("sighting_id", new.alias("severity"), changed.alias("embargo_violation"))


@query(f"WITH {_SIGHTINGS} SELECT sighting_id, asset_id, fusion_score, severity FROM sightings WHERE severity IN ('HIGH', 'CRITICAL') ORDER BY fusion_score DESC, sighting_id LIMIT 30")
def alert_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sightings.alerts(views.sightings(spark, sf_dir)).select("sighting_id", "asset_id", "fusion_score", "severity")


@query(f"WITH {_SIGHTINGS} SELECT platform, count(*) AS n, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical FROM sightings GROUP BY platform")
def alert_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.sightings(spark, sf_dir).groupBy("platform").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"))


@query(f"WITH {_SIGHTINGS} SELECT asset_id, sighting_id, fusion_score FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY fusion_score DESC, sighting_id) AS n FROM sightings) WHERE n = 1")
def best_sighting_per_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sightings.best_per(views.sightings(spark, sf_dir).select("asset_id", "sighting_id", "fusion_score"), ["asset_id"])


@query("""SELECT user_id AS session_id, arg_max(event_id, event_id) AS session_data FROM events GROUP BY user_id""")
def upsert_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("session_data"), F.col("event_id").alias("updated_at"))
    return sightings.upsert(rows.where("updated_at % 2 = 0"), rows.where("updated_at % 2 = 1"), "session_id", "updated_at").select("session_id", "session_data")


@query(f"""WITH {_SIGHTINGS} SELECT sighting_id, severity = 'CRITICAL' AS dmca_generated, CASE WHEN severity = 'CRITICAL' THEN 'evidence/' || sighting_id || '.md' END AS evidence_path FROM sightings""")
def mark_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.sightings(spark, sf_dir).select("sighting_id", "severity").withColumn("dmca_generated", F.lit(False))
    path = F.concat(F.lit("evidence/"), F.col("sighting_id").cast("string"), F.lit(".md"))
    return sightings.marked(rows, "sighting_id", rows.where("severity = 'CRITICAL'").select("sighting_id"), dmca_generated=F.lit(True), evidence_path=path).drop("severity")


@query(f"WITH {_SIGHTINGS} SELECT platform, severity, count(*) AS n FROM sightings WHERE severity <> 'MISS' AND asset_id IS NOT NULL GROUP BY platform, severity")
def storable_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sightings.storable(views.sightings(spark, sf_dir)).groupBy("platform", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_SIGHTINGS} SELECT sighting_id, '# Evidence' || chr(10) || 'Report: ' || sighting_id || chr(10) || 'Score: ' || printf('%.2f%%', fusion_score * 100) AS report FROM sightings WHERE severity = 'CRITICAL'""")
def evidence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.sightings(spark, sf_dir).where("severity = 'CRITICAL'")
    return rows.select("sighting_id", F.concat_ws("\n", F.lit("# Evidence"), F.format_string("Report: %d", "sighting_id"), F.concat(F.lit("Score: "), texts.percent(F.col("fusion_score")))).alias("report"))


@query(f"""WITH {_ASSETS} SELECT asset_id, CASE WHEN lower(league) LIKE '%ipl%' THEN 'ipl,iplt20,cricket' WHEN lower(league) LIKE '%nba%' THEN 'nba,basketball,nbahighlights' WHEN lower(league) LIKE '%nfl%' THEN 'nfl,football,nflhighlights'
WHEN lower(league) LIKE '%fifa%' THEN 'fifa,football,fifaworldcup' WHEN lower(league) LIKE '%premier league%' THEN 'premierleague,epl,football' WHEN lower(league) LIKE '%uefa%' THEN 'uefaliga,championsleague,football' ELSE 'sportshighlights' END AS tags FROM assets""")
def league_hashtags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.assets(spark, sf_dir).select("asset_id", F.array_join(texts.hashtags(F.col("league")), ",").alias("tags"))



# ---- graphs -----------------------------------------------------------------------------------


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest over events: a node's parent is half its id, if that is a node of the same asset group."""
    rows = views.table(spark, sf_dir, "events").select(F.col("event_id").alias("node_id"), (F.col("event_id") % 3).alias("tree"), F.col("event_type").alias("platform"), F.col("value"), "ts", F.col("user_id").alias("asset_id"))
    parent = F.floor((F.col("node_id") - 3) / 6) * 3 + F.col("node_id") % 3
    return rows.withColumn("parent_id", F.when(F.col("node_id") >= 3, parent))


@query("""WITH RECURSIVE nodes AS (SELECT event_id AS node_id, CASE WHEN event_id >= 3 THEN CAST(floor((event_id - 3) / 6.0) * 3 + event_id % 3 AS BIGINT) END AS parent_id FROM events),
walk AS (SELECT node_id, 0 AS depth FROM nodes WHERE parent_id IS NULL UNION ALL SELECT n.node_id, w.depth + 1 FROM nodes n JOIN walk w ON n.parent_id = w.node_id)
SELECT node_id, depth FROM walk""")
def spread_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.depths(_nodes(spark, sf_dir))


@query("SELECT user_id AS asset_id, count(*) AS incidents, round(sum(value), 3) AS reach, count(DISTINCT event_type) AS platforms FROM events GROUP BY user_id")
def spread_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.spread_stats(_nodes(spark, sf_dir), "asset_id", "value", "platform").withColumn("reach", F.round("reach", 3))


@query("SELECT user_id AS asset_id, event_type AS platform, count(*) AS n FROM events GROUP BY ALL")
def platform_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.platform_counts(views.sightings(spark, sf_dir))


@query("SELECT event_id AS node_id, CASE WHEN event_id <> first_value(event_id) OVER w THEN first_value(event_id) OVER w ELSE -1 END AS parent_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def default_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.default_parents(_nodes(spark, sf_dir).drop("parent_id"), "asset_id", "node_id", ["ts", "node_id"]).select("node_id", F.coalesce("parent_id", F.lit(-1)).alias("parent_id"))


@query(f"WITH {_SIGHTINGS} SELECT sighting_id, asset_id FROM sightings WHERE fusion_score >= 0.87")
def derived_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.derived_edges(views.sightings(spark, sf_dir), "fusion_score").select("sighting_id", "asset_id")



# ---- rates ------------------------------------------------------------------------------------


@query("""WITH q AS (SELECT event_type AS platform, time_bucket(INTERVAL 15 MINUTE, ts) AS window_start, count(*) AS n FROM events GROUP BY ALL),
h AS (SELECT platform, avg(n) AS hourly_mean FROM (SELECT event_type AS platform, time_bucket(INTERVAL 1 HOUR, ts) AS w, count(*) AS n FROM events GROUP BY ALL) GROUP BY platform)
SELECT platform, window_start, n, n > 3 * hourly_mean AS spike FROM q JOIN h USING (platform)""")
def upload_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.velocity_spikes(views.sightings(spark, sf_dir), "platform", "detected_at").drop("hourly_mean")


@query("SELECT user_id % 5 AS org_id, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n, count(*) > 5 AS limited FROM events GROUP BY ALL")
def rate_limit_fixed_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "events").withColumn("org_id", F.col("user_id") % 5)
    return crawl.fixed_window_limit(rows, "org_id", "ts", 5)


_BUCKET = """WITH RECURSIVE r AS (SELECT user_id, event_id, epoch_us(ts) / 1000000.0::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
b AS (SELECT user_id, event_id, n, t, 1.0::DOUBLE AS held FROM r WHERE n = 1
UNION ALL SELECT r.user_id, r.event_id, r.n, r.t, least(1.0::DOUBLE, b.held - CASE WHEN b.held >= 1 THEN 1 ELSE 0 END + (r.t - b.t) * 0.0005::DOUBLE) FROM b JOIN r ON r.user_id = b.user_id AND r.n = b.n + 1)"""


@query(f"{_BUCKET} SELECT event_id, held >= 1 AS passed FROM b")
def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return crawl.token_bucket(rows, "user_id", "ts", "event_id", 0.0005).select("event_id", "passed")



@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n % 6 = 0")
def rate_watch_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.alarms(views.table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id")


@query("""WITH r AS (SELECT event_id, event_id % 8 AS shard, floor(value) AS k FROM events), p AS (SELECT shard, k, event_id, lag(event_id) OVER (PARTITION BY shard, k ORDER BY event_id) AS before FROM r),
n AS (SELECT p.event_id, count(DISTINCT r.k) AS others FROM p JOIN r ON r.shard = p.shard AND r.event_id > p.before AND r.event_id < p.event_id GROUP BY p.event_id)
SELECT p.event_id, p.before IS NOT NULL AND coalesce(n.others, 0) < 20 AS hit FROM p LEFT JOIN n USING (event_id)""")
def lru_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 8).alias("shard"), F.floor("value").alias("k"))
    return crawl.lru_hits(rows, "k", "event_id", 20).select("event_id", "hit")


# ---- vectors ----------------------------------------------------------------------------------


@query(f"WITH {_DNA}, {_TOP.format(probes='probes')} SELECT query_id, asset_id, round(clip_raw, 6) AS score, CAST(rank AS INTEGER) AS rank FROM top WHERE rank <= 10")
def topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection.top_k(views.probes(spark, sf_dir), views.fingerprints(spark, sf_dir), 10).select("query_id", "asset_id", F.round("clip_raw", 6).alias("score"), "rank")


@query(f"""WITH {_DNA} SELECT q.query_id, a.asset_id, CAST(bit_count(xor(q.phash_hi, a.phash_hi)) + bit_count(xor(q.phash_lo, a.phash_lo)) AS INTEGER) AS distance FROM probes q, fingerprints a
WHERE bit_count(xor(q.phash_hi, a.phash_hi)) + bit_count(xor(q.phash_lo, a.phash_lo)) <= 7""")
def phash_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection.hash_neighbours(views.probes(spark, sf_dir), views.fingerprints(spark, sf_dir), 7)


@query(f"{_DETECT} SELECT query_id, asset_id, round(fusion_score, 5) AS fusion_score, round(clip_score, 5) AS clip_score, round(phash_score, 5) AS phash_score, status, is_ai_clone FROM fused WHERE status IS NOT NULL")
def fusion_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detection.detect(views.probes(spark, sf_dir), views.fingerprints(spark, sf_dir))
    return rows.select("query_id", "asset_id", *[F.round(c, 5).alias(c) for c in ("fusion_score", "clip_score", "phash_score")], "status", "is_ai_clone")


@query(f"{_DETECT} SELECT query_id, asset_id, status FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fusion_score, 9) DESC, asset_id) AS n FROM fused WHERE status IS NOT NULL) WHERE n = 1")
def best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detection.detect(views.probes(spark, sf_dir), views.fingerprints(spark, sf_dir)).select("query_id", "asset_id", F.round("fusion_score", 9).alias("fusion_score"), "status")
    return sightings.best_per(rows, ["query_id"]).drop("fusion_score")


@query(f"{_DETECT} SELECT query_id, asset_id, round(most, 5) AS most, round(mean, 5) AS mean, round(fusion_score - global_score, 5) AS lift FROM fused")
def regional_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes, assets = views.probes(spark, sf_dir), views.fingerprints(spark, sf_dir)
    rows = detection.fused(probes, assets, 50)
    mean = sim.total(F.col("region_scores")) / F.size("region_scores")
    return rows.select("query_id", "asset_id", F.round(F.array_max("region_scores"), 5).alias("most"), F.round(mean, 5).alias("mean"), F.round(F.col("fusion_score") - F.col("global_score"), 5).alias("lift"))


@query(f"WITH {_DNA} SELECT query_id, round(0.96 - CASE WHEN width * height < 160000 THEN 0.02 ELSE 0 END, 6)::DOUBLE AS critical, round(0.87 - CASE WHEN width * height < 160000 THEN 0.03 ELSE 0 END, 6)::DOUBLE AS high, round(0.74 - CASE WHEN width * height < 160000 THEN 0.05 ELSE 0 END, 6)::DOUBLE AS medium FROM probes")
def dynamic_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = sev.thresholds(F.col("width"), F.col("height"), F.lit(False))
    return views.probes(spark, sf_dir).select("query_id", *[F.round(x, 6).alias(n) for x, n in zip(levels, ("critical", "high", "medium"))])


@query(f"""{_DETECT_WIDE}, band AS (SELECT DISTINCT query_id FROM fused WHERE status = 'RE_EVAL_NEEDED' AND rank <= 50),
again AS (SELECT f.query_id, max(f.fusion_score) AS best FROM fused f JOIN band USING (query_id) WHERE f.status IS NOT NULL GROUP BY f.query_id) SELECT query_id, best > 0.74 AS recovered FROM again""")
def rescan_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection.re_evaluated(views.probes(spark, sf_dir), views.fingerprints(spark, sf_dir)).select("query_id", "recovered")


@query(f"""WITH {_SIGHTINGS}, {_DNA}, due AS (SELECT DISTINCT asset_id FROM sightings, clock WHERE severity IN ('HIGH', 'CRITICAL') AND detected_at >= now - INTERVAL 168 HOUR),
{_TOP.format(probes='(SELECT p.* FROM probes p JOIN due d ON d.asset_id = p.query_id)')} SELECT query_id, count(*) AS candidates_found FROM top WHERE rank <= 250 GROUP BY query_id""")
def deep_rescan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    due = rescan_assets(spark, sf_dir).withColumnRenamed("asset_id", "query_id")
    probes = views.probes(spark, sf_dir).join(due, "query_id")
    return detection.top_k(probes, views.fingerprints(spark, sf_dir), 250).groupBy("query_id").agg(F.count(F.lit(1)).alias("candidates_found"))


@query(f"""WITH {_DNA}, {_TOP.format(probes='probes')}, plain AS (SELECT t.query_id, t.asset_id, 0.40::DOUBLE * list_inner_product(q.clip, a.clip) + 0.15::DOUBLE * (1 - (bit_count(xor(q.phash_hi, a.phash_hi)) + bit_count(xor(q.phash_lo, a.phash_lo))) / 64.0::DOUBLE)
+ 0.10::DOUBLE * list_inner_product(q.color, a.color) + 0.05::DOUBLE * list_inner_product(q.hog, a.hog) + 0.15::DOUBLE * list_inner_product(q.dct, a.dct) + 0.15::DOUBLE * list_inner_product(q.spatial, a.spatial) AS s
FROM top t JOIN probes q USING (query_id) JOIN fingerprints a USING (asset_id) WHERE t.rank <= 20)
SELECT query_id, asset_id, round(s, 5) AS fusion_score, {_LEVEL.format(s='s', watch='WATCH', none='NONE')} AS severity FROM plain WHERE s >= 0.60""")
def candidate_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes, assets = views.probes(spark, sf_dir), views.fingerprints(spark, sf_dir)
    return detection.candidate_alerts(detection.top_k(probes, assets, 20).select("query_id", "asset_id"), probes, assets).withColumn("fusion_score", F.round("fusion_score", 5))


@query("SELECT count(*) AS assets, CAST(max(len(embedding)) AS INTEGER) AS dimensions FROM embeddings")
def index_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection.index_statistics(views.fingerprints(spark, sf_dir))


# ---- crawl ------------------------------------------------------------------------------------

_REQUESTS = """requests AS (SELECT page_id AS seq, url, split_part(url, '/', 3) AS host, list_aggregate(string_split(split_part(split_part(split_part(url, '//', 2), '/', 1), '?', 1), '.')[-2:], 'string_agg', '.') AS domain,
page_id * 13 % 1000 AS priority, page_id * 7 % 90 AS age FROM pages)"""


@query(f"WITH {_REQUESTS} SELECT seq, host, domain, CASE WHEN host LIKE '%streameast.live%' THEN 'CRITICAL_PIRACY' WHEN domain = 'example.org' THEN 'LICENSED' ELSE 'UNKNOWN' END AS class FROM requests")
def domain_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.requests(spark, sf_dir).select("seq", "host", "domain", urls.domain_class(F.col("host"), F.col("domain") == "example.org").alias("class"))


@query(f"""WITH {_REQUESTS} SELECT seq, host, CASE WHEN host = 'blog.example.com' OR host LIKE '%.blog.example.com' THEN 'blog.example.com' WHEN host LIKE '%.example.com' THEN 'example.com' WHEN host LIKE '%.org' THEN 'org' END AS policy,
NOT (host LIKE '%.org') AS allowed, CASE WHEN host LIKE '%.example.com' THEN 5.0 WHEN host LIKE '%.org' THEN 0.0 ELSE 2.0 END::DOUBLE AS rps FROM requests""")
def trie_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = crawl.policies(spark, (("example.com", True, 5.0), ("org", False, 0.0), ("blog.example.com", True, 5.0)))
    return crawl.with_policy(views.requests(spark, sf_dir).select("seq", "host"), "host", table)


@query(f"WITH {_REQUESTS} SELECT domain, count(*) AS n FROM requests WHERE domain NOT LIKE '%.org' GROUP BY domain")
def domain_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = crawl.policies(spark, (*urls.POLICIES, ("org", False, 0.0)))
    return crawl.admitted(views.requests(spark, sf_dir), "domain", table).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


_RING = """points AS (SELECT node, ('0x' || substr(md5(node || ':vn' || v), 1, 8))::BIGINT AS position FROM (SELECT unnest(['worker-1', 'worker-2', 'worker-3', 'worker-4']) AS node) CROSS JOIN (SELECT unnest(range(0, 150)) AS v))"""


@query(f"""WITH {_REQUESTS}, {_RING}, keys AS (SELECT DISTINCT host, ('0x' || substr(md5(host), 1, 8))::BIGINT AS position FROM requests)
SELECT k.host, coalesce((SELECT arg_min(node, p.position) FROM points p WHERE p.position >= k.position), (SELECT arg_min(node, position) FROM points)) AS node FROM keys k""")
def ring_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = views.requests(spark, sf_dir).select("host").distinct()
    return crawl.routed(hosts, "host", crawl.ring(spark, [f"worker-{i}" for i in range(1, 5)]))


@query(f"WITH {_RING} SELECT node, count(*) AS points FROM points GROUP BY node")
def ring_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.ring(spark, [f"worker-{i}" for i in range(1, 5)]).groupBy("node").agg(F.count(F.lit(1)).alias("points"))


@query(f"""WITH {_REQUESTS}, {_RING}, keys AS (SELECT DISTINCT host, ('0x' || substr(md5(host), 1, 8))::BIGINT AS position FROM requests),
a AS (SELECT host, coalesce((SELECT arg_min(node, p.position) FROM points p WHERE p.position >= k.position), (SELECT arg_min(node, position) FROM points)) AS node FROM keys k)
SELECT host FROM a WHERE node = 'worker-4'""")
def ring_remapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts that move when a node leaves: exactly those that it had."""
    hosts = views.requests(spark, sf_dir).select("host").distinct()
    before = crawl.routed(hosts, "host", crawl.ring(spark, [f"worker-{i}" for i in range(1, 5)]))
    after = crawl.routed(hosts, "host", crawl.ring(spark, [f"worker-{i}" for i in range(1, 4)])).withColumnRenamed("node", "new")
    return before.join(after, "host").where("node <> new").select("host")


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def dedup_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    return crawl.first_seen(rows, F.col("key"), ["doc_id"]).select("doc_id")


@query("SELECT page_id, sha256('GET' || url) AS fingerprint FROM pages")
def request_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "pages").select("page_id", hashing.request_fingerprint(F.lit("GET"), F.col("url"), F.lit(None).cast("string")).alias("fingerprint"))


@query("""WITH h AS (SELECT ('0x' || substr(sha256(url), 1, 16))::UBIGINT::HUGEINT AS a, (('0x' || substr(md5(url), 1, 16))::UBIGINT | 1::UBIGINT)::HUGEINT AS b FROM pages),
p AS (SELECT DISTINCT (a + i * b) % 1437759 AS position FROM h, unnest(range(0, 10)) AS t(i)) SELECT count(*) AS set_bits, count(*) / 1437759.0::DOUBLE AS fill FROM p""")
def bloom_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set bits and fill ratio of the filter over all urls."""
    bits, hashes = hashing.bloom_size(100_000, 0.001)
    rows = views.table(spark, sf_dir, "pages").select(F.explode(hashing.bloom_positions(bits, hashes)(F.col("url"))).alias("p")).distinct()
    return rows.agg(F.count(F.lit(1)).alias("set_bits"), (F.count(F.lit(1)) / bits).alias("fill"))


@query(f"""WITH {_REQUESTS} SELECT seq, round(priority - greatest(0.0, 500.0 - age * (500.0 / 60.0)), 6)::DOUBLE AS score FROM requests""")
def priority_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.queue_order(views.requests(spark, sf_dir)).orderBy(F.desc("score"), "seq").select("seq", F.round("score", 6).alias("score"))



@query(f"WITH {_REQUESTS} SELECT seq, url LIKE 'http%' AND NOT regexp_matches(lower(url), '1x1|pixel|tracking') AS media, contains(host, 'example.com') AS permitted FROM requests")
def media_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.requests(spark, sf_dir).select("seq", urls.is_media(F.col("url")).alias("media"), urls.permitted(F.col("host"), ["example.com"]).alias("permitted"))


@query("SELECT CASE WHEN event_id % 5 = 0 THEN 'pass' WHEN event_id % 3 = 0 AND event_type = 'view' THEN 'video' WHEN event_id % 3 = 0 THEN 'drop' ELSE 'fingerprint' END AS route, count(*) AS n FROM events GROUP BY 1")
def dispatch_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    kind = F.when(F.col("event_type") == "view", "video").otherwise("image")
    return views.table(spark, sf_dir, "events").select(crawl.dispatch(e % 5 == 0, e % 3 != 0, kind, F.lit(True)).alias("route")).groupBy("route").agg(F.count(F.lit(1)).alias("n"))


# ---- statistics -------------------------------------------------------------------------------


@query("""SELECT event_type AS channel, round(avg(value), 5) AS mean, round(stddev_pop(value), 5) AS std, round(coalesce((avg(value * value * value) - 3 * avg(value) * avg(value * value) + 2 * avg(value) ** 3) / nullif(stddev_pop(value) ** 3, 0), 0), 4) AS skew FROM events GROUP BY event_type""")
def color_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.moments(views.table(spark, sf_dir, "events").withColumnRenamed("event_type", "channel"), ["channel"], "value")
    return rows.select("channel", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"), F.round("skew", 4).alias("skew"))


@query("""WITH b AS (SELECT event_type AS video, CAST(least(floor(value / (10.0::DOUBLE / 128)), 127) AS INTEGER) AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 10 GROUP BY ALL)
SELECT video, bin, n, round(n / sqrt(sum(n * n) OVER (PARTITION BY video)), 6) AS share FROM b""")
def motion_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "events").withColumnRenamed("event_type", "video")
    return stats.histogram(rows, ["video"], "value", 0.0, 10.0, 128).withColumn("share", F.round("share", 6))


@query("""WITH p AS (SELECT event_type AS image, (event_id * 31 % 256) // 2 AS pair, count(*) FILTER (WHERE (event_id * 31 % 256) % 2 = 0) AS e, count(*) FILTER (WHERE (event_id * 31 % 256) % 2 = 1) AS o FROM events GROUP BY ALL)
SELECT image, round(sum(((e - (e + o) / 2.0) ** 2 + (o - (e + o) / 2.0) ** 2) / ((e + o) / 2.0)), 5)::DOUBLE AS chi2, count(*) * 2 - 1 AS free FROM p WHERE (e + o) / 2.0 > 5 GROUP BY image""")
def steganalysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "events").select(F.col("event_type").alias("image"), (F.col("event_id") * 31 % 256).alias("pixel"))
    return stats.pair_chi_square(rows, ["image"], "pixel").withColumn("chi2", F.round("chi2", 5))


@query("SELECT user_id % 4 AS image, event_id % 144 AS bit, CAST(sum(CASE WHEN value > 5 THEN 1 ELSE -1 END) > 0 AS INTEGER) AS value FROM events GROUP BY ALL")
def majority_vote_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("image"), "event_id", F.col("value").alias("v"))
    return stats.majority_bits(rows, ["image"], "event_id", F.when(F.col("v") > 5, 1).otherwise(-1))


@query("""WITH f AS (SELECT event_id % 4 AS video, event_id // 4 AS frame, value - 5 AS x, max(event_id // 4) OVER (PARTITION BY event_id % 4) + 1 AS n FROM events)
SELECT video, frame // 15 AS symbol, CAST(avg(x) > 0 AS INTEGER) AS bit FROM f WHERE (frame // 15) * 15 < n - 15 GROUP BY ALL""")
def symbol_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "events").select((F.col("event_id") % 4).alias("video"), F.floor(F.col("event_id") / 4).alias("frame"), (F.col("value") - 5).alias("x"))
    return stats.symbol_bits(rows, "video", "frame", "x")


@query("""WITH f AS (SELECT event_id % 8 AS video, event_id // 8 AS frame, abs(value - lag(value) OVER (PARTITION BY event_id % 8 ORDER BY event_id)) AS change FROM events) SELECT video, frame FROM f WHERE change > 30""")
def scene_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "events").select((F.col("event_id") % 8).alias("video"), F.floor(F.col("event_id") / 8).alias("frame"), "value")
    return stats.scene_cuts(rows, "video", "frame", "value").select("video", "frame")



@query("""WITH o AS (SELECT event_id AS sighting_id, event_id % 10 AS asset_id, list_transform(range(0, 16), lambda i: (event_id * 7 + i * i) % 2) AS bits FROM events),
s AS (SELECT c_custkey AS subscriber_id, c_custkey % 10 AS asset_id, list_transform(range(0, 16), lambda i: (c_custkey + i * (c_custkey % 3)) % 2) AS bits FROM customer),
m AS (SELECT sighting_id, subscriber_id, list_sum(list_transform(range(1, 17), lambda i: CASE WHEN o.bits[i] = s.bits[i] THEN 1 ELSE 0 END)) AS matched FROM o JOIN s USING (asset_id))
SELECT sighting_id, subscriber_id, CAST(matched AS INTEGER) AS matched FROM (SELECT *, row_number() OVER (PARTITION BY sighting_id ORDER BY matched DESC, subscriber_id) AS n FROM m) WHERE n = 1""")
def leaker_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = F.sequence(F.lit(0), F.lit(15))
    e, c = F.col("event_id"), F.col("c_custkey")
    observed = views.table(spark, sf_dir, "events").select(e.alias("sighting_id"), (e % 10).alias("asset_id"), F.transform(steps, lambda i: (e * 7 + i * i) % 2).alias("bits"))
    assigned = views.table(spark, sf_dir, "customer").select(c.alias("subscriber_id"), (c % 10).alias("asset_id"), F.transform(steps, lambda i: (c + i * (c % 3)) % 2).alias("bit_sequence"))
    return stats.leakers(observed, assigned).select("sighting_id", "subscriber_id", "matched")


# ---- custody ----------------------------------------------------------------------------------



@query("SELECT user_id AS asset_id, sha256(user_id || '|' || sha256(props) || '|' || sha256('owner' || user_id || 'salt')) AS commitment FROM events")
def ownership_commitment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "events")
    asset = F.col("user_id").cast("string")
    return rows.select(F.col("user_id").alias("asset_id"), hashing.commitment(asset, F.col("props"), F.concat(F.lit("owner"), asset), "salt").alias("commitment"))



@query("""SELECT user_id, CASE min(event_id % 7) WHEN 0 THEN 'CONTAINER_MATCH' WHEN 1 THEN 'CRYPTOGRAPHIC_LAYER_MATCH' WHEN 2 THEN 'TEMPORAL_WATERMARK_MATCH' WHEN 3 THEN 'AUDIO_WATERMARK_MATCH' WHEN 4 THEN 'STREAM_FINGERPRINT_MATCH' WHEN 5 THEN 'FORENSIC_VISUAL_MATCH' ELSE 'DORK_DOMAIN_HIT' END AS proof_type FROM events GROUP BY user_id""")
def strongest_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(p) for p in sev.PROOFS])
    rows = views.table(spark, sf_dir, "events").select("user_id", F.get(names, (F.col("event_id") % 7).cast("int")).alias("proof_type"))
    return custody.strongest_proof(rows, "user_id")


# ---- media ------------------------------------------------------------------------------------







@query("""SELECT event_type, time_bucket(INTERVAL 15 MINUTE, ts) AS window_start, count(*) AS n FROM events GROUP BY ALL
HAVING time_bucket(INTERVAL 15 MINUTE, any_value(ts)) + INTERVAL 15 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, lambda s: pipeline.velocity(s, "event_type", "ts"))


@query(f"{_BUCKET} SELECT user_id, t AS seconds, held >= 1 AS passed FROM b")
def stream_token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .streaming import stateful

    return _streamed(spark, sf_dir, lambda s: stateful.token_bucket(s.select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("seconds")), "user_id", "seconds", 0.0005))


def _streamed(spark: SparkSession, sf_dir: str, query) -> DataFrame:
    """Run a query over the events file as a stream until all is read; what it wrote."""
    base = fresh_folder(spark, "stream")
    schema = views.table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*events*.parquet").parquet(sf_dir)
    pipeline.run_once(query(stream), f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out")


# ---- registry ---------------------------------------------------------------------------------






@query(f"WITH {_SIGHTINGS} SELECT time_bucket(INTERVAL 1 DAY, detected_at) AS day, count(*) AS n, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical FROM sightings GROUP BY 1")
def sighting_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.timeline(views.sightings(spark, sf_dir), "detected_at")



@query(f"WITH {_DNA} SELECT q.query_id, a.asset_id FROM probes q JOIN fingerprints a ON q.phash_hi = a.phash_hi AND q.phash_lo = a.phash_lo")
def hash_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes, assets = views.probes(spark, sf_dir).select("query_id", "phash_hi", "phash_lo"), views.fingerprints(spark, sf_dir).select("asset_id", "phash_hi", "phash_lo")
    return probes.join(assets, ["phash_hi", "phash_lo"]).select("query_id", "asset_id")


@query("SELECT user_id % 10 AS band, round(avg(value), 5) AS mean, round(stddev_pop(value), 5) AS std FROM events GROUP BY 1")
def band_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.moments(views.table(spark, sf_dir, "events").withColumn("band", F.col("user_id") % 10), ["band"], "value")
    return rows.select("band", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"))


@query(f"WITH {_SIGHTINGS} SELECT sighting_id, asset_id, severity FROM sightings WHERE severity <> 'MISS'")
def stream_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crawl stream from arrival to storage: classified, filtered and stored batch by batch."""
    base = fresh_folder(spark, "stored")
    events = spark.readStream.schema(views.table(spark, sf_dir, "events").schema).option("pathGlobFilter", "*events*.parquet").parquet(sf_dir)
    scored = events.select(F.col("event_id").alias("sighting_id"), F.col("user_id").alias("asset_id"), (((F.col("event_id") * 7919) % 1000).cast("double") / 1000).alias("fusion_score"))
    found = pipeline.staged(scored, lambda s: pipeline.deduplicated_for_ever(s, "sighting_id"), lambda s: pipeline.classified(s, "fusion_score"))
    pipeline.stored(found, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("sighting_id", "asset_id", "severity")


from . import queries_media, queries_store  # noqa: E402, F401  they register their own
