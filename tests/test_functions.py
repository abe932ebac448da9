"""Boundaries of the scalar rules, and the pure functions of media."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline import schemas
from sightline.functions import container, hashing, imaging, sequences, signals, texts, urls
from sightline.functions import severity as sev
from sightline.functions import similarity as sim
from sightline.operators import crawl, custody, sightings


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).head())


def test_thresholds_are_inclusive(spark):
    got = one(spark, *[sev.classify_watch(F.lit(x)) for x in (0.96, 0.87, 0.74, 0.60, 0.5999)])
    assert got == ("CRITICAL", "HIGH", "MEDIUM", "WATCH", "NONE")
    assert one(spark, *[sev.stored(F.lit(x)) for x in ("WATCH", "NONE", "HIGH")]) == ("LOW", "MISS", "HIGH")


def test_ranks_and_upgrades(spark):
    assert one(spark, sev.rank(F.lit("HIGH")), sev.rank(F.lit("odd"))) == (3, 2)
    assert one(spark, *[sev.upgrade(F.lit(x)) for x in ("LOW", "CRITICAL", "odd")]) == ("MEDIUM", "CRITICAL", "odd")
    new, changed = sev.embargo_severity(F.lit("CRITICAL"), F.lit(True))
    assert one(spark, new, changed) == ("CRITICAL", False)
    new, changed = sev.embargo_severity(F.lit("MISS"), F.lit(True))
    assert one(spark, new, changed) == ("MISS", False)


def test_embargo_edges(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    assert one(spark, *[sev.within_embargo(now, F.lit(x)) for x in ("2024-01-01T00:00:00Z", "2024-01-01T00:00:01Z", "soon", None)]) == (False, True, False, False)


def test_small_images_and_transformed_copies(spark):
    high = [sev.thresholds(F.lit(w), F.lit(h), F.lit(t))[1] for w, h, t in ((399, 401, False), (400, 400, False), (400, 400, True))]
    assert np.allclose(one(spark, *high), (0.84, 0.87, 0.85))


def test_regional_boost_bounds_are_exclusive(spark):
    def lift(score, regions):
        return sev.regional_boost(F.lit(score), F.array(*[F.lit(r) for r in regions]))

    assert one(spark, lift(0.70, [0.92, 0.1]), lift(0.70, [0.93, 0.1]), lift(0.65, [0.93, 0.1]), lift(0.61, [0.76, 0.76])) == (0.70, 0.82, 0.65, 0.76)
    assert one(spark, sev.regional_boost(F.lit(0.5), F.lit(None).cast("array<double>"))) == (0.5,)


def test_match_rules(spark):
    assert one(spark, sev.match_status(F.lit("MISS"), F.lit(0.60)), sev.match_status(F.lit("MISS"), F.lit(0.61)), sev.match_status(F.lit("HIGH"), F.lit(0.1))) == (None, "RE_EVAL_NEEDED", "HIGH")
    assert one(spark, sev.is_transformed(F.lit(0.86), F.lit(None).cast("double")), sev.is_transformed(F.lit(0.85), F.lit(0.0)), sev.is_clone(F.lit(0.91), F.lit(0.49))) == (True, False, True)
    assert one(spark, sev.video_severity(F.lit(2), F.lit(False)), sev.video_severity(F.lit(1), F.lit(False)), sev.video_severity(F.lit(1), F.lit(True))) == ("HIGH", "LOW", "CRITICAL")


def test_vectors(spark):
    a, b = F.array(*[F.lit(x) for x in (3.0, 4.0)]), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, F.round(sim.cosine(a, a), 6), sim.cosine(a, b), sim.dot(a, F.array(F.lit(1.0))), sim.normalize(b)) == (1.0, 0.0, None, [0.0, 0.0])
    hi, lo = sim.hash_halves(F.lit("ffffffffffffffff"))
    zero = F.lit(0).cast("long")
    assert one(spark, sim.hamming(hi, lo, zero, zero)) == (64,)
    row = spark.createDataFrame([([1.0, 2.0],)], "v array<float>").select(sim.unpack_float32(sim.pack_float32(F.col("v")))).head()
    assert row[0] == [1.0, 2.0]


def test_urls(spark):
    rows = spark.createDataFrame([("https://a.b.c.com:80/x?y",), ("nothing",), ("http://host/x",)], "u string")
    assert [r[0] for r in rows.select(urls.apex(F.col("u"))).collect()] == ["c.com:80", "nothing", "host"]
    assert one(spark, *[urls.is_media(F.lit(x)) for x in ("https://a/b.jpg", "https://a/b.svg", "https://a/pixel.png", "ftp://a/b.jpg", None)]) == (True, False, False, False, False)
    links = spark.createDataFrame([("http://a/b/c", "../d"), ("http://a/b/c", None)], "b string, l string")
    assert [r[0] for r in links.select(urls.join_url(F.col("b"), F.col("l"))).collect()] == ["http://a/d", None]


def test_policy_inherits_and_defaults(spark):
    df = spark.createDataFrame([("x.imgur.com",), ("instagram.com",), ("other.net",)], "host string")
    got = {r["host"]: (r["policy"], r["allowed"], r["rps"]) for r in crawl.with_policy(df, "host", crawl.policies(spark)).collect()}
    assert got == {"x.imgur.com": ("imgur.com", True, 5.0), "instagram.com": ("instagram.com", False, 0.0), "other.net": (None, True, 2.0)}


def test_token_bucket_burst(spark):
    df = spark.createDataFrame([(i, "k", 0.0 if i < 5 else 1.0) for i in range(7)], "id int, k string, s double").selectExpr("id", "k", "timestamp_micros(cast(s * 1000000 as bigint)) as t")
    got = [r["passed"] for r in crawl.token_bucket(df, "k", "t", "id", 2.0).orderBy("id").collect()]
    assert got == [True] * 4 + [False] + [True] * 2


def test_bloom_has_no_false_negatives():
    bits, hashes = hashing.bloom_size(100_000_000, 0.001)
    assert (bits, hashes) == (1_437_758_757, 10)


def test_custody_strict(spark):
    df = spark.createDataFrame([("a", 1, "h1", "x"), ("a", 2, "h2", "h1"), ("b", 1, "h", custody.ZERO)], "asset string, n int, own string, prev string")
    assert {r["asset"]: r["valid"] for r in custody.checked(df, "asset", ["n"], "own", "prev").collect()} == {"a": True, "b": True}
    assert {r["asset"]: r["valid"] for r in custody.checked(df, "asset", ["n"], "own", "prev", strict=True).collect()} == {"a": False, "b": True}


def test_argument_checks(spark):
    empty = spark.createDataFrame([], "asset_id long, detected_at timestamp, severity string")
    for bad in ({"hours": 0}, {"hours": 721}, {"min_severity": "odd"}):
        with pytest.raises(ValueError):
            sightings.recent(empty, empty, "2024-01-01", **bad)


def test_schemas(spark):
    for name in ("ORGANIZATIONS", "REGISTERED_ASSETS", "SIGHTINGS", "CUSTODY_LOG", "SESSIONS", "STREAM_ASSIGNMENTS", "LEAKER_IDENTIFICATIONS", "ASSETS_DNA", "MEDIA_ITEMS"):
        assert spark.createDataFrame([], getattr(schemas, name)).count() == 0
    df = spark.createDataFrame([("HIGH",), ("odd",), (None,)], "severity string")
    assert schemas.violations(df).count() == 1


def test_container_detects_tampering(spark, tmp_path):
    from sightline.sources import containers

    raw = container.pack("00000000-0000-0000-0000-000000000001", "00000000-0000-0000-0000-000000000002", "org", 5, b"image", {"clip": [1.0, 2.0]}, watermark_seed=2**32 - 1, watermark=b"w")
    doc = container.unpack(raw)
    assert doc["vectors"]["clip"] == [1.0, 2.0] and doc["vectors"]["hog"] is None and doc["watermark_seed"] == 2**32 - 1 and doc["custody_valid"] and doc["image_valid"]
    assert container.unpack(raw[:-40] + b"x" + raw[-39:])["error"] == "checksum differs"
    assert container.unpack(b"short")["error"] == "too small"
    entries = container.chained([(1, 0, bytes(16)), (2, 1, bytes(16))])
    assert container.chain_valid(entries) and not container.chain_valid([entries[0][:2] + (b"x" * 16,) + entries[0][3:], entries[1]])
    df = spark.createDataFrame([("one", bytearray(raw))], "asset_uuid string, content binary")
    containers.write(df, f"file://{tmp_path}/c")
    assert containers.read(spark, f"file://{tmp_path}/c").select("org_name", "error").head() == ("org", None)
    containers.register(spark)
    assert spark.read.format("mediacontainer").load(f"{tmp_path}/c/*.bin").select("org_name").head()[0] == "org"


def test_decryption(spark):
    row = spark.range(1).select(F.lit(b"0123456789abcdef").alias("key"), F.lit(b"n" * 12).alias("nonce"), F.lit(b"id").alias("identity"), F.lit(b"secret").alias("plain"))
    sealed = row.withColumn("all", F.aes_encrypt("plain", "key", F.lit("GCM"), F.lit("DEFAULT"), F.col("nonce"), F.col("identity")))
    parts = sealed.select("key", "nonce", "identity", F.expr("substring(all, 13, length(all) - 28)").alias("body"), F.expr("substring(all, length(all) - 15, 16)").alias("tag"))
    assert bytes(parts.select(container.decrypted("nonce", "body", "tag", "key", "identity")).head()[0]) == b"secret"


def test_watermarks():
    plane = np.random.default_rng(1).uniform(60, 190, (256, 256))
    copy = imaging.embed_spectrum(plane, 7, 8, 9, 10)
    assert imaging.similarity_index(plane, copy) > 0.9 and imaging.extract_spectrum(np.ones((8, 8))) is None
    assert set(imaging.extract_spectrum(copy)) >= {"seed", "valid"}
    assert imaging.extract_wavelet(imaging.embed_wavelet(plane, 5, 6, 7)) == {"asset": 5, "owner": 6, "timestamp": 7, "valid": True}
    pixels = np.random.default_rng(2).integers(0, 256, (64, 64, 3), dtype=np.uint8)
    bits = "01" * 128
    assert imaging.extract_low_bits(imaging.embed_low_bits(pixels, bits, "0000002a"), "0000002a") == bits
    low, high = imaging.haar(plane)
    assert np.allclose(imaging.unhaar(low, high), plane)
    assert np.array_equal(imaging.stream_variant(pixels, 3, 0), pixels) and not np.array_equal(imaging.stream_variant(pixels, 3, 1), pixels)


def test_fingerprints():
    gray = np.random.default_rng(3).uniform(0, 255, (300, 200))
    for f, n in ((imaging.signature_128, 128), (imaging.signature_512, 512), (imaging.gradients_128, 128)):
        v = f(gray)
        assert v.shape == (n,) and np.isclose(np.linalg.norm(v), 1, atol=1e-5)
    assert all(len(h) == 16 for h in imaging.perceptual_hashes(gray))
    assert imaging.color_moments(np.zeros((4, 4, 3))).tolist() == [0.0] * 9
    assert 0 <= imaging.manipulation_score(gray) <= 1 and 0 <= imaging.diffusion_score(gray) <= 1
    assert np.isclose(imaging.chi_square_p(3.841, 1), 0.05, atol=1e-3) and imaging.chi_square_p(0, 5) == 1.0


def test_signals():
    payload = signals.luminance_payload("a", "b")
    assert len(payload) == 64 and signals.coherent_bits(100 * signals.luminance_factor(64 * 15, payload)) == payload
    assert len(signals.symbol_bits(np.ones(30))) == 1 and len(signals.symbol_bits(np.ones(31))) == 2
    silence = np.zeros(44100 * 2)
    assert signals.extract_audio(signals.embed_audio(silence, 44100, "a", "b"), 44100, 16).tolist() == signals.audio_bits("a", "b")[:16].tolist()
    assert np.isclose(np.linalg.norm(signals.mel_embedding(np.sin(np.arange(22050) / 10))), 1)


def test_sequences():
    a = [[1.0, 0.0], [0.0, 1.0]]
    assert sequences.sequence_similarity(a, a) == 1.0 and sequences.sequence_similarity([], a) == 0.0
    assert sequences.sequence_score(a, [[1.0, 0.0]]) == 1 - 2**0.5 / 2 / 100


def test_texts(spark):
    start, end = texts.window_bounds(F.lit("2024-01-01T00:00:00Z / nonsense"))
    assert one(spark, start.isNotNull(), end.isNull()) == (True, True)
    assert one(spark, texts.hashtags(F.lit("the ipl")), texts.hashtags(F.lit("chess"))) == (["ipl", "iplt20", "cricket"], ["sportshighlights"])
    assert one(spark, texts.embedded_tag(F.lit('<x:owner>me</x:owner>'), "owner"), texts.embedded_tag(F.lit('<d x:owner="me"/>'), "owner"), texts.embedded_tag(F.lit("-"), "owner")) == ("me", "me", None)
    scores = {n: F.lit(0.5) for n in (*sim.WEIGHTS, "fusion")}
    report = one(spark, texts.evidence_report(F.lit("r"), F.lit("a"), F.lit("o"), F.lit("s"), F.lit("HIGH"), scores, F.lit(None).cast("string"), F.lit("now")))[0]
    assert "| clip | 50.00% | 40% |" in report and "Commitment: pending" in report


def test_sources(spark):
    from sightline.sources import crawled

    pages = spark.createDataFrame([("http://a/b/", '<img data-src="x.png"><video src="/v.mp4"></video><a class="next-page" href="?p=2">n</a>')], "url string, html string")
    assert {(r["kind"], r["media_url"]) for r in crawled.media_links(pages).collect()} == {("img", "http://a/b/x.png"), ("video", "http://a/v.mp4")}
    assert pages.select(crawled.next_page(F.col("html"))).head()[0] == "?p=2"
    feeds = spark.createDataFrame([("f", "<rss><item><link>http://a</link></item><item><title>t</title></item></rss>"), ("g", '<feed><entry><link href="http://b"/></entry></feed>')], "id string, xml string")
    assert {r["link"] for r in crawled.feed_links(feeds).collect()} == {"http://a", "http://b"}
    posts = spark.createDataFrame([("t", i, "2024-01-0%d" % (i + 1), bytearray(b"x") if i else None) for i in range(4)], "tag string, post_id int, taken_at string, media_bytes binary").withColumn("taken_at", F.col("taken_at").cast("timestamp"))
    assert crawled.recent_posts(posts, "2024-01-04", per_tag=1).count() == 1 and crawled.recent_posts(posts, "2024-01-04", hours=0).count() == 3
    videos = spark.createDataFrame([("v", ["a", "b"])], "video_id string, frames array<string>")
    assert [r["t"] for r in crawled.frames(videos).collect()] == [0, 5]


def test_lru_cache_in_order(spark):
    from collections import OrderedDict

    keys = [i * i % 7 + i % 3 for i in range(200)]
    df = spark.createDataFrame([(i, i % 2, k) for i, k in enumerate(keys)], "n int, shard int, k int")
    got = {r["n"]: r["hit"] for r in crawl.lru_hits(df, "k", "n", 3).collect()}
    caches, want = (OrderedDict(), OrderedDict()), {}
    for i, k in enumerate(keys):
        own = caches[i % 2]
        want[i] = k in own
        own[k] = True
        own.move_to_end(k)
        if len(own) > 3:
            own.popitem(last=False)
    assert got == want


def test_stores(spark, tmp_path):
    from sightline.sources import stores

    df = spark.createDataFrame([(1, "2024-01-01 10:00:00"), (2, "2024-01-02 10:00:00")], "asset_id int, detected_at string").withColumn("detected_at", F.col("detected_at").cast("timestamp"))
    stores.append_sightings(df, f"{tmp_path}/s")
    got = stores.sightings(spark, f"{tmp_path}/s", "2024-01-02 00:00:00")
    assert [r["asset_id"] for r in got.collect()] == [2] and "PartitionFilters: [isnotnull(day" in got._jdf.queryExecution().toString()
    stores.write_reports(df.select(F.lit("one\ntwo").alias("report")), f"{tmp_path}/r")
    assert spark.read.text(f"{tmp_path}/r").count() == 6
    stores.write_proofs(df, f"{tmp_path}/p")
    assert spark.read.json(f"{tmp_path}/p").count() == 2
    assert stores.index_of(spark, f"{tmp_path}/none", df).count() == 0 and stores.index_of(spark, f"{tmp_path}/s", df).count() == 2
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text('{"url": "http://a", "priority": 3}\n')
    from sightline.streaming import pipeline

    pipeline.run_once(stores.jobs(spark, f"{tmp_path}/j"), f"{tmp_path}/jo", f"{tmp_path}/jc")
    assert [tuple(r)[:2] for r in spark.read.parquet(f"{tmp_path}/jo").select("url", "priority").collect()] == [("http://a", 3)]


def test_uploads(spark):
    cases = [custody.decided(F.lit(v), F.lit(x)) for v, x in ((True, 0.1), (False, 0.75), (False, 0.76))]
    assert one(spark, *[c for case in cases for c in case]) == (1.0, "CRITICAL", 0.75, "MISS", 0.76, "HIGH")
    assert one(spark, *[urls.usable_response(F.lit(t), F.lit("x" * n)) for t, n in (("image/png", 100), ("image/png", 99), ("text/html", 200), (None, 200))]) == (True, False, False, False)
