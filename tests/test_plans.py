"""Operators at their edges, against plain Python."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline import views
from sightline.functions import imaging, png, signals, signing
from sightline.operators import crawl, graph, registry, stats
from sightline.plans import detection
from sightline.sources import crawled
from sightline.streaming import schedule


def test_chains_go_on_from_what_is_stored(spark):
    log = spark.createDataFrame([], registry.EMPTY_LOG.format(asset="a", kind="string"))
    for part in ([("x", 1, "one"), ("x", 2, "two"), ("y", 1, "only")], [("x", 1, "three"), ("z", 1, "new")], []):
        log = spark.createDataFrame(registry.appended(log, spark.createDataFrame(part, "a string, n int, t string"), "a", ["n"], "t").collect(), log.schema)
    got = [tuple(r) for r in registry.custody(log.where("a = 'x'"), "a").collect()]
    before = "0" * 64
    for position, (row, text) in enumerate(zip(got, ("one", "two", "three"), strict=True)):
        own = hashlib.sha3_256(f"{text}|{before}".encode()).hexdigest()
        assert row == ("x", position, text, before, own)
        before = own
    assert log.count() == 5


def test_responses_age_from_when_they_were_stored(spark):
    hours = [(0, "k"), (20, "k"), (40, "k"), (45, "k"), (1, "other")]
    rows = spark.createDataFrame([(i, k, h * 3600) for i, (h, k) in enumerate(hours)], "i long, k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["i"]: r["hit"] for r in crawl.ttl_hits(rows, "k", "ts", "i", 86400).collect()}
    assert got == {0: False, 1: True, 2: False, 3: True, 4: False}


def test_depth_of_long_chains_and_cycles(spark):
    chain = spark.range(300).select(F.col("id").alias("node_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    assert graph.depths(chain).where("depth <> node_id").count() == 0 and graph.depths(chain).count() == 300
    assert graph.depths(chain.limit(0)).count() == 0


def test_pages_of_long_walks_and_cycles(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(12, 3), (50, 51)], "page long, next long")
    assert sorted(r[0] for r in registry.pages_reached(links, spark.range(1)).collect()) == list(range(13))


def test_cells_find_most_of_the_best(spark):
    probes, assets = views.probes(spark, "/root/testdata/sf0.01"), views.fingerprints(spark, "/root/testdata/sf0.01")
    found = detection.centroids(assets, 16)
    exact = {tuple(r) for r in detection.top_k(probes, assets, 5).select("query_id", "asset_id").collect()}
    near = {tuple(r) for r in detection.search_cells(probes, detection.indexed(assets, found), found, 10, 5, block_rows=20).select("query_id", "asset_id").collect()}
    assert len(exact & near) >= 0.9 * len(exact)
    whole = {tuple(r) for r in detection.search_cells(probes, detection.indexed(assets, found), found, 16, 5).select("query_id", "asset_id").collect()}
    assert whole == exact


def test_equal_streams_are_compared_once(spark):
    """Leakers against plain Python, with ties, missing and unequal streams; a join makes no pair of rows for equal streams."""
    draw = np.random.default_rng(3)
    streams = [[int(x) for x in draw.integers(0, 2, 8)] for _ in range(5)] + [[1, 0, 1], [1, None, 1, 0, 0, 1, 1, 0]]
    observed = [(i, i % 3, streams[i % 7]) for i in range(600)] + [(7, 1, streams[2]), (900, 9, streams[0]), (901, None, streams[0])]
    assigned = [(1000 - i, i % 4, streams[(i * i) % 7]) for i in range(400)] + [(5000, None, streams[0])]
    same = lambda a, b: sum(x is not None and x == y for x, y in zip(a, b))
    want: dict = {}
    for i, a, bits in observed:
        for j, b, own in assigned:
            if a is not None and a == b:
                want[i] = max(want.get(i, (-1.0,)), (same(bits, own) / len(bits), -j, same(bits, own), len(bits)))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the plan that ran can be walked
    try:
        found = stats.leakers(spark.createDataFrame(observed, "sighting_id long, asset_id int, bits array<int>"), spark.createDataFrame(assigned, "subscriber_id long, asset_id int, bit_sequence array<int>"))
        assert {r["sighting_id"]: (r["confidence"], -r["subscriber_id"], r["matched"], r["total"]) for r in found.collect()} == want
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    nodes = [found._jdf.queryExecution().executedPlan()]
    for node in nodes:
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    made = [n.metrics().apply("numOutputRows").value() for n in nodes if "Join" in n.nodeName()]
    assert made and max(made) <= len(observed)


@pytest.mark.parametrize("most", [0, 1, 3, 7, 12])
def test_hash_neighbours_loses_none(spark, most):
    draw = np.random.default_rng(most)
    base = draw.integers(0, 2**32, (6, 2))
    rows = []
    for i in range(120):
        h = base[i % 6].copy()
        for b in draw.choice(64, draw.integers(0, most + 3), replace=False):
            h[b // 32] ^= 1 << int(b % 32)
        rows.append((i, int(h[0]), int(h[1])))
    table = spark.createDataFrame(rows, "id long, phash_hi long, phash_lo long")
    got = {(r["query_id"], r["asset_id"]): r["distance"] for r in detection.hash_neighbours(table.withColumnRenamed("id", "query_id"), table.withColumnRenamed("id", "asset_id"), most).collect()}
    want = {(a, b): bin(x ^ u).count("1") + bin(y ^ v).count("1") for a, x, y in rows for b, u, v in rows}
    assert got == {k: d for k, d in want.items() if d <= most}


def test_layers_that_are_missing_count_nothing(spark):
    probes = spark.createDataFrame([(1, [1.0, 0.0], None, [1.0], [1.0], [1.0, 0.0], 0, 0, 500, 500, None)], "query_id long, clip array<double>, spatial array<double>, dct array<double>, hog array<double>, color array<double>, phash_hi long, phash_lo long, width int, height int, regions array<array<double>>")
    assets = spark.createDataFrame([(7, [2.0, 0.0], [1.0], [1.0], None, [3.0, 0.0], 0, 1)], "asset_id long, clip array<double>, spatial array<double>, dct array<double>, hog array<double>, color array<double>, phash_hi long, phash_lo long")
    row = detection.fused(probes, assets).head()
    assert (row["spatial_score"], row["hog_score"], row["distance"]) == (0.0, 0.0, 1) and abs(row["fusion_score"] - (0.40 + 0.15 * 63 / 64 + 0.10 + 0.15)) < 1e-6


def test_candidates_leave_their_task_ranked(spark):
    """The fused search against plain numpy, with equal assets and scores of equal nine places, and probes of one id; no candidate is shuffled."""
    draw = np.random.default_rng(5)
    near = np.array([1.0] + [0.0] * 7), np.array([1.0, 2.8e-5] + [0.0] * 6)
    assets = [(i + 10, draw.normal(size=8)) for i in range(200)]
    assets += [(1000 - i, v) for i, v in assets[:60]] + [(2, near[0]), (1, near[1])]
    probes = [(i, v + draw.normal(size=8) / 5) for i, (_, v) in enumerate(assets[:90])] + [(500, near[0]), (3, draw.normal(size=8))]
    layers = [F.slice("clip", a, n).alias(name) for name, a, n in (("spatial", 1, 4), ("dct", 3, 4), ("hog", 5, 4), ("color", 1, 2))]
    extra = [*layers, F.lit(0).cast("long").alias("phash_hi"), F.lit(0).cast("long").alias("phash_lo")]
    left = spark.createDataFrame([(i, v.tolist()) for i, v in probes], "query_id long, clip array<double>").select("*", *extra, F.lit(500).alias("width"), F.lit(300).alias("height"), F.array(F.slice("clip", 5, 2)).alias("regions"))
    right = spark.createDataFrame([(i, v.tolist()) for i, v in assets], "asset_id long, clip array<double>").select("*", *extra)
    unit = lambda v: v / np.linalg.norm(v)

    def ranked(probes, k):
        want = {}
        for q in {q for q, _ in probes}:
            found = sorted((-round(float(unit(v) @ unit(a)), 9), i) for p, v in probes if p == q for i, a in assets)
            want |= {(q, n + 1): i for n, (_, i) in enumerate(found[:k])}
        return want

    for k in (1, 7):
        one = detection.fused(left.where("query_id <> 3"), right, k)
        assert {(r["query_id"], r["rank"]): r["asset_id"] for r in one.collect()} == ranked([p for p in probes if p[0] != 3], k)
        assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
        assert {(r["query_id"], r["rank"]): r["asset_id"] for r in detection.fused(left, right, k).collect()} == ranked(probes, k)
    kept = {(r["query_id"], r["rank"]) for r in detection.fused(left, right, 7, kept=True).where("status is not null").collect()}
    assert kept and kept == {(r["query_id"], r["rank"]) for r in detection.fused(left, right, 7).where("status is not null").collect()}


def test_gate_and_scheduler(spark):
    rows = spark.createDataFrame([(1, "a.com", 0), (2, "a.com", 0), (3, "b.org", 0), (4, "a.com", 3), (5, "a.com", 3)], "seq long, domain string, s long").withColumn("ts", F.timestamp_seconds("s"))
    table = crawl.policies(spark, (("a.com", True, 0.5), ("org", False, 0.0)))
    assert {r["seq"]: r["outcome"] for r in crawl.gated(rows, "domain", "ts", "seq", table).collect()} == {1: "passed", 2: "limited", 3: "blocked", 4: "passed", 5: "limited"}
    queue = rows.withColumns({"shard": F.lit(0), "score": F.col("seq") % 2})
    assert [(r["seq"], r["place"]) for r in crawl.scheduled(queue, F.col("domain"), "seq").orderBy("seq").collect()] == [(1, 1), (2, None), (3, 2), (4, None), (5, None)]


def test_sweeps(spark):
    got = [(r["sweep"], str(r["at"])[11:16]) for r in schedule.due(spark, "2024-01-01 02:50:00", "2024-01-01 03:15:00").orderBy("at", "sweep").collect()]
    assert got == [("rescan", "03:00"), ("windows", "03:00"), ("windows", "03:15")]


def test_relational_tables_are_read_in_ranges(spark, data):
    url = "jdbc:derby:memory:sightline;create=true"
    nation = spark.read.parquet(f"{data}/nation.parquet").withColumnRenamed("n_name", "NAME").select(F.col("n_nationkey").alias("ID"), "NAME")
    nation.write.jdbc(url, "NATION", mode="overwrite")
    got = crawled.jdbc(spark, url, "NATION", "ID", 0, 25, 4)
    assert got.rdd.getNumPartitions() == 4 and sorted(r["ID"] for r in got.collect()) == list(range(25))


def test_signatures():
    n, d = signing.rsa_key(3, 1024)
    salt = bytes(range(32))
    signature = signing.rsa_sign(b"message", n, d, salt)
    assert signing.rsa_verify(b"message", signature, n) and not signing.rsa_verify(b"massage", signature, n) and not signing.rsa_verify(b"message", signature[:-1] + b"\0", n)
    assert signing.multiple(2) == (0x7CF27B188D034F7E8A52380304B51AC3C08969E277F21B35A60B48FC47669978, 0x07775510DB8ED040293D9AC69F7430DBBA7DADE63CE982299E04B79D227873D1)
    assert signing.multiple(signing.ORDER) is None
    own = signing.curve_sign(b"m", 12345)
    public = signing.multiple(12345)
    assert signing.curve_verify(b"m", own, public) and not signing.curve_verify(b"n", own, public) and not signing.curve_verify(b"m", own, signing.multiple(12346)) and not signing.curve_verify(b"m", bytes(64), public)
    assert signing.fingerprint(b"key") == hashlib.sha3_256(b"key").hexdigest()


def test_image_files():
    import struct
    import zlib

    draw = np.random.default_rng(1)
    for shape in ((5, 7), (4, 3, 3)):
        pixels = draw.integers(0, 256, shape, dtype=np.uint8)
        assert (png.decode(png.encode(pixels)).reshape(shape) == pixels).all()
    # Rows by each filter, against their definitions.
    rows = draw.integers(0, 256, (5, 6), dtype=np.uint8)
    want, raw = np.zeros((5, 6), dtype=int), b""
    for y, kind in enumerate(range(5)):
        raw += bytes([kind]) + rows[y].tobytes()
        for x in range(6):
            a, b, c = int(want[y, x - 1]) if x else 0, int(want[y - 1, x]) if y else 0, int(want[y - 1, x - 1]) if x and y else 0
            near = min((a, b, c), key=lambda v: abs(a + b - c - v))
            want[y, x] = (int(rows[y, x]) + (0, a, b, (a + b) // 2, near)[kind]) & 255
    data = png.written([(b"IHDR", struct.pack(">IIBBBBB", 6, 5, 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(raw)), (b"IEND", b"")])
    assert (png.decode(data)[:, :, 0] == want).all()
    assert png.decode(b"nothing") is None and png.decode(data[:40]) is None
    twice = png.with_chunk(png.with_chunk(data, b"abCd", b"1"), b"abCd", b"2")
    assert [c for c in png.chunks(twice) if c[0] == b"abCd"] == [(b"abCd", b"2")] and png.chunks(twice)[-1][0] == b"IEND"


def test_edges_and_wavelet_hashes():
    gray = np.zeros((64, 64))
    gray[:, 32:] = 255
    found = imaging.edges(gray)
    assert found[10:50].any(axis=1).all() and not found[:, :28].any() and not found[:, 36:].any()
    assert imaging.wavelet_hash(gray) == "0f" * 8 and abs(np.linalg.norm(imaging.edge_gradients_128(gray)) - 1) < 1e-6
    assert not imaging.edges(np.full((8, 8), 7.0)).any()


def test_sounds():
    t = np.arange(22050) / 22050
    chroma = signals.chroma(np.sin(2 * np.pi * 440 * t))
    assert chroma.shape[0] == 12 and (chroma.argmax(axis=0) == 0).all() and np.allclose(chroma.sum(axis=0), 1)
    mel = signals.mel_signature(np.sin(2 * np.pi * 440 * t))
    assert mel.shape == (128,) and abs(mel.mean()) < 1e-9 and abs(mel.std() - 1) < 1e-6
    both = np.column_stack([np.linspace(-1, 1, 100), np.zeros(100)])
    audio, rate = signals.samples(signals.wav(both, 8000))
    assert rate == 8000 and np.abs(audio - both).max() < 1e-4 and signals.samples(b"none") is None
