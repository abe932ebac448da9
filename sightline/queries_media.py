"""Registered queries of media: containers, seals and signatures, watermarks, image and audio layers, frames, the end of detection, the index of cells."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import views
from .functions import container, custody_layers, imaging, platforms, png, sequences, signals, signing, texts, urls
from .functions import severity as sev
from .functions import similarity as sim
from .operators import custody, stats
from .plans import detection
from .queries import _ASSETS, _DETECT, _DNA, _REQUESTS, _SIGHTINGS, _cos, query
from .sources import containers, crawled
from .workspace import fresh_folder

_PIXELS = "pixels AS (SELECT vec_id, list_transform(embedding, lambda x: greatest(0, least(255, CAST(floor(128 + 300 * CAST(x AS DOUBLE)) AS INTEGER)))) AS px FROM embeddings)"


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image of 8 x 8 pixels for each embedding."""
    own = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + 300 * x.cast("double")).cast("int"))))
    return views.table(spark, sf_dir, "embeddings").select("vec_id", own.alias("px"))


# ---- containers, seals, signatures ------------------------------------------------------------


@query("""SELECT vec_id AS asset_id, CASE WHEN vec_id % 7 <> 0 THEN printf('00000000-0000-0000-0000-%012x', vec_id) END AS asset_uuid, CASE WHEN vec_id % 7 <> 0 THEN printf('00000000-0000-0000-0000-%012x', vec_id % 5) END AS org_uuid,
  CASE WHEN vec_id % 7 <> 0 THEN 1700000000 + vec_id END AS signed_at, CASE WHEN vec_id % 7 <> 0 THEN 8 + CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN vec_id % 2 = 0 THEN 16 ELSE 0 END END AS flags,
  CASE WHEN vec_id % 7 <> 0 THEN round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) END AS total, CASE WHEN vec_id % 7 <> 0 THEN 3 END AS entries, CASE WHEN vec_id % 7 <> 0 THEN vec_id % 11 <> 0 END AS custody_valid, CASE WHEN vec_id % 7 <> 0 THEN true END AS image_valid,
  CASE WHEN vec_id % 7 <> 0 THEN 'image ' || vec_id END AS image, CASE WHEN vec_id % 7 = 0 THEN 'checksum differs' END AS error FROM embeddings""")
def container_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers written as files and read back; some were damaged, some have a broken custody chain."""

    @F.pandas_udf("binary")
    def packed(ids: pd.Series, clips: pd.Series) -> pd.Series:
        import uuid

        out = []
        for i, clip in zip(ids.tolist(), clips):
            chain = container.chained([(i, 0, bytes(16)), (i + 1, 1, bytes(16)), (i + 2, 2, bytes(16))])
            if i % 11 == 0:
                chain[2] = (*chain[2][:3], bytes(32))
            data = container.pack(str(uuid.UUID(int=i)), str(uuid.UUID(int=i % 5)), "org", 1_700_000_000 + i, f"image {i}".encode(), {"clip": clip}, watermark=b"w" if i % 3 == 0 else b"", custody=chain, embargo_until=1_800_000_000 if i % 2 == 0 else 0)
            out.append(data if i % 7 else data[:60] + bytes([data[60] ^ 1]) + data[61:])
        return pd.Series(out)

    at = fresh_folder(spark, "containers")
    rows = views.fingerprints(spark, sf_dir).select("asset_id", packed("asset_id", "clip").alias("content"))
    containers.write(rows.withColumn("name", F.col("asset_id").cast("string")), at, "name")
    read = containers.read(spark, at).withColumn("asset_id", F.regexp_extract("path", r"/(\d+)\.bin$", 1).cast("long"))
    total = sim.total(F.transform(F.col("vectors")["clip"], lambda x: x.cast("double")))
    return read.select("asset_id", "asset_uuid", "org_uuid", "signed_at", "flags", F.round(total, 4).alias("total"), F.when(F.col("custody").isNotNull(), F.size("custody")).alias("entries"), "custody_valid", "image_valid", F.decode("image", "utf-8").alias("image"), "error")


@query("SELECT vec_id AS asset_id, 'image ' || vec_id AS image FROM embeddings WHERE vec_id % 4 <> 0")
def container_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images of containers, where their hash agrees; of some the image was changed after hashing."""

    @F.pandas_udf("binary")
    def packed(ids: pd.Series) -> pd.Series:
        import hashlib
        import uuid

        out = []
        for i in ids.tolist():
            data = container.pack(str(uuid.UUID(int=i)), str(uuid.UUID(int=1)), "org", i, f"image {i}".encode(), {})
            if i % 4 == 0:  # another image under a right checksum
                whole = data[:-36].replace(b"image ", b"IMAGE ")
                data = whole + hashlib.sha3_256(whole).digest() + container.END
            out.append(data)
        return pd.Series(out)

    rows = views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("asset_id"), packed("vec_id").alias("content"))
    parsed = rows.select("asset_id", F.lit("").alias("path"), container.parsed("content").alias("d")).select("asset_id", "path", "d.*")
    return containers.images(parsed, "asset_id").select("asset_id", F.decode("image", "utf-8").alias("image"))


@query(f"WITH {_ASSETS} SELECT asset_id, CASE WHEN asset_id % 9 <> 0 THEN 'secret of ' || asset_id END AS text, CASE WHEN asset_id % 8 <> 0 THEN 'private key ' || org_id END AS key FROM assets")
def sealed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors sealed under their identity, and private keys under their organisation: opened again, unless the identity or the master key is another."""
    a = F.col("asset_id").cast("string")
    key, identity = F.encode(F.lit("0123456789abcdef"), "utf-8"), F.encode(F.concat(F.lit("asset "), a), "utf-8")
    nonce = F.substring(F.unhex(F.md5(a)), 1, 12)
    sealed = F.aes_encrypt(F.encode(F.concat(F.lit("secret of "), a), "utf-8"), key, F.lit("GCM"), F.lit("DEFAULT"), nonce, identity)
    rows = views.assets(spark, sf_dir).select("asset_id", "org_id", sealed.alias("sealed"))
    said = F.when(F.col("asset_id") % 9 == 0, F.encode(F.lit("another"), "utf-8")).otherwise(identity)
    org = F.encode(F.concat(F.lit("org "), F.col("org_id").cast("string")), "utf-8")
    private = F.aes_encrypt(F.encode(F.concat(F.lit("private key "), F.col("org_id").cast("string")), "utf-8"), key, F.lit("GCM"), F.lit("DEFAULT"), nonce, org)
    master = F.when(F.col("asset_id") % 8 == 0, F.encode(F.lit("fedcba9876543210"), "utf-8")).otherwise(key)
    rows = rows.select("asset_id", container.opened(F.col("sealed"), key, said).alias("text"), container.opened(private, master, org).alias("key"))
    return rows.select("asset_id", F.decode("text", "utf-8").alias("text"), F.decode("key", "utf-8").alias("key"))


@query("""SELECT vec_id AS asset_id, CASE WHEN vec_id % 7 = 0 THEN 'CONTAINER_MATCH' WHEN vec_id % 5 = 0 OR vec_id % 3 = 0 THEN 'CRYPTOGRAPHIC_LAYER_MATCH' ELSE 'NONE' END AS proof, CASE WHEN vec_id % 5 = 0 THEN 'payload ' || vec_id END AS payload,
  CASE WHEN vec_id % 3 = 0 THEN 'asset-' || vec_id END AS tag FROM embeddings""")
def verified_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads checked layer by layer: a container, a sealed chunk of the image, a signed packet in it. Wrong containers, chunks of another key and packets without a signature do not count."""
    rows = _pixels(spark, sf_dir).withColumnRenamed("vec_id", "asset_id")
    a = F.col("asset_id")
    key, said = F.encode(F.lit("0123456789abcdef"), "utf-8"), F.encode(F.lit("chunk"), "utf-8")
    wrong = F.encode(F.lit("fedcba9876543210"), "utf-8")
    payload = F.encode(F.concat(F.lit("payload "), a.cast("string")), "utf-8")
    chunk = F.aes_encrypt(payload, F.when(a % 5 == 0, key).otherwise(wrong), F.lit("GCM"), F.lit("DEFAULT"), F.substring(F.unhex(F.md5(a.cast("string"))), 1, 12), said)
    values = {"AssetID": F.concat(F.lit("asset-"), a.cast("string")), "OrgID": F.lit("1"), "Signature": F.when(a % 3 == 0, "00ff"), "SignedAt": F.lit("2024"), "PublicKeyURL": F.lit("https://k.example")}
    made = rows.select("asset_id", custody_layers.built("px", chunk, texts.packet(values)).alias("image"), custody_layers.boxed("asset_id").alias("content"))
    parts = made.select("asset_id", container.parsed("content").alias("box"), custody_layers.chunk("image").alias("chunk"), custody_layers.packet("image").alias("packet"))
    opened = container.opened(F.col("chunk"), key, said)
    signed = texts.embedded_tag(F.col("packet"), "Signature").isNotNull()
    found = parts.select("asset_id", custody.cascade(F.col("box.error").isNull() & F.col("box.image_valid"), opened.isNotNull(), signed).alias("proof"), F.decode(opened, "utf-8").alias("payload"), F.when(signed, texts.embedded_tag(F.col("packet"), "AssetID")).alias("tag"))
    return found


@query(f"WITH {_ASSETS} SELECT asset_id, 'asset-' || asset_id AS asset, CAST(org_id AS VARCHAR) AS org, nullif(CASE WHEN asset_id % 2 = 0 THEN 'sig' || asset_id ELSE '' END, '') AS signature, '2024-01-01' AS at_, 'https://k.example/' || org_id AS url FROM assets")
def embedded_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata packets written and read, tag by tag; an empty tag is none."""
    a, org = F.col("asset_id"), F.col("org_id").cast("string")
    values = {"AssetID": F.concat(F.lit("asset-"), a.cast("string")), "OrgID": org, "Signature": F.when(a % 2 == 0, F.concat(F.lit("sig"), a.cast("string"))), "SignedAt": F.lit("2024-01-01"), "PublicKeyURL": F.concat(F.lit("https://k.example/"), org)}
    rows = views.assets(spark, sf_dir).select("asset_id", texts.packet(values).alias("p"))
    names = ("asset", "org", "signature", "at_", "url")
    return rows.select("asset_id", *[texts.embedded_tag(F.col("p"), tag).alias(name) for tag, name in zip(texts.PACKET_TAGS, names)])


@query("SELECT n_nationkey AS asset_id, n_nationkey % 5 <> 0 AS commitment_valid, n_nationkey % 4 <> 0 AS container_valid, 64 AS fingerprint FROM nation")
def signed_commitments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of commitments and containers, made and checked; some were changed in between."""

    @F.pandas_udf("commitment_valid boolean, container_valid boolean, fingerprint int")
    def checked(ids: pd.Series) -> pd.DataFrame:
        import hashlib

        modulus, private = signing.rsa_key(1, 1024)
        out = []
        for i in ids.tolist():
            message = f"commitment {i}".encode()
            signature = signing.rsa_sign(message, modulus, private, hashlib.sha256(message).digest())
            rsa = signing.rsa_verify(message if i % 5 else message + b"!", signature, modulus)
            own = i + 7_000_000_007
            curve = signing.curve_verify(message if i % 4 else b"other", signing.curve_sign(message, own), signing.multiple(own))
            out.append((rsa, curve, len(signing.fingerprint(message))))
        return pd.DataFrame(out, columns=["commitment_valid", "container_valid", "fingerprint"])

    rows = views.table(spark, sf_dir, "nation").repartition(5).select(F.col("n_nationkey").alias("asset_id"), checked("n_nationkey").alias("c"))
    return rows.select("asset_id", "c.*")


# ---- watermarks -------------------------------------------------------------------------------


@query("SELECT vec_id AS asset_id, true AS wavelet_valid, vec_id AS wavelet_asset, sha256(CAST(vec_id AS VARCHAR)) AS low_bits, true AS alike FROM embeddings")
def watermark_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wavelet watermark and low bits in an image of every asset: embedded, extracted, compared with the original."""

    @F.pandas_udf("wavelet_valid boolean, wavelet_asset long, low_bits string, alike boolean")
    def marked(ids: pd.Series, rows: pd.Series) -> pd.DataFrame:
        import hashlib

        import numpy as np

        out = []
        for i, px in zip(ids.tolist(), rows):
            plane = np.kron(np.array(px, dtype=float).reshape(8, 8) * 0.4 + 60, np.ones((16, 16)))
            copy = imaging.embed_wavelet(plane, i, 7, 1000)
            got = imaging.extract_wavelet(copy)
            bits, name = f"{int(hashlib.sha256(str(i).encode()).hexdigest(), 16):0256b}", hashlib.md5(str(i).encode()).hexdigest()
            low = imaging.extract_low_bits(imaging.embed_low_bits(np.stack([plane] * 3, axis=2).astype(np.uint8), bits, name), name)
            out.append((got["valid"], got["asset"], f"{int(low, 2):064x}", imaging.similarity_index(plane, copy) > 0.8))
        return pd.DataFrame(out, columns=["wavelet_valid", "wavelet_asset", "low_bits", "alike"])

    rows = _pixels(spark, sf_dir).repartition(8)
    return rows.select(F.col("vec_id").alias("asset_id"), marked("vec_id", "px").alias("m")).select("asset_id", "m.*")


@query("SELECT vec_id AS asset_id, substr(sha256('asset-' || vec_id), 1, 8) || substr(sha256('stream-' || vec_id), 1, 8) AS payload FROM embeddings")
def psk_demodulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Luminance payloads embedded in a steady series and read coherently."""

    @F.pandas_udf("string")
    def read(ids: pd.Series) -> pd.Series:
        out = []
        for i in ids.tolist():
            factor = signals.luminance_factor(64 * signals.SYMBOL, signals.luminance_payload(f"asset-{i}", f"stream-{i}"))
            out.append(f"{int(signals.coherent_bits(128 * factor), 2):016x}")
        return pd.Series(out)

    return views.table(spark, sf_dir, "embeddings").repartition(8).select(F.col("vec_id").alias("asset_id"), read("vec_id").alias("payload"))


@query("SELECT n_nationkey AS asset_id, substr(sha256('asset-' || n_nationkey || 'stream'), 1, 16) AS payload, 44100 AS rate, CAST(44100 * 8.5 AS INTEGER) AS samples FROM nation")
def audio_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tones embedded in a sound, written as a file, read back and extracted."""

    @F.pandas_udf("payload string, rate int, samples int")
    def read(ids: pd.Series) -> pd.DataFrame:
        import numpy as np

        out = []
        for i in ids.tolist():
            t = np.arange(int(44100 * 8.5)) / 44100
            sound = 0.2 * np.sin(2 * np.pi * (200 + i) * t)
            audio, rate = signals.samples(signals.wav(signals.embed_audio(sound, 44100, f"asset-{i}", "stream"), 44100))
            out.append((np.packbits(signals.extract_audio(audio, rate)).tobytes().hex(), rate, len(audio)))
        return pd.DataFrame(out, columns=["payload", "rate", "samples"])

    return views.table(spark, sf_dir, "nation").repartition(8).select(F.col("n_nationkey").alias("asset_id"), read("n_nationkey").alias("r")).select("asset_id", "r.*")


# ---- images -----------------------------------------------------------------------------------


@query(f"WITH {_PIXELS} SELECT vec_id, 8 AS width, 8 AS height, list_avg(px) AS mean, px[1] AS first, px[64] AS last FROM pixels")
def image_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image files decoded to pixels."""

    @F.pandas_udf("width int, height int, mean double, first int, last int")
    def decoded(rows: pd.Series) -> pd.DataFrame:
        import numpy as np

        out = []
        for px in rows:
            image = png.decode(png.encode(np.array(px).reshape(8, 8)))
            out.append((image.shape[1], image.shape[0], float(image.mean()), int(image[0, 0, 0]), int(image[-1, -1, 0])))
        return pd.DataFrame(out, columns=["width", "height", "mean", "first", "last"])

    return _pixels(spark, sf_dir).select("vec_id", decoded("px").alias("d")).select("vec_id", "d.*")


def _hash_sql(test: str) -> str:
    half = "list_sum(list_transform(range({a}, {b}), lambda i: CASE WHEN px[i + 1] > {t} THEN (1::BIGINT << ({b} - 1 - i)) ELSE 0 END))"
    return f"printf('%08x%08x', CAST({half.format(a=0, b=32, t=test)} AS BIGINT), CAST({half.format(a=32, b=64, t=test)} AS BIGINT))"


_MOMENTS = ", ".join(f"channel_{c} AS (SELECT vec_id, list_avg(px[{c * 16 + 1} : {c * 16 + 16}]) AS m{c}, sqrt(list_avg(list_transform(px[{c * 16 + 1} : {c * 16 + 16}], lambda x: (x - list_avg(px[{c * 16 + 1} : {c * 16 + 16}])) ** 2))) AS s{c}, list_avg(list_transform(px[{c * 16 + 1} : {c * 16 + 16}], lambda x: (x - list_avg(px[{c * 16 + 1} : {c * 16 + 16}])) ** 3)) AS t{c} FROM pixels)" for c in range(3))
_NINE = ", ".join(f"m{c}, s{c}, CASE WHEN s{c} > 0 THEN t{c} / s{c} ** 3 ELSE 0 END" for c in range(3))


@query(f"""WITH {_PIXELS}, {_MOMENTS}, nine AS (SELECT vec_id, [{_NINE}]::DOUBLE[] AS v FROM channel_0 JOIN channel_1 USING (vec_id) JOIN channel_2 USING (vec_id))
SELECT vec_id, {_hash_sql('list_avg(px)')} AS ahash, {_hash_sql('list_median(px)')} AS whash, 128 AS dct, 128 AS hog, round(v[1] / sqrt(list_inner_product(v, v)), 5) AS color_1, round(v[5] / sqrt(list_inner_product(v, v)), 5) AS color_5, round(v[9] / sqrt(list_inner_product(v, v)), 5) AS color_9
FROM pixels JOIN nine USING (vec_id)""")
def image_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All layers that pixels give, of every image."""

    @F.pandas_udf("phash string, dhash string, ahash string, whash string, dct array<double>, hog array<double>, color array<double>")
    def layers(rows: pd.Series) -> pd.DataFrame:
        import numpy as np

        return pd.DataFrame([imaging.layers(np.array(px, dtype=float).reshape(8, 8), np.array(px[:48], dtype=float).reshape(3, 16).T.reshape(4, 4, 3)) for px in rows])

    found = _pixels(spark, sf_dir).repartition(8).select("vec_id", layers("px").alias("l")).select("vec_id", "l.*")
    return found.select("vec_id", "ahash", "whash", F.size("dct").alias("dct"), F.size("hog").alias("hog"), *[F.round(F.get("color", F.lit(i)), 5).alias(f"color_{i + 1}") for i in (0, 4, 8)])


_LAPLACE = "list_transform(range(0, 36), lambda i: px[(i // 6) * 8 + i % 6 + 2] + px[(i // 6 + 2) * 8 + i % 6 + 2] + px[(i // 6 + 1) * 8 + i % 6 + 1] + px[(i // 6 + 1) * 8 + i % 6 + 3] - 4 * px[(i // 6 + 1) * 8 + i % 6 + 2])"
_QUADS = "list_transform(range(0, 16), lambda i: 2.0::DOUBLE * (px[(i // 4) * 16 + (i % 4) * 2 + 1] + px[(i // 4) * 16 + (i % 4) * 2 + 2] + px[(i // 4) * 16 + (i % 4) * 2 + 9] + px[(i // 4) * 16 + (i % 4) * 2 + 10]))"


@query(f"WITH {_PIXELS} SELECT vec_id, round(greatest(0, least(1, 1 - list_var_pop({_LAPLACE}) / 1000)), 6)::DOUBLE AS manipulation, round(greatest(0, least(1, 1 - list_stddev_pop({_QUADS}) / 120)), 6)::DOUBLE AS diffusion FROM pixels")
def generated_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heuristics for smoothed and for generated images."""

    @F.pandas_udf("manipulation double, diffusion double")
    def scores(rows: pd.Series) -> pd.DataFrame:
        import numpy as np

        images = [np.array(px, dtype=float).reshape(8, 8) for px in rows]
        return pd.DataFrame({"manipulation": [round(imaging.manipulation_score(p), 6) for p in images], "diffusion": [round(imaging.diffusion_score(np.kron(p, np.ones((4, 4)))), 6) for p in images]})

    return _pixels(spark, sf_dir).select("vec_id", scores("px").alias("s")).select("vec_id", "s.*")


@query(f"WITH {_REQUESTS} SELECT seq, CASE seq % 3 WHEN 0 THEN 'instagram' WHEN 1 THEN 'tiktok' END AS platform FROM requests")
def platform_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("seq")
    url = F.concat(F.lit("https://"), F.when(s % 3 == 0, "www.instagram.com").when(s % 3 == 1, "m.tiktok.com").otherwise("other.example"), F.lit("/x"))
    return views.requests(spark, sf_dir).select("seq", urls.simulated_platform(url).alias("platform"))


@query("""WITH s AS (SELECT vec_id, 300 + vec_id * 37 % 3000 AS w, 300 + vec_id * 53 % 3000 AS h FROM embeddings), c AS (SELECT * FROM (VALUES ('instagram', 1080, 1080), ('tiktok', 1080, 1920), ('twitter', 1200, 675)) AS t(platform, cw, ch)),
f AS (SELECT vec_id, platform, cw, ch, greatest(1, CAST(round(w * least(1.0::DOUBLE, cw / w::DOUBLE, ch / h::DOUBLE)) AS INTEGER)) AS width, greatest(1, CAST(round(h * least(1.0::DOUBLE, cw / w::DOUBLE, ch / h::DOUBLE)) AS INTEGER)) AS height FROM s, c)
SELECT vec_id, platform, width, height, (cw - width) // 2 AS offset_left, (ch - height) // 2 AS offset_top FROM f UNION ALL SELECT vec_id, 'original', CAST(w AS INTEGER), CAST(h AS INTEGER), 0, 0 FROM s""")
def platform_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image as each platform would show it."""
    v = F.col("vec_id")
    rows = views.table(spark, sf_dir, "embeddings").select(v, F.explode(platforms.variants(300 + v * 37 % 3000, 300 + v * 53 % 3000)).alias("x"))
    return rows.select("vec_id", "x.platform", "x.at.width", "x.at.height", F.col("x.at.left").alias("offset_left"), F.col("x.at.top").alias("offset_top"))


# ---- frames and sounds ------------------------------------------------------------------------


@query("""WITH f AS (SELECT event_id // 12 AS video_id, event_id % 12 * 5 AS t, CASE WHEN event_id % 7 <> 0 THEN value END AS frame FROM events)
SELECT video_id, t, frame, CAST(row_number() OVER (PARTITION BY video_id ORDER BY t) - 1 AS INTEGER) AS nth, duration FROM (SELECT *, max(t) OVER (PARTITION BY video_id) AS duration FROM f) WHERE t IN (0, 5, 15, 30) AND frame IS NOT NULL""")
def sampled_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames at the sampling times; some could not be read."""
    e = F.col("event_id")
    rows = views.table(spark, sf_dir, "events").select(F.floor(e / 12).alias("video_id"), (e % 12 * 5).alias("t"), F.when(e % 7 != 0, F.col("value")).alias("frame"))
    return crawled.sampled(rows, "video_id", "t", "frame")


@query("SELECT event_id // 10 AS video_id, event_id % 10 * 5 AS t, value AS frame FROM events")
def frame_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos that arrive with their frames in order: a row for each, with its time."""
    rows = views.table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 10).alias("video_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "value"))), lambda x: x["value"]).alias("frames"))
    return crawled.frames(rows).withColumn("t", F.col("t").cast("long"))


@query("""WITH m AS (SELECT user_id % 20 AS video, event_id // 50 AS frame, avg(value) AS mean FROM events GROUP BY ALL)
SELECT video, count(*) AS frames, round(sum(mean * n), 3) AS weighted FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY frame) AS n FROM m) GROUP BY video""")
def luminance_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("video"), F.floor(F.col("event_id") / 50).alias("frame"), "value")
    series = stats.luminance_series(rows, "video", "frame", "value")
    weighted = sim.total(F.transform("series", lambda x, i: x * (i + 1)))
    return series.select("video", F.size("series").cast("long").alias("frames"), F.round(weighted, 3).alias("weighted"))


@query(f"""WITH {_PIXELS}, f AS (SELECT vec_id % 5 AS video, vec_id // 5 AS frame, px, lag(px) OVER (PARTITION BY vec_id % 5 ORDER BY vec_id) AS before FROM pixels),
c AS (SELECT video, frame, list_avg(list_transform(range(1, 65), lambda i: abs(px[i] - before[i]))) AS change FROM f WHERE before IS NOT NULL) SELECT video, frame, round(change, 5) AS change FROM c WHERE change > 42""")
def pixel_scene_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    rows = _pixels(spark, sf_dir).select((v % 5).alias("video"), F.floor(v / 5).alias("frame"), "px")
    return stats.frame_changes(rows, "video", "frame", "px", 42.0).select("video", "frame", F.round("change", 5).alias("change"))


@query("SELECT user_id % 10 AS image, round(avg(abs(value - 20)), 6) AS confidence FROM events GROUP BY 1")
def watermark_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("image"), (F.col("value") - 20).alias("c"))
    return stats.confidence(rows, ["image"], "c").withColumn("confidence", F.round("confidence", 6))


def _warp_sql() -> str:
    """The best path through 8 x 8 costs, diagonal by diagonal: [cost, length] lists compare like tuples."""
    tables, last = [], "p"
    for d in range(15):
        cells = []
        for i in range(max(0, d - 7), min(8, d + 1)):
            j = d - i
            x, y = f"a[{i * 8 + 1}:{i * 8 + 8}]", f"b[{j * 8 + 1}:{j * 8 + 8}]"
            before = [(k, m) for k, m in ((i - 1, j - 1), (i - 1, j), (i, j - 1)) if k >= 0 and m >= 0]
            for kind, cost in (("c", f"(1 - list_cosine_similarity({x}, {y}))"), ("e", f"list_distance({x}, {y})")):
                names = ", ".join(f"{kind}_{k}_{m}" for k, m in before)
                least = f"least({names})" if len(before) > 1 else names or "[0.0::DOUBLE, 0.0::DOUBLE]"
                cells.append(f"[{cost} + {least}[1], 1 + {least}[2]] AS {kind}_{i}_{j}")
        tables.append(f"d{d} AS MATERIALIZED (SELECT *, {', '.join(cells)} FROM {last})")
        last = f"d{d}"
    return ", ".join(tables)


@query(f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings), p AS (SELECT x.vec_id AS asset_id, x.a, y.a AS b FROM v x JOIN v y ON y.vec_id = x.vec_id + 1), {_warp_sql()}
SELECT asset_id, round(1 - greatest(0, least(1, c_7_7[1] / c_7_7[2])), 5)::DOUBLE AS similarity, round(greatest(0, least(1, 1 - e_7_7[1] / 8 / 100)), 5)::DOUBLE AS score FROM d14""")
def dtw_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of each fingerprint, cut into a sequence, with its neighbour's."""
    rows = views.fingerprints(spark, sf_dir).select("asset_id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("clip", i * 8 + 1, 8)).alias("s"))
    other = rows.select((F.col("asset_id") - 1).alias("asset_id"), F.col("s").alias("t"))
    met = rows.join(other, "asset_id").select("asset_id", sequences.dtw_similarity("s", "t").alias("similarity"), sequences.dtw_score("s", "t").alias("score"))
    return met.select("asset_id", F.round("similarity", 5).alias("similarity"), F.round("score", 5).alias("score"))


@query(f"WITH {_DNA} SELECT x.asset_id, round(1 - greatest(0, least(1, 1 - {_cos('x.clip', 'y.clip')})), 6)::DOUBLE AS similarity FROM fingerprints x JOIN fingerprints y ON y.asset_id = x.asset_id + 1")
def audio_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.fingerprints(spark, sf_dir).select("asset_id", "clip")
    other = rows.select((F.col("asset_id") - 1).alias("asset_id"), F.col("clip").alias("other"))
    return rows.join(other, "asset_id").select("asset_id", F.round(sim.clipped_similarity(1 - sim.cosine(F.col("clip"), F.col("other"))), 6).alias("similarity"))


# ---- detection --------------------------------------------------------------------------------


def _levels_sql(critical: float, high: float, medium: float) -> str:
    return f"CASE WHEN fusion_score >= {critical} THEN 'CRITICAL' WHEN fusion_score >= {high} THEN 'HIGH' WHEN fusion_score >= {medium} THEN 'MEDIUM' ELSE 'MISS' END"


@query(f"WITH {_SIGHTINGS} SELECT sighting_id, {_levels_sql(*sev.FUSION_THRESHOLDS)} AS fusion, {_levels_sql(*sev.CLASSIFY_THRESHOLDS)} AS classified, {_levels_sql(*sev.SETTINGS[:3])} AS settings FROM sightings")
def severity_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same scores under each set of thresholds."""
    sets = {"fusion": sev.FUSION_THRESHOLDS, "classified": sev.CLASSIFY_THRESHOLDS, "settings": sev.SETTINGS[:3]}
    return views.sightings(spark, sf_dir).select("sighting_id", *[sev.classify(F.col("fusion_score"), *t).alias(n) for n, t in sets.items()])


@query(f"""{_DETECT}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fusion_score, 9) DESC, asset_id) AS n FROM fused WHERE status IS NOT NULL) WHERE n = 1)
SELECT query_id, asset_id, CASE WHEN query_id % 4 = 0 AND severity <> 'MISS' THEN CASE severity WHEN 'MEDIUM' THEN 'HIGH' ELSE 'CRITICAL' END ELSE severity END AS severity, query_id % 4 = 0 AND severity IN ('MEDIUM', 'HIGH') AS embargo_violation,
  CASE WHEN severity IN ('CRITICAL', 'HIGH') AND query_id % 3 <> 0 THEN query_id % 5 = 0 END AS watermark_match FROM best""")
def concluded_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole detection to its end: best match, embargo, watermark."""
    q = F.col("query_id")
    probes = views.probes(spark, sf_dir)
    facts = probes.select("query_id", F.when(q % 3 != 0, "owner").alias("owner"), F.when(q % 4 == 0, "2024-06-01T00:00:00Z").when(q % 4 == 1, "2023-06-01T00:00:00Z").alias("embargo_until"), (q % 5 == 0).alias("watermark_valid"))
    found = detection.concluded(detection.detect(probes, views.fingerprints(spark, sf_dir)), facts, "2024-01-15 00:00:00")
    return found.select("query_id", "asset_id", "severity", "embargo_violation", "watermark_match")


@query(f"""WITH {_DNA}, u AS (SELECT asset_id, clip, sqrt(list_inner_product(clip, clip)) AS size FROM fingerprints), c AS (SELECT asset_id AS cell, clip, size FROM u WHERE asset_id < 16),
a AS (SELECT asset_id, cell FROM (SELECT u.asset_id, c.cell, row_number() OVER (PARTITION BY u.asset_id ORDER BY round(list_inner_product(u.clip, c.clip) / (u.size * c.size), 9) DESC, c.cell) AS n FROM u, c) WHERE n = 1),
q AS (SELECT query_id, cell FROM (SELECT p.query_id, c.cell, row_number() OVER (PARTITION BY p.query_id ORDER BY round(list_inner_product(p.clip, c.clip) / (sqrt(list_inner_product(p.clip, p.clip)) * c.size), 9) DESC, c.cell) AS n FROM probes p, c) WHERE n <= 4),
s AS (SELECT q.query_id, a.asset_id, list_inner_product(p.clip, u.clip) / (sqrt(list_inner_product(p.clip, p.clip)) * u.size) AS clip_raw FROM q JOIN a USING (cell) JOIN u USING (asset_id) JOIN probes p USING (query_id))
SELECT query_id, asset_id, round(clip_raw, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(clip_raw, 9) DESC, asset_id) AS rank FROM s) WHERE rank <= 10""")
def cell_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search in the four nearest of sixteen cells, whose centroids are the first assets."""
    import numpy as np

    probes, assets = views.probes(spark, sf_dir), views.fingerprints(spark, sf_dir)
    first = np.array([r["clip"] for r in assets.where("asset_id < 16").orderBy("asset_id").select("clip").collect()], dtype=np.float64)
    found = detection.search_cells(probes, detection.indexed(assets, first), first, 4, 10)
    return found.select("query_id", "asset_id", F.round("clip_raw", 6).alias("score"), "rank")
