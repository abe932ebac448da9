"""Corpus operators: whole small tables against brute force, and odd inputs."""

import collections
import hashlib
import html
import math
import re
import string
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from compare import same
from sightline.llm import bm25, decontaminate, html_extract, language_id, licenses, mixing, near_dedup, queries, secrets, token_files, url_filter

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, row long, words string, size int"
LONG = "Der Anfang. " + "the of and token " * 30_000


def words(text):
    return WORD.findall((text or "").translate(LOWER))


@pytest.fixture(scope="session")
def documents(data):
    return pd.read_parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and extra columns of clashing names."""
    rows = [
        (1, None, "en", "a", None, 1.0, 1, "x", 1), (2, "", "en", None, 0, 1.0, 1, "x", 1), (3, " \n\t ", None, "a", 3, None, None, None, None), (4, LONG, "en", "a", 1, 1.0, 1, "x", 1),
        (5, "the same words in this text again", "en", "b", 1, 1.0, 1, "x", 1), (5, "the same words in this text again", "en", "b", 1, 1.0, 1, "x", 1), (6, "the same words in this text again", "en", "b", 1, 1.0, 1, "x", 1),
        (None, "no id at all", None, None, None, None, None, None, None), (7, "1234 5678", "de", "b", 1, 1.0, 1, "x", 1), (8, "Ünder ﬁne é İ ſ Word", "de", "b", 1, 1.0, 1, "x", 1),
    ]
    return spark.createDataFrame(rows, ODD)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], ODD)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, data, name):
    same(spark, data, queries.QUERIES[name], queries.ORACLES[name])


# ---- 1: token files ---------------------------------------------------------------------------


def test_code_round_trip():
    values = np.r_[0, 1, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1, np.random.default_rng(1).integers(0, 2**32, 1001)].astype(np.uint32)
    for n in (0, 1, 2, 3, 4, 5, len(values)):
        control, data = token_files.encode_values(values[:n])
        assert np.array_equal(token_files.decode_values(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n), values[:n])
    block = token_files.pack_block(3, 17, [5, None], np.array([2, 1]), np.array([7, 300, 70000]))
    part, start, ids, counts, ranks = token_files.unpack_block(block)
    assert (part, start, ids, counts.tolist(), ranks.tolist()) == (3, 17, [5, None], [2, 1], [7, 300, 70000])


def encoded(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


def test_token_files_are_the_whole_texts(spark, data, documents):
    got = queries.op1_token_files(spark, data).orderBy("doc_id").collect()
    docs, start = documents.sort_values("doc_id"), 0
    for row, doc, ids in zip(got, docs["doc_id"], encoded(docs["text"]), strict=True):
        assert tuple(row) == (doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_files_of_odd_rows(spark, odd, none, tmp_path):
    token_files.write_token_files(odd, f"file://{tmp_path}/t", queries.tokenizer_path())
    got = token_files.read_token_files(spark, f"file://{tmp_path}/t").orderBy("start").collect()
    rows = sorted(((r["doc_id"], r["text"]) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [r["doc_id"] for r in got] == [r[0] for r in rows]
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in got] == encoded([r[1] for r in rows])
    token_files.write_token_files(none, f"file://{tmp_path}/e", queries.tokenizer_path())
    assert token_files.read_token_files(spark, f"file://{tmp_path}/e").count() == 0


def test_chunks_encode_as_whole_texts():
    import pyarrow as pa

    encode = token_files.ChunkEncoder(queries.tokenizer_path(), "<u2")
    texts = ["It's A.b,c 9,9.. <|endoftext|> x<|endoftext|>", "é e\u0301 H\u0331 Σς \u3000\xa0\x85\x1c\x01 x\x01y", "a \x01 b", "", " ", "'S 's. ,'ll"]
    ids, counts = encode(pa.array(texts), 1)
    assert ids.tolist() == [i for x in encoded(texts) for i in x] and counts.tolist() == [len(x) for x in encoded(texts)]


# ---- 2: url filter ----------------------------------------------------------------------------


def test_cascade_is_exact(spark):
    draw = np.random.default_rng(2)
    h1, h2 = (draw.integers(-(2**63), 2**63 - 1, 30_000) for _ in range(2))
    listed = np.arange(30_000) < 2000
    frame = spark.createDataFrame(pd.DataFrame({"h1": h1, "h2": h2, "listed": listed})).cache()
    cascade = url_filter.build_cascade(frame)
    assert len(cascade.levels) > 2 and np.array_equal(cascade.listed(h1.view(np.uint64), h2.view(np.uint64)), listed)
    assert not url_filter.build_cascade(frame.where("not listed")).levels


def test_urls_of_odd_rows(spark):
    urls = [None, "", "no scheme", "HTTP://A.Example.ORG/es/x?q#f", "x://org", "x://org/", "x://bad.casino.net", "x://a.com/fr/1#/", "x://É.com/de/"]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)] * 2, "page_id int, url string, host string, rule string")
    listed = spark.createDataFrame([("bad.casino.net",), ("elsewhere.net",), (None,), ("",)], "host string")
    for most in (url_filter.MAX_BYTES, 0):
        got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge_urls(pages, listed, queries.URL_RULES, most).collect()}
        assert got[0] == got[1] == got[2] == ("", "", None, "block")
        assert got[3] == ("a.example.org", "/es/x", "example.org/es/", "block")
        assert got[4] == ("org", "", None, "allow") and got[5] == ("org", "/", "org/", "allow")
        assert got[6] == ("bad.casino.net", "", None, "block") and got[7] == ("a.com", "/fr/1", "com/fr/", "allow") and got[8] == ("É.com", "/de/", "com/de/", "block")
    assert url_filter.judge_urls(pages.limit(0), listed, queries.URL_RULES).count() == 0


# ---- 3: decontamination -----------------------------------------------------------------------


def test_contamination_of_odd_rows(spark, odd, none):
    span = [f"w{i}" for i in range(30)]
    docs = odd.select("doc_id", "text", "words").union(spark.createDataFrame([
        (20, " ".join(span[3:16]), ""), (21, "x " + " ".join(span[3:15]) + " y", ""), (22, "z " * 300 + " ".join(span[:14]), ""), (23, "a b c d Short, item", ""), (24, " ".join(span + ["q"] + span), ""),
    ], "doc_id long, text string, words string"))
    items = spark.createDataFrame([(1, " ".join(span), "x"), (2, "short item", "x"), (3, None, "x"), (4, "", "x"), (1, " ".join(span), "x")], "item_id long, text string, hash string")
    for most in (decontaminate.MAX_BROADCAST_ROWS, 0):
        got = {r["doc_id"]: r for r in decontaminate.digest(decontaminate.find_contamination(docs, items, max_broadcast_rows=most)).collect()}
        assert [(got[i]["n_hit"], got[i]["n_items"], got[i]["contaminated"]) for i in (20, 21, 22, 23, 24)] == [(13, 1, True), (0, 0, False), (14, 1, False), (2, 1, True), (60, 1, True)]
        assert (got[1]["n_words"], got[1]["contaminated"]) == (0, False) and got[None]["n_words"] == 4
        assert got[20]["items_sha256"] == hashlib.sha256(b"1").hexdigest() and got[1]["items_sha256"] == hashlib.sha256(b"").hexdigest()
    assert decontaminate.find_contamination(odd, items.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.find_contamination(none, items).count() == 0


# ---- 4: search --------------------------------------------------------------------------------


def brute_force(docs, asked, k=10):
    """Of each query (id, text) the ten best (score, id) by BM25 over all its words; docs: (id, text)."""
    counts = [(i, collections.Counter(w for w in (x.strip(string.punctuation) for x in (t or "").translate(LOWER).split()) if w)) for i, t in docs]
    df = collections.Counter(w for _, c in counts for w in c)
    n, length = len(counts), [sum(c.values()) for _, c in counts]
    mean = sum(length) / n
    idf = {w: math.log(1 + (n - f + 0.5) / (f + 0.5)) for w, f in df.items()}
    out = {}
    for q, text in asked:
        terms = {w for w in (x.strip(string.punctuation) for x in (text or "").translate(LOWER).split()) if w in idf}
        found = {(sum(idf[w] * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size / mean)) for w in sorted(terms) if w in c), i) for (i, c), size in zip(counts, length) if i != q}
        out[q] = sorted((-round(s, 6), i) for s, i in found if s > 0)[:k]
    return out


def searched(frame):
    got = collections.defaultdict(list)
    for r in frame.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got[r["query_id"]]) + 1
        got[r["query_id"]].append((-r["score"], r["doc_id"]))
    return got


def agree(got, want):
    assert set(got) == {q for q, best in want.items() if best}
    for q, best in got.items():
        assert np.allclose([s for s, _ in best], [s for s, _ in want[q]], atol=2e-6), q
        assert [d for _, d in best] == [d for _, d in want[q]] or np.diff([s for s, _ in want[q]]).min() < 2e-6, q


@pytest.mark.parametrize("shard", [1 << 14, 64])
def test_search_is_exact(spark, data, documents, shard, monkeypatch):
    monkeypatch.setattr(bm25, "SHARD_DOCS", shard)
    monkeypatch.setattr(bm25, "PART_QUERIES", 4 if shard == 64 else 1 << 14)
    docs = list(documents[["doc_id", "text"]].itertuples(index=False, name=None))
    agree(searched(queries.op4_topk_search(spark, data)), brute_force(docs, [d for d in docs if d[0] % 20 == 0]))


def test_search_with_outside_queries_copies_and_ties(spark, monkeypatch):
    monkeypatch.setattr(bm25, "SHARD_DOCS", 8)
    docs = [(i, f"alpha beta w{i % 7}") for i in range(40)] + [(100 + i, "copy of one text") for i in range(30)] + [(200, "zebra stands alone"), (201, "alpha"), (202, "Beta, beta."), (203, None)]
    docs += [(300, "two texts alpha"), (300, "one id zebra"), (300, "one id zebra")]
    asked = [(1000, "zebra"), (1001, "unknown words"), (1002, "ALPHA w3 w3"), (5, "alpha beta w5"), (100, "copy of one text"), (117, "copy of one text"), (200, "zebra stands alone"), (300, "two texts alpha"), (300, "one id zebra"), (7, "zebra"), (1003, ""), (None, "zebra")]
    schema = "doc_id long, text string"
    got = searched(bm25.search(spark.createDataFrame(docs, schema), spark.createDataFrame(asked, schema)))
    whole = [a for a in asked if a[0] is not None and a[0] != 300] + [(300, "two texts alpha one id zebra")]
    agree(got, brute_force(docs, whole))
    assert [d for _, d in got[1000]] == [200, 300] and [d for _, d in got[100]] == list(range(101, 111)) and [d for _, d in got[117]] == list(range(100, 110))
    assert got[200][0][1] == 300 and 300 not in [d for _, d in got[300]] and 1001 not in got


def test_pruning_agrees_with_scoring_all():
    draw = np.random.default_rng(3)
    ids = [[i, i + 1] if i % 6 == 0 else [i] for i in range(0, 4000, 2)]
    held = [np.unique(draw.zipf(1.3, 40) % 500 + 1 + 1000 * (i % 3)).astype(np.uint64) for i in range(2000)]
    counts = [draw.integers(1, 9, len(w)).astype(np.uint32) for w in held]
    shard = bm25.Shard(ids, held, counts, [int(c.sum()) for c in counts], 40.0, np.array([2, 1002, 2002], dtype=np.uint64))
    assert 0 < len(shard.most) < len(shard.words) and shard.blocks > 10
    tiles = []
    score = shard._score
    shard._score = lambda weights, scores, wanted: (tiles.append(wanted.mean()), score(weights, scores, wanted))
    asked = [(np.unique(draw.integers(1, 501, n) + 1000 * (n % 3)).astype(np.uint64), n % 4 or None) for n in list(range(1, 30)) * 3]
    asked = [(w, draw.uniform(0.1, 6, len(w)), 10 * leave if leave else None) for w, leave in asked]
    for (words, idf, leave), best in zip(asked, shard.best_of(asked, 10), strict=True):
        total = np.zeros(len(ids))
        for own, w in zip(shard.lists(words), idf):
            if own is not None:
                total[shard.docs[own]] += w * shard.gain[own].astype(np.float64)
        found = sorted((-s, m) for s, own in zip(total, shard.members) for m in own.tolist() if s > 0 and m != leave)[:10]
        assert np.allclose([s for _, s in best], [-s for s, _ in found], rtol=1e-6)
    assert sum(tiles) < 0.6  # blocks were left out


def test_search_of_odd_rows(odd, none):
    got = bm25.search(odd, odd.where("doc_id = 5")).collect()
    assert {r["doc_id"] for r in got if r["query_id"] == 5} <= {4, 6, 8} and got[0]["doc_id"] == 6
    assert bm25.search(odd, odd.where("doc_id < 4")).count() == 0 and bm25.search(none, none).count() == 0 and bm25.search(odd, none).count() == bm25.search(none, odd).count() == 0


# ---- 5: language ID ---------------------------------------------------------------------------


def test_languages_on_held_out_rows(spark, data, documents):
    got = queries.op5_language_id(spark, data).toPandas().merge(documents, on="doc_id")
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]).all()
    held = got[got["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.95 and not got["rejected"].any() and got["score"].between(0, 1).all()


def test_languages_of_odd_rows(odd, none):
    got = {r["doc_id"]: r for r in language_id.predictions(odd).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 7)] == ["und"] * 4 and got[4]["lang_pred"] in ("en", "de")
    assert got[None]["held_out"] is False
    assert language_id.predictions(none).count() == 0
    assert {r["lang_pred"] for r in language_id.predictions(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_foreign_scripts_are_rejected(spark, data):
    model = language_id.fit(spark.read.parquet(f"{data}/documents.parquet"))
    language, score, rejected = model.predict(["это совсем другой язык, и его здесь никто не знает", "αυτή είναι μια άλλη γλώσσα", "the of that and", "5"])
    assert rejected.tolist() == [True, True, False, True] and language[3] == "und"


def test_windows_do_not_change_scores():
    model = language_id.Model(["a", "b"], np.random.default_rng(4).normal(size=(1 << language_id.BUCKET_BITS, 2)).astype(np.float32), np.zeros(2))
    texts = ["some words here", "é" * 50 + " x", "1 2", "more"] * 5
    model.seen = np.ones(1 << language_id.BUCKET_BITS, dtype=np.int32)
    whole, _, known = model.logits(texts)
    assert known.tolist() == [1.0, 1.0, 0.0, 1.0] * 5
    language_id._WINDOW, before = 7, language_id._WINDOW
    cut = model.logits(texts)[0]
    language_id._WINDOW = before
    assert np.allclose(whole, cut)


# ---- 6: mixing --------------------------------------------------------------------------------


def targets(spark, sizes):
    rows = spark.createDataFrame([(*s, 1) for s in sizes], "source string, size long, rows long")
    return [tuple(r) for r in mixing.source_targets(rows).orderBy(F.col("source").asc_nulls_last()).select("target", "slope", "total").collect()]


def test_targets(spark):
    got = targets(spark, [("a", 100), ("b", 100), ("c", 100), (None, 0)])
    t = [x[0] for x in got]
    assert t[0] == 200.0 and math.isclose(sum(t), 450) and math.isclose(t[1] / t[2], 2) and t[3] == 0.0 and math.isclose(got[0][2], 450)
    assert abs(sum(x[0] * x[1] for x in got)) < 1e-9 and math.isclose(got[0][1] - got[1][1], 1.0)
    assert targets(spark, []) == [] and targets(spark, [("a", 0), (None, 0)]) == [(0.0, 0.0, 0.0)] * 2
    assert [x[0] for x in targets(spark, [("a", 1), ("b", 1000), ("c", 1000)])] == [2.0, 1999.6666666666667, 999.8333333333334]


def test_positions_follow_the_schedule(spark):
    """Documents of one size: in every tenth of the run each source has its schedule's share, and another slope gives other positions."""
    docs = spark.range(9000).selectExpr("id AS doc_id", "'w ' || id AS text", "substr('abc', cast(id % 3 + 1 AS int), 1) AS source")
    plan = mixing.plan_mix(docs, weights=(1, 1, 1), slopes=(0.5, -0.5, 0.0))
    rows = plan.select("source", "total", F.explode("positions").alias("p")).toPandas()
    assert len(rows) == 13_500 and rows["p"].between(0, rows["total"][0] - 1).all()
    tenth = (rows["p"] * 10 // rows["total"]).astype(int)
    for source, slope in zip("abc", (0.5, -0.5, 0.0)):
        got = tenth[rows["source"] == source].value_counts().sort_index().to_numpy() / 4500
        want = [(b - a) + slope * ((b * b - b) - (a * a - a)) for a, b in ((k / 10, (k + 1) / 10) for k in range(10))]
        assert np.abs(got - want).max() < 0.002
    even = mixing.plan_mix(docs, weights=(1, 1, 1), slopes=(0.0,)).toPandas().set_index("doc_id")["positions"]
    assert (plan.toPandas().set_index("doc_id")["positions"].str[0] != even.str[0]).mean() > 0.6


def test_mixed_rows_stand_in_order(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('w ', cast(id % 7 AS int)) AS text", "substr('abc', cast(id % 3 + 1 AS int), 1) AS source")
    at = {r["doc_id"]: r["positions"] for r in mixing.plan_mix(docs).collect()}
    nth = collections.Counter()
    order = []
    for r in mixing.mix(docs).collect():
        order.append(at[r["doc_id"]][nth[r["doc_id"]]])
        nth[r["doc_id"]] += 1
    assert order == sorted(order) and nth == {i: len(p) for i, p in at.items() if p}


def test_mix_meets_its_targets(spark, data, documents):
    got = queries.op6_mixing(spark, data).toPandas().merge(documents[["doc_id", "source"]], on="doc_id")
    assert (got["size"] == [len(t.split()) for t in documents.set_index("doc_id").loc[got["doc_id"], "text"]]).all()
    assert (got["taken"] <= 2 * got["size"]).all() and (got["taken"] % got["size"].clip(lower=1) == 0).all()
    for _, own in got.groupby("source"):
        assert own["size"].sum() == own["source_size"].iloc[0] and abs(own["taken"].sum() - own["target"].iloc[0]) <= own["size"].max() / 2 + 1
    again = queries.op6_mixing(spark, data).toPandas().sort_values("doc_id", ignore_index=True)
    assert again.equals(got.drop(columns="source").sort_values("doc_id", ignore_index=True)) and (got["position"].isna() == (got["taken"] == 0)).mean() > 0.9


def test_positions_invert_the_integral(spark):
    df = spark.createDataFrame([(u / 10, s) for u in range(11) for s in (-0.5, 0.0, 0.5)], "u double, s double")
    for r in df.select("u", "s", mixing.position(F.col("u"), F.lit(1.0), F.col("s")).alias("t")).collect():
        assert math.isclose(r["t"] + r["s"] * (r["t"] ** 2 - r["t"]), r["u"], abs_tol=1e-9)


def test_mix_of_odd_rows(odd, none):
    plan = {r["doc_id"]: r for r in mixing.plan_mix(odd).collect()}
    assert len(plan) == 9 and plan[1]["size"] == 0 and plan[4]["size"] == 120_002 and mixing.plan_mix(odd).count() == 10
    out = mixing.mix(odd)
    assert out.columns == odd.columns and mixing.mix(none).count() == 0 and mixing.taken_words(mixing.plan_mix(none)).count() == 0
    per = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    copies = mixing.plan_mix(odd).groupBy("doc_id").agg(F.sum(F.size("positions")).alias("n")).where("n > 0").collect()
    assert per == {r["doc_id"]: r["n"] for r in copies}


# ---- 7: licences ------------------------------------------------------------------------------


def test_license_phrases(spark, data, documents):
    got = queries.op7_licenses(spark, data).toPandas().set_index("doc_id")
    for i, text in documents[["doc_id", "text"]].itertuples(index=False):
        own, found = words(text), []
        for phrase, label in licenses.BASE_PHRASES.items():
            p = phrase.split()
            found += [(q, label) for q in range(len(own) - len(p) + 1) if own[q : q + len(p)] == p]
        row = got.loc[i]
        assert (row.n_words, row.n_base, row.base_labels) == (len(own), len(found), ",".join(sorted({x for _, x in found})))
        assert not found or (row.first_word, row.last_word) == (min(found)[0], max(found)[0])


def test_licenses_of_odd_rows(spark, odd, none):
    texts = ["Licensed under the Apache License, Version 2.0", "apache is a license of version 2 0", "CC BY cc by-NC 4.0 all rights reserved", "license version", "x GNU  General Public License, version 3 and gnu general public license version 2"]
    docs = odd.select("doc_id", "text", "words").union(spark.createDataFrame([(100 + i, t, "") for i, t in enumerate(texts)], "doc_id long, text string, words string"))
    got = {r["doc_id"]: r for r in licenses.digest(licenses.scan_licenses(docs)).collect()}
    assert (got[100]["labels"], got[100]["score"], got[100]["n_base"], got[100]["first_word"]) == ("apache-2.0", 1.0, 0, None)
    assert got[101]["labels"] == got[103]["labels"] == "" and got[103]["score"] == 0.0
    assert (got[102]["base_labels"], got[102]["n_base"], got[102]["first_word"], got[102]["last_word"]) == ("cc-by,reserved", 3, 0, 7) and "cc-by-nc-4.0" in got[102]["labels"]
    assert got[104]["labels"] == "gpl,gpl-2.0,gpl-3.0" and got[1]["n_words"] == 0 and got[4]["n_words"] == 120_002
    assert licenses.scan_licenses(none).count() == 0


# ---- 8: pages ---------------------------------------------------------------------------------


def test_articles(spark, data):
    pages = pd.read_parquet(f"{data}/pages.parquet")
    got = queries.op8_html_extract(spark, data).toPandas().set_index("page_id")
    for i, url, page in pages.itertuples(index=False):
        inner = re.search(r"<article>(.*?)</article>", page, re.S)[1].replace("<br>", " ")
        blocks = (" ".join(html.unescape(b).split()) for b in re.sub(r"</?(p|h1)>", "\0", re.sub(r"</?b>", "", inner)).split("\0"))
        text = "\n".join(b for b in blocks if b)
        assert (got.loc[i, "text"], got.loc[i, "n_chars"], got.loc[i, "url"]) == (text, len(text), url)


def test_pages_of_odd_rows(spark):
    body = "<body><header>top</header><article><h1>T &amp; t</h1><p>one <b>two</b>\n<a href=x>three</a><p>fo<i>u</i>r <span class=ad>buy</span>five<aside>side</aside><div class='comments'><p>no</p></div><script>if (a<b) '</p>'</script></article><footer>end</footer>"
    odd = [(1, None, None), (2, "x://h/", ""), (3, "x://h/", body), (3, "x://h/", body), (4, "x://h/", "plain <b>text</b>"), (5, "x://i/", "<main><p>a<br>b</p></main><p>c</p>"), (6, "x://i/", "<article>" + "<p>w" * 20_000), (7, "x://i/", "<p hidden>h</p><p>s<!-- c --></p><nav>n")]
    pages = spark.createDataFrame([(*r, "t", 1) for r in odd], "page_id int, url string, html string, text string, host int")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    assert got[1] == got[2] == "" and got[3] == "T & t\none two three\nfour five" and got[4] == "plain text" and got[5] == "a b" and got[6] == "\n".join("w" * 20_000) and got[7] == "s"
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_wrappers_fold_and_align():
    def of(page):
        return html_extract.expression(html_extract.parse(page))

    whole = html_extract.expression(of("<ul><li>a<li>b</ul><p>x"), of("<ul><li>a</ul><div>y</div><p>x<p>z"))
    assert html_extract.written(whole) == '(<ul>(<li>#</>)+</> (<div>"</>)? (<p>#</>)+)'[1:-1]
    assert html_extract.written(of("<h2>a</h2><p>b<h2>c</h2><p>d<h2>e</h2><p>f")) == "(<h2>#</> <p>#</>)+"
    assert html_extract.written(html_extract.expression(of("<p>a</p><b>same</b>"), of("<p>b</p><b>same</b><i>c</i>"))) == '<p>#</> <b>"</> (<i>"</>)?'
    for e in (whole, of("<p class=a>x<b>y</b>" * 3)):
        again = html_extract.unpacked(*html_extract.packed(e))
        assert html_extract.written(again) == html_extract.written(e) and html_extract.packed(again) == html_extract.packed(e)


# ---- 9: secrets -------------------------------------------------------------------------------


def spans(text):
    kinds = [(re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 6), (re.compile("AKIA[A-Z0-9]+"), 0, 20), (re.compile("[0-9a-f]+"), 0, 24)]
    return sorted((m.start(), k, m.end()) for k, (p, g, n) in enumerate(kinds) for m in p.finditer(text) if len(m[g]) >= n)


def hashed(found):
    return hashlib.sha256(",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in found).encode()).hexdigest()


def test_secret_spans(spark, data, documents):
    got = queries.op9_secrets(spark, data).toPandas().set_index("doc_id")
    for i, text in documents[["doc_id", "text"]].itertuples(index=False):
        found = spans(text)
        assert [got.loc[i, c] for c in ("n_assign", "n_access", "n_hex")] == [sum(k == x for _, k, _ in found) for x in range(3)] and got.loc[i, "base_sha256"] == hashed(found)


def test_secrets_of_odd_rows(spark, odd, none):
    draw = np.random.default_rng(5)
    key = "".join(draw.choice(list(string.ascii_letters + string.digits), 40))
    texts = ["é password=token = abcdefghij 😀 PassWd:'xyzxyz", "AKIA" + "A" * 15 + " AKIA" + "B" * 16, "f" * 23 + " " + "0a" * 12, f"see {key} here", "thonstthonstthonstthonstthonst erereretherererere"]
    docs = odd.select("doc_id", "text", "row").union(spark.createDataFrame([(100 + i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, row long"))
    got = {r["doc_id"]: r for r in secrets.digest(secrets.scan_secrets(docs)).collect()}
    for i, text in enumerate(texts):
        assert got[100 + i]["base_sha256"] == hashed(spans(text))
    assert got[103]["spans"] == "random:4:44" and got[104]["spans"] == "" and got[1]["spans"] == got[4]["spans"] == ""
    assert secrets.scan_secrets(none).count() == 0


# ---- 10: near-duplicates ----------------------------------------------------------------------


def components(sets, percent=85):
    low = {i: i for i in sets}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                low[b] = a
    return {i: root(i) for i in ids}


def shingles(text, k=3):
    own = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w]
    return {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if len(own) >= k else {tuple(own)} if own else set()


def test_chains_templates_and_copies(spark):
    """Chains that a pivot does not reach, texts that share a passage, and short, repeated and copied texts."""
    draw = np.random.default_rng(6)
    base = [f"w{i}" for i in range(200)]
    texts, text = {}, list(base)
    for i in range(12):  # a chain: each close to the next alone
        texts[100 + i] = " ".join(text)
        text[15 * i] = f"c{i}"
        text[15 * i + 7] = f"d{i}"
    passage = [f"p{i}" for i in range(150)]
    for i in range(40):
        texts[200 + i] = " ".join(passage + [f"o{i}x{j}" for j in range(12 + i % 5)])
    for i in range(30):
        own = list(base)
        for j in draw.choice(200, 4, replace=False):
            own[j] = f"e{i}x{j}"
        texts[300 + i] = " ".join(own)
    texts |= {1: "one", 2: "ONE", 3: "one two", 4: "two one", 5: "", 6: " \t", 7: " ".join(base), 8: " ".join(base).upper()}
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in texts.items()], "doc_id long, text string, component_id int, h1 string")
    near_dedup.BLOCK_TEXTS, before = 16, near_dedup.BLOCK_TEXTS
    got = {r["doc_id"]: r for r in near_dedup.find_near_duplicates(docs).collect()}
    near_dedup.BLOCK_TEXTS = before
    want = components({i: shingles(t) for i, t in texts.items()})
    assert {i: r["component_id"] for i, r in got.items()} == want and all(r["n_shingles"] == len(shingles(texts[i])) and r["kept"] == (i == want[i]) for i, r in got.items())


def test_near_duplicates_of_odd_rows(odd, none):
    rows = near_dedup.find_near_duplicates(odd).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == 10 and got[6]["component_id"] == 5 and not got[6]["kept"] and got[5]["kept"]
    assert got[1]["n_shingles"] == got[3]["n_shingles"] == 0 and got[1]["kept"] and got[None]["component_id"] is None and got[None]["kept"]
    assert near_dedup.find_near_duplicates(none).count() == 0


def test_bounds():
    assert near_dedup.band_rows(0.85) == 7 and near_dedup.band_rows(0.8) == 6
    least = near_dedup.least_equal(0.85)
    assert least == sorted(least) and least[-1] < 0.85 * near_dedup.HASHES


def test_words_of_long_documents_are_looked_up_alike(monkeypatch):
    """Shared words of query and documents: looked up in the documents or in the query, the same in the same order, so scores round alike."""
    draw = np.random.default_rng(2)
    words = [np.sort(draw.choice(np.arange(1, 9000, dtype=np.uint64), n, replace=False)) for n in (1, 3, 40, 700, 2500, 5000)]
    counts = [draw.integers(1, 9, len(w)).astype("<u4") for w in words]
    shard = bm25.Shard([np.array([i]) for i in range(len(words))], words, counts, [int(c.sum()) for c in counts], 900.0)
    number = np.sort(draw.choice(len(shard.words), 200, replace=False))
    for docs in (np.arange(6), np.arange(3), np.array([5]), np.zeros(0, dtype=np.int64)):
        monkeypatch.setattr(bm25, "LONG_DOC", 1 << 40)
        short = shard._shared(docs, number)
        monkeypatch.setattr(bm25, "LONG_DOC", -(1 << 20))
        assert all(np.array_equal(a, b) for a, b in zip(short, shard._shared(docs, number), strict=True))
    assert len(short[0]) == 0
