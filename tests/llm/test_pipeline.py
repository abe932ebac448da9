"""The corpus pipeline, stage by stage against brute force."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from sightline.llm import queries

from test_operators import components, encoded, shingles, words


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "decontamination", "mixing", "token_files"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data).cache()
        kept[name] = docs.toPandas()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    first = kept["language_id"]
    assert len(first) == spark.read.parquet(f"{data}/documents.parquet").count()
    want = components({i: shingles(t, 5) for i, t in first[["doc_id", "text"]].itertuples(index=False)}, 80)
    assert sorted(kept["near_dedup"]["doc_id"]) == sorted(i for i, c in want.items() if i == c)
    windows = set()
    for t in spark.read.parquet(f"{data}/benchmark.parquet").toPandas()["text"]:
        own = words(t)
        n = min(13, len(own))
        windows |= {tuple(own[q : q + n]) for q in range(len(own) - n + 1)}
    clean = []
    for i, t in kept["near_dedup"][["doc_id", "text"]].itertuples(index=False):
        own = words(t)
        hit = {p for n in {len(w) for w in windows} for q in range(len(own) - n + 1) if tuple(own[q : q + n]) in windows for p in range(q, q + n)}
        if not hit or 20 * len(hit) < len(own):
            clean.append(i)
    assert sorted(kept["decontamination"]["doc_id"]) == sorted(clean)
    mixed = kept["mixing"]
    assert mixed.groupby("doc_id").size().max() <= 2 and set(mixed["doc_id"]) <= set(clean)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, data).orderBy("start").collect()
    ordered = mixed.sort_values(["doc_id", "text"])
    ids = encoded(ordered["text"])
    assert [r["doc_id"] for r in out] == ordered["doc_id"].tolist() and [r["n_tokens"] for r in out] == [len(x) for x in ids]
    assert [r["start"] for r in out] == np.r_[0, np.cumsum([len(x) for x in ids])[:-1]].tolist()


def test_stages_on_odd_rows(spark, data):
    odd = spark.createDataFrame([(1, None, None, None, None, 1), (2, "", "en", "a", 0, 2), (3, "some words", None, "a", 1, 3), (3, "some words", None, "a", 1, 3), (None, "other words here", "en", None, 1, 4)], "doc_id long, text string, lang string, source string, n_chars long, _rejected int")
    for rows in (odd, odd.limit(0)):
        docs = rows
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, data).cache()
        assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    kept = corpus_pipeline.drop_near_duplicates(spark, odd, data)
    assert kept.where("doc_id = 3").count() == 1 and kept.where("doc_id is null").count() == 1
    assert queries.tokenizer_path().endswith(".json") and kept.select(F.count(F.lit(1))).head()[0] == 4
