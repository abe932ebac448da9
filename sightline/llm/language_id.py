"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's letters (case-folded; everything else separates words) give subwords of 2 to 4 letters or
word edges, hashed into buckets. A text is the average of its subwords' embeddings, and a linear
layer with softmax scores the languages. Both are trained together by stochastic gradient descent in
numpy, on whole documents and on short passages of them, so that short texts are scored well too.
Part of the training documents set the softmax's temperature, the score under which a prediction is
rejected, and the share of known subwords under which it is. For that share each language is also left
out: how much of its texts do the others know?

Since everything after the average is linear, prediction needs the product of the two layers alone:
one row of language scores for each bucket.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

BUCKET_BITS = 16
SIZES = (2, 3, 4)
#: The bound of the training sample: about so many documents of each language, chosen by a hash of doc_id.
PER_LANGUAGE = 500
PASSAGES = 3
DIMENSIONS, EPOCHS, RATE = 16, 6, 0.5
#: Share of calibration texts that may score below the level of rejection. A text is rejected too if fewer of its
#: subwords were seen in training than half-way from what that share of calibration texts has to what the median
#: calibration text has if its own language is left out.
REJECTED = 0.0001
UNDETERMINED = "und"
_WINDOW = 1 << 18


# ---- subwords ---------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Each code point itself if it is a letter, else 0."""
    table = np.arange(0x110000, dtype=np.uint32)
    table[[not chr(i).isalpha() for i in range(0x110000)]] = 0
    return table


def _codes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts, word edges as 0, and where each text starts."""
    folded = [f" {t.lower()} " for t in texts]
    starts = np.cumsum([0, *map(len, folded)])
    return _letters()[np.frombuffer("".join(folded).encode("utf-32-le", "surrogatepass"), dtype="<u4")], starts


def _subwords(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and buckets of the subwords of one size: no word edge but at an end, and a letter at least."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint32)
    inner = np.ones(n, dtype=bool)
    for k in range(1, size - 1):
        inner &= codes[k : k + n] != 0
    if size == 2:
        inner = (codes[:n] != 0) | (codes[1 : 1 + n] != 0)
    value = np.full(n, size, dtype=np.uint32)
    for k in range(size):
        value = (value ^ codes[k : k + n]) * np.uint32(0x01000193 + 2 * k)
    value ^= value >> np.uint32(15)
    at = np.flatnonzero(inner)
    return at, (value[at] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and how often each occurs."""
    codes, _ = _codes([text])
    found = np.concatenate([_subwords(codes, size)[1] for size in SIZES])
    return np.unique(found, return_counts=True)


def has_letter(texts: Sequence[str]) -> np.ndarray:
    codes, starts = _codes(texts)
    return np.add.reduceat(codes != 0, starts[:-1]) > 0 if len(texts) else np.zeros(0, dtype=bool)


# ---- the model --------------------------------------------------------------------------------


@dataclass
class Model:
    languages: list[str]
    rows: np.ndarray
    bias: np.ndarray
    seen: np.ndarray | None = None
    temperature: float = 1.0
    threshold: float = 0.0
    known: float = 0.0

    def logits(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of each text's languages before softmax, whether it has letters, and its share of known subwords. Memory does not grow with a text's length but for its letters."""
        codes, starts = _codes(texts)
        total, number, known = np.zeros((len(texts), len(self.languages)), dtype=np.float64), np.zeros(len(texts)), np.zeros(len(texts))
        for a in range(0, len(codes), _WINDOW):
            for size in SIZES:
                at, buckets = _subwords(codes[a : a + _WINDOW + size - 1], size)
                if len(at):
                    of = np.searchsorted(starts, at + a, side="right") - 1
                    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                    total[of[first]] += np.add.reduceat(self.rows[buckets], first, axis=0)
                    number[of[first]] += np.diff(np.r_[first, len(of)])
                    if self.seen is not None:
                        known[of[first]] += np.add.reduceat(self.seen[buckets], first)
        return total / np.maximum(number, 1)[:, None] + self.bias, number > 0, known / np.maximum(number, 1)

    def predict(self, texts: Sequence[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score from 0 to 1 and whether the prediction is rejected."""
        if not self.languages or not len(texts):
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
        logits, lettered, known = self.logits(texts)
        shares = softmax(logits / self.temperature)
        best = shares.argmax(axis=1)
        score = np.where(lettered, shares[np.arange(len(best)), best], 0.0)
        return [self.languages[b] if ok else UNDETERMINED for b, ok in zip(best, lettered)], score, ~lettered | (score < self.threshold) | (known < self.known)


def softmax(logits: np.ndarray) -> np.ndarray:
    shares = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return shares / shares.sum(axis=-1, keepdims=True)


def train(samples: list[tuple[np.ndarray, np.ndarray, str, bool]], seed: int = 1) -> Model:
    """Fit to (buckets, counts, language, for calibration) in an order that depends on ``seed`` alone."""
    languages = sorted({s[2] for s in samples})
    if not languages:
        return Model([], np.zeros((1 << BUCKET_BITS, 0)), np.zeros(0))
    index, draw = {x: i for i, x in enumerate(languages)}, np.random.default_rng(seed)
    table = draw.uniform(-1, 1, (1 << BUCKET_BITS, DIMENSIONS)) / DIMENSIONS
    layer, bias = draw.normal(0, 0.1, (DIMENSIONS, len(languages))), np.zeros(len(languages))
    fit = [(b, c, index[x]) for b, c, x, held in samples if not held and len(b)]
    steps = EPOCHS * len(fit)
    for step in range(steps):
        if step % len(fit) == 0:
            order = draw.permutation(len(fit))
        buckets, counts, label = fit[order[step % len(fit)]]
        buckets, weight = buckets.astype(np.int64), counts / counts.sum()
        rate = RATE * (1 - step / steps)
        own = table[buckets]
        hidden = weight @ own
        error = softmax(hidden @ layer + bias)
        error[label] -= 1
        # The gradient of an average reaches each subword by its weight; scaled up so that rare subwords learn too.
        own -= (rate * np.minimum(1.0, weight * 32))[:, None] * (layer @ error)[None, :]
        table[buckets] = own
        layer -= rate * 0.2 * np.outer(hidden, error)
        bias -= rate * 0.02 * error
    by_language = np.zeros((len(languages), 1 << BUCKET_BITS), dtype=bool)
    for b, _, x in fit:
        by_language[x, b] = True
    languages_of = by_language.sum(axis=0)
    seen = (languages_of > 0).astype(np.int32)
    # A subword that was never seen says nothing.
    model = Model(languages, (table @ layer * seen[:, None]).astype(np.float32), bias, seen)
    held = [(b, c / c.sum(), index[x]) for b, c, x, out in samples if out and len(b)]
    # With one language nothing can be left out: a text of another then knows what chance makes it know.
    others = [float(w @ (languages_of[b] > by_language[x, b])) if len(languages) > 1 else float(seen.mean()) for b, w, x in held]
    return calibrated(model, held, others) if held else model


def calibrated(model: Model, held: list[tuple[np.ndarray, np.ndarray, int]], others: list[float]) -> Model:
    """Set the temperature of least loss, the threshold from the scores that it gives, and the least share of known subwords. ``others``: that share of each text without its own language."""
    logits = np.array([w @ model.rows[b] for b, w, _ in held]) + model.bias
    label = np.array([x for _, _, x in held])

    def loss(t: float) -> float:
        return float(-np.log(np.maximum(softmax(logits / t)[np.arange(len(label)), label], 1e-12)).mean())

    model.temperature = min((0.05 * 1.25**k for k in range(24)), key=loss)
    scores = softmax(logits / model.temperature).max(axis=1)
    model.threshold = float(np.quantile(scores, REJECTED))
    own = float(np.quantile([w @ model.seen[b] for b, w, _ in held], REJECTED))
    model.known = (own + min(own, float(np.median(others)))) / 2
    return model


# ---- tables -----------------------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string")) % 4 == 2, F.lit(False))


def _bags(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for key, text, language in zip(frame["doc_id"], frame["text"], frame["lang"]):
            draw, words = random.Random(int(key)), text.split()
            parts = [text]
            for _ in range(PASSAGES if len(words) > 1 else 0):
                size = min(len(words), draw.randint(1, 20))
                at = draw.randint(0, len(words) - size)
                parts.append(" ".join(words[at : at + size]))
            held = draw.random() < 0.2
            for part in parts:
                buckets, counts = bag(part)
                if len(buckets):
                    out.append((int(key), buckets.astype("<u2").tobytes(), np.minimum(counts, 0xFFFF).astype("<u2").tobytes(), language, held))
        yield pd.DataFrame(out, columns=["doc_id", "buckets", "counts", "lang", "held"])


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learn from text and lang of rows that are not held out. The driver gets the bags of about ``per_language`` documents of each language."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    counts = known.groupBy("lang").count().collect()
    if not counts:
        return train([])
    shares = docs.sparkSession.createDataFrame([(r["lang"], per_language / r["count"]) for r in counts], "lang string, share double")
    drawn = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = known.join(F.broadcast(shares), "lang").where(drawn < F.col("share")).select("doc_id", "text", "lang")
    rows = sample.mapInPandas(_bags, "doc_id long, buckets binary, counts binary, lang string, held boolean").toPandas()
    rows = rows.sort_values(["doc_id", "lang", "buckets", "counts"], kind="stable")
    return train([(np.frombuffer(b, "<u2"), np.frombuffer(c, "<u2"), x, h) for b, c, x, h in rows[["buckets", "counts", "lang", "held"]].itertuples(index=False)])


def _predicted(model: Model, text: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            found = [model.predict(texts[a : a + 100]) for a in range(0, len(texts), 100)]
            columns = [pa.array([x for f in found for x in f[0]], pa.string()), *(pa.array(np.concatenate([f[k] for f in found]) if found else [], kind) for k, kind in ((1, pa.float64()), (2, pa.bool_())))]
            keep = [i for i, name in enumerate(batch.schema.names) if name != text]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + columns, [batch.schema.names[i] for i in keep] + names)

    return run


def identify(docs: DataFrame, model: Model, carry: Sequence[str] | None = None) -> DataFrame:
    """The ``carry`` columns of every row (all by default), and after them _lang, _score and _rejected (with more underscores where a column has that name).

    Null text and text without a letter are ``und`` with score 0 and rejected. A model that has
    learned nothing says ``und`` and rejects nothing. Of languages of equal scores the first in order is
    said. Repeated rows are judged alike; an empty table gives an empty result.
    """
    carried = docs.select(*[F.col(f"`{c}`") for c in (carry if carry is not None else docs.columns)])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried.schema)
    text, *names = fresh(carried.columns, "_text", "_lang", "_score", "_rejected")
    rows = docs.select(*[F.col(f"`{c}`") for c in carried.columns], F.col("text").cast("string").alias(text))
    return rows.mapInArrow(_predicted(model, text, names), f"{schema}, {names[0]} string, {names[1]} double, {names[2]} boolean")


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected, by a model learned from the same table."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = identify(rows, fit(docs), ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"), F.col("_rejected").alias("rejected"))
