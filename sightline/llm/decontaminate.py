"""Benchmark decontamination by winnowing, with DataFrame functions only.

Every text keeps, of each run of SPAN - K + 1 consecutive k-grams, the one with the least hash (the
last of equals). Any SPAN words that two texts share hold such a run in both, and the same k-gram of
it is kept in both; so each shared span of at least SPAN words has a common fingerprint at the same
distance from its start. Training and test fingerprints are joined, each meeting gives a relative
position of the two texts, and along it the hit is extended to all windows that agree word by word.

Items shorter than SPAN words are one window. For each such length in the test set (fewer than SPAN
of them) the grams of that length are looked up instead, which needs no guarantee.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, fresh, split_words

SPAN, K = 13, 5
#: Fingerprints of the test set are sent to all tasks up to this many rows (16 bytes each); beyond, the join is by shuffle.
MAX_BROADCAST_ROWS = 2_000_000


def gram(words: Column, i: Column, k: int) -> Column:
    """32-bit hash of the k words from position i (from 0). Meetings by chance fall away when hits are extended."""
    return F.hash(*[F.get(words, i + j) for j in range(k)])


def _every(words: Column, length: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(words) - length), lambda i: F.struct(F.lit(length).alias("class"), gram(words, i, length).alias("hash"), i.alias("pos")))


def with_fingerprints(df: DataFrame, words: str, lengths: list[int], span: int = SPAN, k: int = K) -> DataFrame:
    """Add ``kept``: (class, hash, pos) of the text's winnowed k-grams in class 0, and of all grams of each short length.

    Each step is a column of its own: an expression inside a lambda would be computed anew for every element.
    Callers use explode_outer: for explode, Spark adds a filter on the array's size that computes all of it once more.
    """
    n, window = F.size(words), span - k + 1
    none = F.expr("cast(array() as array<struct<class:int,hash:int,pos:int>>)")
    # Hash above, position below and counted downwards: the least is the least hash, the last of equals.
    packed = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.shiftleft(gram(F.col(words), i, k).cast("long"), 32) + (0x7FFFFFFF - i))
    df = df.withColumn("_packed", F.when(n >= span, packed))
    least = F.transform(F.sequence(F.lit(1), F.size("_packed") - (window - 1)), lambda i: F.array_min(F.slice("_packed", i, window)))
    df = df.withColumn("_least", F.when(F.col("_packed").isNotNull(), F.array_distinct(least)))
    winnowed = F.transform("_least", lambda x: F.struct(F.lit(0).alias("class"), F.shiftright(x, 32).cast("int").alias("hash"), (0x7FFFFFFF - F.pmod(x, F.lit(1 << 32))).cast("int").alias("pos")))
    lists = [F.coalesce(winnowed, none)]
    for length in lengths:
        lists.append(F.when(n >= length, _every(F.col(words), length)).otherwise(none))
    return df.withColumn("kept", F.concat(*lists) if len(lists) > 1 else lists[0]).drop("_packed", "_least")


def _windows(words: Column, item: Column, shift: Column, span: int) -> Column:
    """Starts in ``words`` of the item's windows that stand there at this relative position."""
    length = F.least(F.size(item), F.lit(span))
    first = F.greatest(F.lit(0), -shift)
    last = F.least(F.size(item), F.size(words) - shift) - length
    starts = F.when(last >= first, F.sequence(first, last)).otherwise(F.expr("cast(array() as array<int>)"))
    agree = F.filter(starts, lambda q: F.slice(words, q + shift + 1, length) == F.slice(item, q + 1, length))
    return F.flatten(F.transform(agree, lambda q: F.sequence(q + shift, q + shift + length - 1)))


def _met(docs: DataFrame, benchmark: DataFrame, space: Workspace, span: int, k: int, max_broadcast_rows: int) -> DataFrame:
    """key, met (item_id, item, shifts) of every text of ``docs`` (key, text) that shares fingerprints with items: the candidates."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), split_words(F.col("text").cast("string")).alias("item")).where("size(item) > 0").distinct()
    items = space.table(items.withColumn("item_key", F.xxhash64("item_id", "item")), "items")
    lengths = sorted(r[0] for r in items.select(F.size("item").alias("n")).where(F.col("n") < span).distinct().collect())  # fewer than span
    # A short item has one gram, in the class of its length; a long one its winnowed grams in class 0.
    of_items = with_fingerprints(items, "item", lengths, span, k).select("item_key", F.size("item").alias("length"), F.explode_outer("kept").alias("f")).select("item_key", "length", "f.*")
    of_items = space.table(of_items.where("class = 0 or class = length").select("item_key", "class", "hash", F.col("pos").alias("item_pos")), "test")
    of_docs = with_fingerprints(docs.select("key", split_words(F.col("text")).alias("words")), "words", lengths, span, k).select("key", F.explode_outer("kept").alias("f")).select("key", "f.*")
    small = of_items.count() <= max_broadcast_rows
    met = of_docs.join(F.broadcast(of_items) if small else of_items, ["class", "hash"])
    met = met.groupBy("key", "item_key").agg(F.collect_set(F.col("pos") - F.col("item_pos")).alias("shifts"))
    return space.table(met.join(items, "item_key").groupBy("key").agg(F.collect_list(F.struct("item_id", "item", "shifts")).alias("met")), "met")


def judge(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = K, max_broadcast_rows: int = MAX_BROADCAST_ROWS, count_all: bool = True) -> tuple[DataFrame, list[str]]:
    """The rows of ``docs`` with all their columns and n_words, n_hit and items behind them, and the names of these (with underscores before a name that is taken).

    A text's candidates are found by a hash of the text, so copies are looked up alike and rows need no id;
    hits are then confirmed on each row's own words. Without ``count_all``, only texts with candidates have
    their words counted: the others' n_words is null and their n_hit 0.

    Null and empty texts have no words, no hits and, as items, no windows. Repeated rows and repeated items
    are judged alike (items of one id count once); an item without an id is looked for like any other, but
    its hits name no item; an empty benchmark leaves everything clean; an empty table gives an empty result.
    """
    space = Workspace(docs.sparkSession, "winnow")
    own, key, met_, words_, hits_, *names = fresh(docs.columns, "_text", "_key", "_met", "_words", "_hits", "n_words", "n_hit", "items")
    text = F.col("text").cast("string")
    met = _met(docs.select(F.xxhash64(text).alias("key"), text.alias("text")), benchmark, space, span, k, max_broadcast_rows)
    found = docs.withColumn(key, F.xxhash64(text)).join(met.select(F.col("key").alias(key), F.col("met").alias(met_)), key, "left")
    split = split_words(text) if count_all else F.when(F.col(met_).isNotNull(), split_words(text))
    found = found.withColumn(words_, split)
    words = F.col(words_)
    # Hits by item: the words that its windows cover.
    hits = F.transform(F.col(met_), lambda m: F.struct(m["item_id"].alias("item_id"), F.array_distinct(F.flatten(F.transform(m["shifts"], lambda d: _windows(words, m["item"], d, span)))).alias("at")))
    found = found.withColumn(hits_, F.when(F.col(met_).isNotNull(), F.filter(hits, lambda h: F.size(h["at"]) > 0)))
    covered, none = F.size(F.array_distinct(F.flatten(F.col(f"{hits_}.at")))), F.col(hits_).isNull()
    return found.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.when(words.isNotNull(), F.size(words)).cast("long").alias(names[0]),
        F.when(none, 0).otherwise(covered).cast("long").alias(names[1]),
        F.when(none, F.expr("cast(array() as array<string>)")).otherwise(F.array_sort(F.array_distinct(F.array_compact(f"{hits_}.item_id")))).alias(names[2]),
    ), names


def find_contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids of items with windows that occur, sorted as strings) for every row of ``docs``; a null doc_id is kept and judged, other columns are ignored. Cases are those of ``judge``."""
    return judge(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, **options)[0].drop("text")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with ``docs``' own columns."""
    found, (n_words, n_hit, _) = judge(docs, benchmark, count_all=False, **options)
    return found.where(~contaminated(n_words, n_hit)).select(*[F.col(f"`{c}`") for c in docs.columns])


def contaminated(n_words: str = "n_words", n_hit: str = "n_hit") -> Column:
    """At least one word in twenty is hit."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))
