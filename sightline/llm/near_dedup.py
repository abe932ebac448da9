"""MinHash near-duplicate detection with sequential Bayesian verification.

Texts with equal shingle sets form classes; one of each goes on. Its signature is cut into bands, and
sharing a band's values makes two texts candidates. Buckets are not expanded into all their pairs:
every member is compared with its bucket's smallest id, and from then on only pairs of different
components are still open. Texts that share a pivot and are not yet of one component meet in blocks of
bounded size, where those pairs are compared and only links come out: no candidate pair of different
components stays untested, and no list of pairs is made.

A candidate pair is compared batch by batch of its signatures. With m of n values equal, the
similarity's posterior (uniform prior) is Beta(m + 1, n - m + 1); the pair is dropped as soon as the
probability of the wanted similarity is under MISS. Survivors are confirmed on their full sets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, fresh

HASHES, BATCH = 252, 36
#: Chance that two texts of just the wanted similarity share no band, and that a batch drops such a pair.
NO_BAND, MISS = 1e-5, 1e-6
#: Texts, and bytes of their sets, of a block.
BLOCK_TEXTS, BLOCK_BYTES = 2048, 16 << 20
#: Ids are sent to all tasks up to this many; beyond, texts are joined by shuffle.
MAX_BROADCAST_IDS = 2_000_000
#: Texts of equal 64-bit hashes that can be told apart by a second one.
MAX_CLASHES = 10_000


# ---- sets and signatures ----------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each text's distinct k-word shingles; of its whole sequence if it has fewer words, but some; else empty."""
    import xxhash

    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = lists.flatten().dictionary_encode()
    hashed = np.array([xxhash.xxh3_64_intdigest(w) if w else 0 for w in coded.dictionary.to_pylist()], dtype=np.uint64)
    filled = np.array([bool(w) for w in coded.dictionary.to_pylist()], dtype=bool)
    indices = coded.indices.to_numpy(zero_copy_only=False)
    bounds = lists.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    real = filled[indices] if len(indices) else np.zeros(0, dtype=bool)
    words = hashed[indices[real]] if len(indices) else hashed[:0]
    bounds = np.r_[0, np.cumsum(real)][bounds]
    value = np.full(max(0, len(words) - k + 1), k, dtype=np.uint64)
    for j in range(k if len(value) else 0):
        value = _mixed(value ^ words[j : j + len(value)])
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(value[a : b - k + 1]))
        elif b > a:
            whole = np.array([b - a], dtype=np.uint64)
            for w in words[a:b]:
                whole = _mixed(whole ^ w)
            out.append(whole)
        else:
            out.append(value[:0])
    return out


@lru_cache(maxsize=1)
def _functions() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20)
    return draw.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1), draw.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Least value of the set under each of HASHES permutations; in blocks, whatever the set's size."""
    a, b = _functions()
    x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 256):
        y = x[at : at + 256, None] * a
        y += b
        np.minimum(least, y.min(axis=0), out=least)
    return least


def band_rows(threshold: float) -> int:
    """Most rows of a band for which texts of the wanted similarity still share one."""
    return max(r for r in range(1, 13) if r == 1 or (1 - threshold**r) ** (HASHES // r) <= NO_BAND)


def least_equal(threshold: float) -> list[int]:
    """For each batch, the least number of equal values so far with which a pair goes on: P(Bin(n + 1, t) <= m) is the posterior of similarity t or more."""
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, -1
        while total < MISS:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def _signed(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column("text"), k)
            n = np.array([len(s) for s in sets], dtype=np.int64)
            h1 = np.array([s.sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64)
            h2 = np.array([_mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64)
            signs = pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(h1), pa.array(h2), signs], ["doc_id", "n_shingles", "h1", "h2", "sign"])

    return run


def _banded(rows: int):
    bands = HASHES // rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            signs = np.frombuffer(b"".join(batch.column("sign").to_pylist()), dtype=np.uint32).reshape(-1, HASHES)[:, : bands * rows].reshape(-1, bands, rows)
            key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), signs.shape[:2])
            for j in range(rows):
                key = _mixed(key ^ signs[:, :, j])
            ids = np.repeat(batch.column("doc_id").to_numpy(zero_copy_only=False), bands)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(ids)], ["key", "doc_id"])

    return run


def _pruned(least: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            left = np.arange(len(batch))
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint32).reshape(-1, HASHES) for c in ("sign_a", "sign_b"))
            equal = np.zeros(len(batch), dtype=np.int64)
            for i, need in enumerate(least):
                at = slice(i * BATCH, (i + 1) * BATCH)
                equal[left] += (one[left, at] == two[left, at]).sum(axis=1)
                left = left[equal[left] >= need]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(left)) for c in ("a", "b")], ["a", "b"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([s.tobytes() for s in shingle_sets(batch.column("text"), k)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sets], ["doc_id", "shingles"])

    return run


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist()):
                keep.append(similar(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), percent))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], ["a", "b"])

    return run


# ---- links and components ---------------------------------------------------------------------


def components(links: DataFrame, space: Workspace, name: str) -> DataFrame:
    """doc_id, component (the smallest id reachable) of every end of a link: each takes the least label around it, then its label's label, until none changes."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = space.table(both.distinct(), f"{name}-edges")
    labels, step = edges.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).select(F.col("a").alias("doc_id"), "label"), 0
    labels = space.table(labels, f"{name}-0")
    while True:
        around = edges.join(labels.select(F.col("doc_id").alias("b"), "label"), "b").groupBy(F.col("a").alias("doc_id")).agg(F.min("label").alias("least"))
        nearer = labels.join(around, "doc_id", "left").select("doc_id", F.col("label").alias("old"), F.least("label", "least").alias("label"))
        jumped = nearer.join(labels.select(F.col("doc_id").alias("label"), F.col("label").alias("far")), "label", "left")
        step += 1
        new = space.table(jumped.select("doc_id", "old", F.least("label", "far").alias("label")), f"{name}-{step}")
        changed = new.where("old <> label").limit(1).count()
        labels = new.select("doc_id", "label")
        if step > 1:
            space.drop(f"{name}-{step - 2}")
        if not changed:
            return labels.withColumnRenamed("label", "component")


def find_near_duplicates(docs: DataFrame, k: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``: similarity of ``percent`` or more in k-word shingles links two texts.

    Null and empty texts and texts of white space have no shingles and are linked with nothing. Rows
    of one doc_id are one document with several texts. A row without a doc_id is linked with nothing
    and kept, its component is null. An empty table gives an empty result. Other columns are ignored.
    """
    space = Workspace(docs.sparkSession, "near")
    threshold = percent / 100
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = space.table(texts.mapInArrow(_signed(k), "doc_id long, n_shingles long, h1 long, h2 long, sign binary"), "signed")
    same = ["h1", "h2", "n_shingles"]
    some = signed.where("n_shingles > 0 and doc_id is not null")
    classes = space.table(some.groupBy(*same).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")), "classes")
    copied = classes.where("copies > 1")
    firsts = classes.select(F.col("first").alias("doc_id"), *same)
    signs = space.table(some.join(firsts, ["doc_id", *same], "left_semi").select("doc_id", "sign"), "signs")
    bands = signs.mapInArrow(_banded(band_rows(threshold)), "key long, doc_id long")
    shared = bands.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("key")
    members = space.table(bands.join(shared, "key", "left_semi").distinct(), "members")

    links = _linked(members, signs, texts, space, k, percent)
    found = components(links, space, "components")
    # Copies follow the first of their class; two classes of one doc_id are joined by their id.
    own = space.table(some.join(copied, same).select(F.col("first").alias("a"), F.col("doc_id").alias("b")).where("a <> b").distinct(), "copies")
    ends = found.select(F.col("doc_id").alias("b")).union(own.select(F.col("a").alias("b")))
    if own.join(ends, "b", "left_semi").limit(1).count() or own.groupBy("b").count().where("count > 1").limit(1).count():
        found = components(links.union(own), space, "joined")  # an id of several texts
    else:
        first = own.join(found.select(F.col("doc_id").alias("a"), "component"), "a", "left").select(F.col("b").alias("doc_id"), F.coalesce("component", "a").alias("component"))
        found = found.union(first.groupBy("doc_id").agg(F.min("component").alias("component")))
        found = space.table(found, "found")
    result = signed.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return result.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _numbers(facts: DataFrame, space: Workspace) -> Callable[[DataFrame, Column, Column, Column, str], DataFrame]:
    """How rows get the numbers of their texts, by which duplicates are found: the doc_id, so that pivots are the earliest documents.

    Texts whose id is null or not theirs alone get a hash in its place (``key``; ``check``, a second one, where ``key`` is taken).
    """
    texts = facts.groupBy("id").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.min("check").alias("c"), F.max("check").alias("d"))
    odd = space.table(texts.where("id is null or a < b or c < d").select(F.col("id").alias("_odd"), F.lit(True).alias("_is_odd")), "odd")
    some = odd.count()
    if not some:
        return lambda rows, id_, key, check, name: rows.withColumn(name, id_)
    odd = F.broadcast(odd) if some <= MAX_BROADCAST_IDS else odd
    joined = facts.join(odd, F.col("id").eqNullSafe(F.col("_odd")), "left")
    held = space.table(joined.where("_is_odd").select("key", "check").distinct(), "odd-texts")
    own = joined.where("_is_odd is null").select(F.col("id").alias("key")).distinct()
    taken = held.groupBy("key").count().where("count > 1").select("key").union(held.select("key").join(own, "key", "left_semi")).distinct()
    keys = [r["key"] for r in taken.limit(MAX_CLASHES + 1).collect()]  # one is to be expected in 6 billion texts
    number = F.when(F.col("key").isin(keys), F.col("check")).otherwise(F.col("key"))
    if keys and (len(keys) > MAX_CLASHES or held.select(number.alias("key")).union(own).groupBy("key").count().where("count > 1").limit(1).count()):
        raise ValueError("too many texts have equal hashes")

    def numbered(rows: DataFrame, id_: Column, key: Column, check: Column, name: str) -> DataFrame:
        instead = F.when(key.isin(keys), check).otherwise(key) if keys else key
        return rows.join(odd, id_.eqNullSafe(F.col("_odd")), "left").withColumn(name, F.when(F.col("_is_odd"), instead).otherwise(id_)).drop("_odd", "_is_odd")

    return numbered


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with its own columns, without near-duplicates: of each group one row stays, that of the least doc_id (null last).

    Rows are judged by their text, whatever their ids: null and repeated ids do no harm. Null, empty and
    white texts are no duplicates; of such rows that are alike in a doc_id (not null) and text, one stays.
    """
    space = Workspace(docs.sparkSession, "near-rows")
    id_, key, flag, of, at = fresh(docs.columns, "_id", "_key", "_flag", "_of", "_at")
    text = F.col("text").cast("string")
    doc_id, hashes = F.col("doc_id").cast("long"), (F.xxhash64(text), F.xxhash64(F.lit(1), text))
    facts = space.table(docs.select(doc_id.alias("id"), hashes[0].alias("key"), hashes[1].alias("check")), "keys")
    numbered = _numbers(facts, space)
    columns = F.col("id"), F.col("key"), F.col("check")
    found = find_near_duplicates(numbered(docs.select(doc_id.alias("id"), hashes[0].alias("key"), hashes[1].alias("check"), text.alias("text")), *columns, "number").select(F.col("number").alias("doc_id"), "text"), k, percent)
    rows = numbered(facts, *columns, "number").groupBy("id", "key", "number").agg(F.count(F.lit(1)).alias("n"))
    judged = space.table(rows.join(found.select(F.col("doc_id").alias("number"), "n_shingles", "component_id").distinct(), "number"), "judged")
    own = F.struct(F.col("id").isNull().alias("last"), "id", "key")
    first = judged.where("n_shingles > 0").groupBy(F.col("component_id").alias("component")).agg(F.min(own).alias("first")).select("first.id", "first.key").withColumn("first", F.lit(True))
    # Gone is every other row of a group; rows that are wholly alike are thinned out to one.
    marked = judged.join(first.select(F.col("id").alias("of"), F.col("key").alias("at"), "first"), F.col("id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("at")), "left")
    gone = (F.col("n_shingles") > 0) & F.col("first").isNull()
    alike = (F.col("n") > 1) & (F.col("first").isNotNull() | F.col("id").isNotNull())
    verdict = space.table(marked.select(F.col("id").alias(of), F.col("key").alias(at), F.when(gone, 0).when(alike, 1).alias(flag)).where(F.col(flag).isNotNull()), "verdict")
    numbers = dict(verdict.groupBy(flag).count().collect())
    small = F.broadcast(verdict) if sum(numbers.values()) <= MAX_BROADCAST_IDS else verdict
    hashed = docs.withColumns({id_: doc_id, key: hashes[0]})
    joined = hashed.join(small, F.col(id_).eqNullSafe(F.col(of)) & (F.col(key) == F.col(at)), "left")
    kept = joined.where(F.col(flag).isNull())
    if numbers.get(1):
        kept = kept.unionByName(joined.where(F.col(flag) == 1).dropDuplicates([id_, key]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def _linked(members: DataFrame, signs: DataFrame, texts: DataFrame, space: Workspace, k: int, percent: int) -> DataFrame:
    """Confirmed links (a < b) that join all candidates that are joined at all."""
    pivots = members.groupBy("key").agg(F.min("doc_id").alias("pivot"))
    star = members.join(pivots, "key").where("doc_id <> pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b"))
    tested = space.table(star.distinct(), "star")
    links = _verified(tested, signs, texts, space, k, percent, "star")
    found = components(links, space, "first").withColumnRenamed("doc_id", "b")
    placed = tested.join(found, "b", "left").select("a", "b", F.coalesce("component", "b").alias("component"))
    placed = space.table(placed, "placed")
    split = space.table(placed.groupBy("a").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("a"), "split")
    rest = space.table(placed.join(_few(split), "a", "left_semi"), "rest")
    return links.union(_within(rest, signs, texts, space, k, percent))


def _few(rows: DataFrame) -> DataFrame:
    """Sent to all tasks if there are few enough, so that a pivot of very many texts is not gathered in one task."""
    return F.broadcast(rows) if rows.count() <= MAX_BROADCAST_IDS else rows


def _within(rest: DataFrame, signs: DataFrame, texts: DataFrame, space: Workspace, k: int, percent: int) -> DataFrame:
    """Links between components among texts that share a pivot: any two texts of a bucket do.

    A pivot's texts are dealt into blocks of bounded rows and bytes, and each two blocks meet in one
    task, where pairs of different components are compared and only links come out.
    """
    ids = space.table(rest.select(F.col("b").alias("doc_id")).distinct(), "rest-ids")
    wanted = F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids
    sets = texts.join(wanted, "doc_id", "left_semi").mapInArrow(_sets(k), "doc_id long, shingles binary")
    held = space.table(sets.join(signs, "doc_id"), "rest-sets", "uncompressed")
    own = rest.join(held.withColumnRenamed("doc_id", "b"), "b")
    sizes = rest.join(held.select(F.col("doc_id").alias("b"), F.length("shingles").alias("bytes")), "b").groupBy("a").agg(F.count(F.lit(1)).alias("rows"), F.sum("bytes").alias("bytes"))
    blocks = space.table(sizes.select("a", F.ceil(F.greatest(F.col("rows") / BLOCK_TEXTS, F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks")), "blocks")
    dealt = own.join(_few(blocks), "a").withColumn("block", F.pmod(F.hash("b"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("a", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "b", "component", "sign", "shingles")
    links = dealt.groupBy("a", "one", "two").applyInPandas(_met(least_equal(percent / 100), percent), "a long, b long")
    return space.table(links.distinct(), "rest-links")


def _met(least: list[int], percent: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["b", "component"], kind="stable")
        ids, sides = frame["b"].to_numpy(), frame["block"].to_numpy()
        signs = np.frombuffer(b"".join(frame["sign"]), dtype=np.uint32).reshape(-1, HASHES)
        sets = [np.frombuffer(x, dtype=np.uint64) for x in frame["shingles"]]
        sizes = np.array([len(x) for x in sets], dtype=np.int64)
        label = np.unique(frame["component"].to_numpy(), return_inverse=True)[1]
        one, two, out = frame["one"].iloc[0], frame["two"].iloc[0], []
        for x in range(len(ids) - 1):
            open_ = label[x + 1 :] != label[x]
            if one != two:
                open_ &= sides[x + 1 :] != sides[x]
            smaller, larger = np.minimum(sizes[x + 1 :], sizes[x]), np.maximum(sizes[x + 1 :], sizes[x])
            left = np.flatnonzero(open_ & (100 * smaller >= percent * larger)) + x + 1
            equal = np.zeros(len(ids), dtype=np.int64)
            for i, need in enumerate(least):
                at = slice(i * BATCH, (i + 1) * BATCH)
                equal[left] += (signs[left, at] == signs[x, at]).sum(axis=1)
                left = left[equal[left] >= need]
                if not len(left):
                    break
            for y in left.tolist():
                if label[x] != label[y] and ids[x] != ids[y] and similar(sets[x], sets[y], percent):
                    out.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
                    label[label == label[y]] = label[x]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def similar(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are, as a share of their union, alike enough."""
    small, large = (one, two) if len(one) <= len(two) else (two, one)
    if not len(large):
        return False
    both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(one) + len(two) - both)


def _verified(pairs: DataFrame, signs: DataFrame, texts: DataFrame, space: Workspace, k: int, percent: int, step: str) -> DataFrame:
    def with_both(pairs: DataFrame, what: DataFrame, column: str, short: str) -> DataFrame:
        one = pairs.join(what.select(F.col("doc_id").alias("a"), F.col(column).alias(f"{short}_a")), "a")
        return one.join(what.select(F.col("doc_id").alias("b"), F.col(column).alias(f"{short}_b")), "b")

    likely = space.table(with_both(pairs, signs, "sign", "sign").mapInArrow(_pruned(least_equal(percent / 100)), "a long, b long"), f"likely-{step}").distinct()
    ids = space.table(likely.select(F.col("a").alias("doc_id")).union(likely.select(F.col("b").alias("doc_id"))).distinct(), f"ids-{step}")
    wanted = F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids
    sets = space.table(texts.join(wanted, "doc_id", "left_semi").mapInArrow(_sets(k), "doc_id long, shingles binary"), f"sets-{step}", "uncompressed")
    links = space.table(with_both(likely, sets, "shingles", "set").mapInArrow(_confirmed(percent), "a long, b long").distinct(), f"links-{step}")
    space.drop(f"sets-{step}")
    return links
