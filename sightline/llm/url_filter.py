"""URL rules and a Bloom filter cascade: exact membership of every key of a known universe, without joins.

Level 0 encodes the listed keys; level 1 the unlisted keys of the universe that level 0 takes for
listed; level 2 the listed keys that level 1 takes for unlisted; and so on until nothing is taken
wrongly. A key's answer follows from the first level that lacks it, so for keys of the universe it
is exact. Levels are filled where the keys are and merged bit by bit; a page is judged in the task
that read it, so a host with a third of all pages costs no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, ascii_lower

#: The filters are sent to every executor up to this size; the keys of a longer list are dealt to several cascades, each of which judges its own pages.
MAX_BYTES = 64 << 20
MAX_LEVELS = 64
#: Keys that a task reads when a level is filled: there are two passes for each level.
TASK_KEYS = 1 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that levels are independent of each other."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Level:
    number: int
    bits: int
    hashes: int
    words: np.ndarray

    def positions(self, h1: np.ndarray, h2: np.ndarray) -> list[np.ndarray]:
        salt = np.uint64((self.number + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        a, b = _mixed(h1 + salt), _mixed(h2 ^ salt) | np.uint64(1)
        return [(a + np.uint64(i) * b) % np.uint64(self.bits) for i in range(self.hashes)]

    def fill(self, h1: np.ndarray, h2: np.ndarray) -> None:
        for p in self.positions(h1, h2):
            np.bitwise_or.at(self.words, (p >> np.uint64(6)).astype(np.int64), np.uint64(1) << (p & np.uint64(63)))

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        found = np.ones(len(h1), dtype=bool)
        for p in self.positions(h1, h2):
            found &= (self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found


def empty_level(number: int, keys: int, rate: float) -> Level:
    bits = max(64, math.ceil(keys * -math.log(rate) / math.log(2) ** 2))
    return Level(number, bits, max(1, round(bits / keys * math.log(2))), np.zeros(-(-bits // 64), dtype=np.uint64))


@dataclass
class Cascade:
    levels: list[Level] = field(default_factory=list)

    def depth(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Levels that have the key, counted up to the first that lacks it."""
        depth, left = np.zeros(len(h1), dtype=np.int64), np.arange(len(h1))
        for level in self.levels:
            left = left[level.has(h1[left], h2[left])]
            depth[left] += 1
        return depth

    def listed(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        return self.depth(h1, h2) % 2 == 1

    @property
    def size(self) -> int:
        return sum(level.words.nbytes for level in self.levels)


def _hashes(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return tuple(frame[c].to_numpy(dtype=np.int64).view(np.uint64) for c in ("h1", "h2"))


def key_hashes(key: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), key).alias(name) for seed, name in ((11, "h1"), (23, "h2"))]


def _survivors(cascade: Cascade, listed: bool, fill: Level | None = None):
    """Keys of one kind that all levels so far have: their hashes, or the words that they set in a new level."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame[frame["listed"] == listed]
            h1, h2 = _hashes(frame)
            keep = cascade.depth(h1, h2) == len(cascade.levels)
            if fill is None:
                yield frame[keep][["h1", "h2"]]
            elif keep.any():
                fill.fill(h1[keep], h2[keep])
        if fill is not None:
            used = np.flatnonzero(fill.words)
            yield pd.DataFrame({"word": used, "bits": fill.words[used].view(np.int64)})

    return run


def build_cascade(universe: DataFrame) -> Cascade:
    """``universe``: h1, h2, listed for every distinct key, stored. The driver gets filter words only."""
    count = dict(universe.groupBy("listed").count().collect())
    cascade, listed = Cascade(), True
    if not count.get(True):
        return cascade
    rest = universe
    left = count[True]
    while left:
        number = len(cascade.levels)
        if number == MAX_LEVELS:
            raise ValueError("two different keys have the same 128 bits of hash")
        rate = min(0.5, max(1e-6, count[True] / max(1, count.get(False, 0)) * math.sqrt(0.5))) if number == 0 else 0.5
        level = empty_level(number, left, rate)
        words = rest.mapInPandas(_survivors(cascade, listed, level), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
        level.words[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64).view(np.uint64)
        cascade.levels.append(level)
        listed = not listed
        left = rest.mapInPandas(_survivors(cascade, listed), "h1 long, h2 long").count()
    return cascade


# ---- pages ------------------------------------------------------------------------------------


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without a ``://`` and for null."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, "^([^/?#]*)([^?#]*)", 1)), F.regexp_extract(rest, "^([^/?#]*)([^?#]*)", 2)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        own, _, start = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _judged(cascade: Cascade):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.drop(columns=["h1", "h2"]).assign(listed=cascade.listed(*_hashes(frame)))

    return run


def judge_urls(pages: DataFrame, listed_hosts: DataFrame, rules: Sequence[tuple[str, str]], max_bytes: int = MAX_BYTES) -> DataFrame:
    """page_id, host, path, rule, verdict for every page: the longest fitting rule's verdict, else ``block`` if the host is listed.

    ``listed_hosts`` has one column, host; hosts outside the corpus, nulls and repeats in it do no
    harm. A null url and one without ``://`` have an empty host and path, judged like any other host.
    Repeated rows are judged alike; an empty table gives an empty result; other columns are ignored.
    """
    space = Workspace(pages.sparkSession, "urls")
    host, path = url_parts(pages["url"].cast("string"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    wanted = listed_hosts.select(F.col(listed_hosts.columns[0]).cast("string").alias("host")).where("host is not null").distinct().withColumn("listed", F.lit(True))
    # Every key of the corpus, and whether it is listed; the listed ones of elsewhere fall away.
    keys = parts.select("host", F.lit(False).alias("listed"), F.lit(True).alias("here")).unionByName(wanted.select("host", "listed", F.lit(False).alias("here")))
    keys = keys.groupBy("host").agg(F.bool_or("listed").alias("listed"), F.bool_or("here").alias("here")).where("here")
    universe = space.table(keys.select(*key_hashes(F.col("host")), "listed"), "keys")
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    parts = parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), *key_hashes(F.col("host")))
    every, listed = universe.agg(F.count(F.lit(1)), F.count_if("listed")).head()
    universe = universe.coalesce(max(1, math.ceil(every / TASK_KEYS)))
    # 32 bits a listed key are more than the levels take together.
    several = max(1, math.ceil(listed * 4 / max(1, max_bytes)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema if f.name not in ("h1", "h2"))
    own = F.pmod(F.col("h2"), F.lit(several))
    judged = None
    for part in range(several):
        cascade = build_cascade(universe.where(own == part))
        some = parts.where(own == part).mapInPandas(_judged(cascade), f"{schema}, listed boolean")
        judged = some if judged is None else judged.unionByName(some)
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))
