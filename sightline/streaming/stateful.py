"""Stateful stream operators: token bucket and crawl queue cooldown."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.urls import BOOSTS


def token_bucket(stream: DataFrame, key: str, seconds: str, rate: float) -> DataFrame:
    """key, seconds, passed: a bucket for each key, kept between batches; rows of a batch are taken in order of time."""
    capacity = max(2 * rate, 1.0)

    def fold(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (capacity, None)
        rows = pd.concat(list(frames)).sort_values(seconds)
        passed = []
        for t in rows[seconds]:
            tokens, last = min(capacity, tokens + (t - (t if last is None else last)) * rate), t
            passed.append(tokens >= 1.0)
            tokens -= tokens >= 1.0
        state.update((float(tokens), float(last)))
        yield pd.DataFrame({key: group[0], seconds: rows[seconds].to_numpy(), "passed": passed})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, {seconds} double, passed boolean", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)


def queue_scores(stream: DataFrame, domain: str, seconds: str) -> DataFrame:
    """domain, seconds, score: priority and the domain's boost less what is left of the domain's cooldown since its last request."""
    def fold(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(seconds)
        scores = []
        for t, priority in zip(rows[seconds], rows["priority"]):
            scores.append(float(priority) + BOOSTS.get(group[0], 0) - (0.0 if last is None else max(0.0, 500.0 - (t - last) * 500.0 / 60.0)))
            last = t
        state.update((float(last),))
        yield pd.DataFrame({domain: group[0], seconds: rows[seconds].to_numpy(), "score": scores})

    kind = stream.schema[domain].dataType.simpleString()
    return stream.groupBy(domain).applyInPandasWithState(fold, f"{domain} {kind}, {seconds} double, score double", "last double", "append", GroupStateTimeout.NoTimeout)
