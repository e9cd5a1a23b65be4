"""Cached query vectors: which lookups hit, miss and evict, from the lookups and their times alone.

A cache holds ``capacity`` queries, the least recently used goes first, and an entry
expires ``seconds`` after it was stored, however often it was hit since. Queries count by
``functions.text.cache_key``. The outcome of each lookup is ``hit``, ``miss`` or
``expired`` (a miss of an entry that was there, too old), with the query evicted for it.
Misses are what has to be embedded.

There is a cache for each value of a key. Batches and streams share the same steps: in a
batch, rows are dealt by key and sorted, and pass through one after another; in a
stream, a cache is the key's state. Memory is that of one cache however many lookups
a key has.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gleaner.functions import text as T

CAPACITY, SECONDS = 50, 3600
_STATE = "queries array<string>, stored array<double>"


def look_up(cache: OrderedDict[str, float], key: str, at: float, capacity: int, seconds: float) -> tuple[str, str | None]:
    """Outcome and evicted query of one lookup; the cache, oldest use first, changes."""
    stored = cache.get(key)
    if stored is not None and at - stored < seconds:
        cache.move_to_end(key)
        return "hit", None
    cache.pop(key, None)
    evicted = cache.popitem(last=False)[0] if len(cache) >= capacity else None
    cache[key] = at
    return "miss" if stored is None else "expired", evicted


def _prepared(lookups: DataFrame, key: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return lookups.where(F.col("query").isNotNull() & F.col("ts").isNotNull()).select(F.col(key).alias("cache"), T.cache_key(F.col("query")).alias("query"), at.alias("at"), F.col("seq").cast("long").alias("seq"))


def _schema(lookups: DataFrame, key: str) -> str:
    return f"cache {lookups.schema[key].dataType.simpleString()}, query string, seq long, outcome string, evicted string"


def cached_lookups(lookups: DataFrame, key: str, capacity: int = CAPACITY, seconds: float = SECONDS) -> DataFrame:
    """cache, query, seq, outcome, evicted of lookups (key, query, ts, seq), in order of ts and seq. Null queries and times are left out."""
    schema = _schema(lookups, key)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, cache = None, OrderedDict()
        for rows in frames:
            found = []
            for r in rows.itertuples(index=False):
                own = None if pd.isna(r.cache) else r.cache
                if own != owner:
                    owner, cache = own, OrderedDict()
                found.append((own, r.query, r.seq, *look_up(cache, r.query, r.at, capacity, seconds)))
            yield pd.DataFrame(found, columns=["cache", "query", "seq", "outcome", "evicted"])

    return _prepared(lookups, key).repartition("cache").sortWithinPartitions("cache", "at", "seq").mapInPandas(run, schema)


def stream_lookups(lookups: DataFrame, key: str, capacity: int = CAPACITY, seconds: float = SECONDS) -> DataFrame:
    """The same for a stream; within a micro-batch lookups are taken in order."""
    schema = _schema(lookups, key)

    def run(own: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["at", "seq"], kind="stable")
        cache = OrderedDict(zip(*map(list, state.get), strict=True)) if state.exists else OrderedDict()
        found = [(own[0], r.query, r.seq, *look_up(cache, r.query, r.at, capacity, seconds)) for r in rows.itertuples(index=False)]
        state.update((list(cache), list(cache.values())))
        yield pd.DataFrame(found, columns=["cache", "query", "seq", "outcome", "evicted"])

    return _prepared(lookups, key).groupBy("cache").applyInPandasWithState(run, schema, _STATE, "append", GroupStateTimeout.NoTimeout)


def misses(outcomes: DataFrame) -> DataFrame:
    """The distinct queries that have to be embedded."""
    return outcomes.where(F.col("outcome") != "hit").select("query").distinct()
