"""Result and embedding caches as tables, and answer reuse over an ask log."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioquery.operators.maintenance import upsert
from folioquery.operators.reuse import FAN, SENT_KEYS, SLICE_ROWS, reuse_by_rounds, reuse_by_slices
from folioquery.session import materialize

# --- fixed values -----------------------------------------------------------
DEFAULT_TTL_SECONDS = 24 * 60 * 60
# -----------------------------------------------------------------------------
HOT_ROWS = 5_000_000  # asks of one key that one task may walk through
DENSE_ROWS = 5_000_000  # asks of one key within one TTL that one task may hold


def seconds(n: int) -> Column:
    return F.make_dt_interval(secs=F.lit(n))


def cache_entries(results: DataFrame, ttl_seconds: int = DEFAULT_TTL_SECONDS) -> DataFrame:
    """results(key, ..., written_at) with `expires_at`. The time starts at the write."""
    return results.withColumn("expires_at", F.col("written_at") + seconds(ttl_seconds))


def write_cache(cache: DataFrame, results: DataFrame, ttl_seconds: int = DEFAULT_TTL_SECONDS) -> DataFrame:
    """The cache after the writes: one entry per key, the last write wins."""
    return upsert(cache, cache_entries(results, ttl_seconds), ["key"], "written_at")


def _of_requests(cache: DataFrame, requests: DataFrame) -> DataFrame:
    """The entries some request asks for; a short batch of requests does not move a large cache."""
    return cache.join(requests.select("key").distinct(), "key", "left_semi")


def lookup(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """requests(key, asked_at) with the columns of a live entry, or NULLs.

    The cache holds one entry per key. Reading does not prolong an entry.
    """
    live = (F.col("asked_at") >= F.col("written_at")) & (F.col("asked_at") < F.col("expires_at"))
    joined = requests.join(_of_requests(cache, requests), "key", "left")
    joined = joined.withColumn("cached", F.coalesce(live, F.lit(False)))
    entry = [c for c in cache.columns if c != "key"]
    return joined.withColumns({c: F.when(F.col("cached"), F.col(c)) for c in entry})


def misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests without a live entry."""
    r, c = requests.alias("r"), _of_requests(cache.select("key", "written_at", "expires_at"), requests).alias("c")
    live = (
        (F.col("r.key") == F.col("c.key"))
        & (F.col("r.asked_at") >= F.col("c.written_at"))
        & (F.col("r.asked_at") < F.col("c.expires_at"))
    )
    return r.join(c, live, "left_anti")


def invalidate(cache: DataFrame, documents: DataFrame, drop_all: bool = False) -> DataFrame:
    """Remove the entries that used one of the documents, or all of them."""
    if drop_all:
        return cache.where(F.lit(False))
    touched = (
        cache.select("key", F.explode("document_ids").alias("document_id"))
        .join(documents.select("document_id"), "document_id", "left_semi")
        .select("key")
    )
    return cache.join(touched, "key", "left_anti")


# --- answer reuse -------------------------------------------------------------


def _walk(ttl_seconds: int):
    """Fold over asks sorted by (key, ts): an ask is computed or reuses the live answer."""
    ttl = ttl_seconds * 1_000_000

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = expires = source = None
        begun = False  # a NULL key is a key like others
        for batch in batches:
            if batch.empty:
                continue
            keys, ids = batch["key"].to_numpy(), batch["ask_id"].to_numpy()
            ts = batch["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
            answered_by = np.empty_like(ids)
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            for start, end in zip(starts, np.r_[starts[1:], len(keys)]):
                at = start
                if begun and keys[start] == key:  # continues the last key of the batch before
                    at = start + np.searchsorted(ts[start:end], expires)
                    answered_by[start:at] = source
                key, begun = keys[start], True
                while at < end:
                    source, expires = ids[at], ts[at] + ttl
                    until = at + np.searchsorted(ts[at:end], expires)
                    answered_by[at:until] = source
                    at = until
            yield batch.assign(source_id=answered_by)

    return walk


def reuse_within_ttl(
    asks: DataFrame, ttl_seconds: int = DEFAULT_TTL_SECONDS, hot_rows: int = HOT_ROWS, slice_rows: int = SLICE_ROWS, fan: int = FAN,
    dense_rows: int = DENSE_ROWS,
) -> DataFrame:
    """asks(ask_id, key, ts) with `source_id` (the ask that computed the answer) and `reused`.

    The first ask of a key is computed; it answers every later ask before
    its time plus TTL; the next one after that is computed again. Keys of usual size
    are walked in time order, each in one task and in Arrow batches. Keys above
    `hot_rows` are cut into time slices that many tasks work on (`operators/reuse.py`), with the same result.
    What such a task holds grows with the asks within one TTL; keys with more than `dense_rows` of them go
    from one TTL to the next instead, a distributed minimum each.
    """
    asks = asks.select("ask_id", "key", "ts")
    schema = T.StructType([*asks.schema.fields, T.StructField("source_id", asks.schema["ask_id"].dataType)])
    window = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (ttl_seconds * 1_000_000)).alias("window")
    counted = asks.groupBy("key", window).agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.max("n").alias("dense"))
    # At most rows / hot_rows keys can be hot: a short list, written once.
    hot = counted.where(F.col("n") > hot_rows).select(F.col("key").alias("_hot"), (F.col("dense") > dense_rows).alias("dense"))
    hot = materialize(hot, "hot-keys")
    numbers = {r["dense"]: r["count"] for r in hot.groupBy("dense").count().collect()}
    is_hot = F.col("key").eqNullSafe(F.col("_hot"))  # a NULL key is a key like others
    usual = asks.join(hot, is_hot, "left_anti") if numbers else asks
    walked = usual.repartition("key").sortWithinPartitions("key", "ts", "ask_id").mapInPandas(
        _walk(ttl_seconds), schema
    )
    for dense, n in numbers.items():
        keys = hot.where("dense" if dense else "NOT dense")
        own = asks.join(F.broadcast(keys) if n <= SENT_KEYS else keys, is_hot, "left_semi")
        found = reuse_by_rounds(own, n, ttl_seconds) if dense else reuse_by_slices(own, ttl_seconds, slice_rows, fan)
        walked = walked.unionByName(found)
    return walked.withColumn("reused", F.col("ask_id") != F.col("source_id"))
