"""Answer reuse of keys with very many asks: expiry maps of time slices, composed as a tree.

What a slice of a key's asks does is a function: the expiry that is live before the slice goes in, the one that is live
after it comes out. An expiry at or before the slice's last ask lets the first ask from it on be computed, and where the
chain from there ends is known for each ask of the slice; a later expiry passes unchanged. As nothing goes
in that lies more than a TTL after the slice's first ask, only asks up to there (and one more) are part of the function: a task
holds the asks of one key within one TTL, which the caller bounds.
Functions of neighbouring slices compose. Groups of FAN of them are composed level by level until few are left; then
the entries are handed down again. The number of jobs grows with the logarithm of the rows, not with the time span.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from folioquery.session import materialize, run_folder

SLICE_ROWS = 1_000_000  # asks of a range
FAN = 64  # maps that one task composes
FILES_PER_SLICE = 64
SENT_KEYS = 100_000  # keys (with a small state each) that may be broadcast
NEVER = -(2**63)  # expiry before the first ask


def _reached(times: np.ndarray, ttl: int) -> np.ndarray:
    """For each ask as a computed one: the last ask computed in the slice after it, itself if there is none."""
    following = np.searchsorted(times, times + ttl, side="left")
    last = np.where(following < len(times), following, np.arange(len(times)))
    while True:
        further = last[last]
        if (further == last).all():
            return last
        last = further


def _apply(expires: np.ndarray, source: np.ndarray, breaks: np.ndarray, exits: np.ndarray, sources: np.ndarray, last: int) -> tuple:
    """Expiries and sources after a slice, of those before it."""
    at = np.minimum(np.searchsorted(breaks, expires, side="left"), len(breaks) - 1)
    passes = expires > last
    return np.where(passes, expires, exits[at]), np.where(passes, source, sources[at])


class _Maps:
    """Rows of (key, idx, breaks, exits, sources, last) in order of idx."""

    def __init__(self, table: pa.Table) -> None:
        table = table.sort_by("idx")
        self.idx = table.column("idx").to_pylist()
        lists = [table.column(n).combine_chunks() for n in ("breaks", "exits", "sources")]
        self.maps = [tuple(np.asarray(c[i].values) for c in lists) for i in range(len(table))]
        self.last = table.column("last").to_pylist()

    def entries(self, expires: int, source: Any) -> tuple[list[int], list]:
        """What goes into each slice, if this goes into the first."""
        before, sources = [], []
        for (breaks, exits, own), last in zip(self.maps, self.last, strict=True):
            before.append(expires)
            sources.append(source)
            if expires <= last:
                at = min(int(np.searchsorted(breaks, expires, side="left")), len(breaks) - 1)
                expires, source = int(exits[at]), own[at]
        return before, sources

    def composed(self, ttl: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """One function for all slices. What passes the first slices unchanged is broken by a later one."""
        breaks, exits, sources = self.maps[0]
        end, until = breaks[0] + ttl, self.last[0]
        for (own, own_exits, own_sources), last in zip(self.maps[1:], self.last[1:], strict=True):
            exits, sources = _apply(exits, sources, own, own_exits, own_sources, last)
            if until < end:
                new = slice(int(np.searchsorted(own, until, side="right")), int(np.searchsorted(own, end, side="right")) + 1)
                parts = ((breaks, own[new]), (exits, own_exits[new]), (sources, own_sources[new]))
                breaks, exits, sources = (np.concatenate(p) for p in parts)
            until = last
        return breaks, exits, sources, until


def reuse_by_slices(asks: DataFrame, ttl_seconds: int, slice_rows: int = SLICE_ROWS, fan: int = FAN) -> DataFrame:
    """asks(ask_id, key, ts) -> the same with `source_id`, as `reuse_within_ttl` defines it."""
    ttl = ttl_seconds * 1_000_000
    key_field, id_field = asks.schema["key"], asks.schema["ask_id"]
    long_ = T.LongType()
    sliced_schema = T.StructType([*asks.select("ask_id", "key", "ts").schema.fields, T.StructField("at", long_), T.StructField("idx", long_)])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for batch in batches:
            yield batch.append_column("idx", pa.array(np.full(batch.num_rows, part, np.int64)))

    placed = asks.select("ask_id", "key", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    n = max(1, -(-placed.count() // slice_rows))
    # Ranges of (key, time): a key's slices are neighbours, and none is larger than a range.
    ranged = placed.repartitionByRange(n, "key", "at", "ask_id")
    rows = materialize(ranged.mapInArrow(numbered, sliced_schema), "reuse-slices")
    n = 1 + (rows.agg(F.max("idx")).first()[0] or 0)

    map_schema = T.StructType(
        [
            key_field, T.StructField("idx", long_), T.StructField("breaks", T.ArrayType(long_)),
            T.StructField("exits", T.ArrayType(long_)), T.StructField("sources", T.ArrayType(id_field.dataType)), T.StructField("last", long_),
        ]
    )
    entry_schema = T.StructType([key_field, T.StructField("idx", long_), T.StructField("expires", long_), T.StructField("source", id_field.dataType)])
    arrow_map, arrow_entry = to_arrow_schema(map_schema), to_arrow_schema(entry_schema)

    def map_row(key: pa.Scalar, idx: int, breaks: np.ndarray, exits: np.ndarray, sources: np.ndarray, last: int) -> pa.Table:
        columns = [[key.as_py()], [idx], [breaks.tolist()], [exits.tolist()], [sources.tolist()], [last]]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow_map, strict=True)], schema=arrow_map)

    def map_of(table: pa.Table) -> pa.Table:
        table = table.sort_by([("at", "ascending"), ("ask_id", "ascending")])
        times, ids = table.column("at").to_numpy(), table.column("ask_id").to_numpy(zero_copy_only=False)
        last = _reached(times, ttl)
        domain = slice(0, int(np.searchsorted(times, times[0] + ttl, side="right")) + 1)
        # Equal times are one break, their first ask.
        breaks, first = np.unique(times[domain], return_index=True)
        ends = last[first]
        return map_row(table.column("key")[0], table.column("idx")[0].as_py(), breaks, times[ends] + ttl, ids[ends], int(times[-1]))

    def compose(table: pa.Table) -> pa.Table:
        maps = _Maps(table)
        return map_row(table.column("key")[0], maps.idx[0] // fan, *maps.composed(ttl))

    def entry_rows(key: pa.Scalar, maps: _Maps, expires: int, source: Any) -> pa.Table:
        before, sources = maps.entries(expires, source)
        sources = [s.item() if hasattr(s, "item") else s for s in sources]
        columns = [[key.as_py()] * len(before), maps.idx, before, sources]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow_entry, strict=True)], schema=arrow_entry)

    def from_the_start(table: pa.Table) -> pa.Table:
        return entry_rows(table.column("key")[0], _Maps(table), NEVER, None)

    def handed_down(above: pa.Table, table: pa.Table) -> pa.Table:
        return entry_rows(table.column("key")[0], _Maps(table), above.column("expires")[0].as_py(), above.column("source")[0].as_py())

    group = F.floor(F.col("idx") / fan).cast("long").alias("group")
    levels = [materialize(rows.select("ask_id", "key", "at", "idx").groupBy("key", "idx").applyInArrow(map_of, map_schema), "reuse-maps")]
    while n > fan:
        n = -(-n // fan)
        levels.append(materialize(levels[-1].groupBy("key", group).applyInArrow(compose, map_schema), "reuse-maps"))
    entries = levels[-1].groupBy("key").applyInArrow(from_the_start, entry_schema)
    for maps in reversed(levels[:-1]):
        above = materialize(entries, "reuse-entries").groupBy("key", "idx")
        entries = above.cogroup(maps.groupBy("key", group)).applyInArrow(handed_down, entry_schema)

    answered = T.StructType([*asks.select("ask_id", "key", "ts").schema.fields, T.StructField("source_id", id_field.dataType)])
    arrow_answered = to_arrow_schema(answered)

    def answer(own: pa.Table, entry: pa.Table) -> pa.Table:
        own = own.sort_by([("at", "ascending"), ("ask_id", "ascending")])
        times, ids = own.column("at").to_numpy(), own.column("ask_id").to_numpy(zero_copy_only=False)
        sources = ids.copy()
        at = int(np.searchsorted(times, entry.column("expires")[0].as_py(), side="left"))
        if at:
            sources[:at] = entry.column("source")[0].as_py()
        while at < len(ids):
            until = int(np.searchsorted(times, times[at] + ttl, side="left"))
            sources[at:until] = ids[at]
            at = until
        out = own.select(["ask_id", "key", "ts"]).append_column("source_id", pa.array(sources, arrow_answered.field("source_id").type))
        return out.cast(arrow_answered)

    entries = materialize(entries, "reuse-entries")
    return rows.groupBy("key", "idx").cogroup(entries.groupBy("key", "idx")).applyInArrow(answer, answered)


def reuse_by_rounds(asks: DataFrame, n_hot: int, ttl_seconds: int) -> DataFrame:
    """The same for keys with very many asks within one TTL, one time slice of TTL length after the other.

    A slice as long as the TTL holds at most one computed ask per key: the first one
    at or after the expiry carried into the slice. That is a minimum, which combines
    map-side however many asks the key has. The number of rounds depends on the time
    span, not on the rows, and each round reads its own slice only.
    """
    spark = asks.sparkSession
    ts_type = asks.schema["ts"].dataType
    ttl_micros = ttl_seconds * 1_000_000
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    placed = asks.withColumn("at", at).withColumn("slice", F.floor(at / ttl_micros))
    path = run_folder(spark, "asks-by-slice")
    # A slice is spread over several files, whatever its keys are.
    spread_out = placed.repartition("slice", F.pmod(F.xxhash64("ask_id"), F.lit(FILES_PER_SLICE)))
    spread_out.write.partitionBy("slice").parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path)

    states = run_folder(spark, "reuse-states")
    carried = spark.createDataFrame([], _state_schema(asks, "source", "expires"))
    slices = sorted(r["slice"] for r in placed.select("slice").distinct().collect())
    for number in slices:
        computed = (
            placed.where(F.col("slice") == number)
            .join((F.broadcast(carried) if n_hot <= SENT_KEYS else carried), "key", "left")
            .where(F.col("expires").isNull() | (F.col("at") >= F.col("expires")))
            .groupBy("key")
            .agg(F.min(F.struct("at", "ask_id")).alias("first"))
            .select("key", F.col("first.ask_id").alias("own_source"),
                    (F.col("first.at") + ttl_micros).alias("own_expires"))
        )
        state = carried.join(computed, "key", "full")
        state.write.parquet(f"{states}/slice={number}")
        state = spark.read.schema(state.schema).parquet(f"{states}/slice={number}")
        carried = state.select(
            "key", F.coalesce("own_source", "source").alias("source"),
            F.coalesce("own_expires", "expires").alias("expires"),
        )
    fields = _state_schema(asks, "source", "expires").fields + _state_schema(asks, "own_source", "own_expires").fields[1:]
    known = spark.read.schema(T.StructType([*fields, placed.schema["slice"]])).parquet(states)
    still_live = F.col("at") < F.col("expires")
    return placed.join(known, ["slice", "key"]).select(
        "ask_id", "key", F.col("ts").cast(ts_type).alias("ts"),
        F.when(still_live, F.col("source")).otherwise(F.col("own_source")).alias("source_id"),
    )


def _state_schema(asks: DataFrame, source: str, expires: str) -> T.StructType:
    return T.StructType(
        [
            asks.schema["key"],
            T.StructField(source, asks.schema["ask_id"].dataType),
            T.StructField(expires, T.LongType()),
        ]
    )
