"""Continuous stages: parse (documents -> chunks), analyse (-> tables), answer reuse."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from folioquery.operators.chunking import (
    DEFAULT_MAX_WORDS,
    DEFAULT_OVERLAP,
    analyze_payloads,
    chunk_documents,
)
from folioquery.operators.reuse import NEVER
from folioquery.plans.analyze import analyze_documents
from folioquery.session import spread
from folioquery.sources.store import save_tables

STATE_FOLDERS = 16  # micro-batches whose entries of answer reuse are read together


def read_file_stream(
    spark: SparkSession, folder: str, schema: T.StructType | str, pattern: str = "*.parquet", files_per_batch: int = 1000
) -> DataFrame:
    """Parquet files as they appear in a folder."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.option("pathGlobFilter", pattern).parquet(folder)


def read_table_stream(spark: SparkSession, folder: str, name: str, schema: T.StructType | str) -> DataFrame:
    """A table of a folder as a stream, whether it is one file or a folder of part files."""
    # A pattern may name files and folders alike; a plain path must be a folder.
    path = f"{folder.rstrip('/')}/{name}.parque[t]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(path)


def run_to_end(writer, target: str) -> StreamingQuery:
    """Start a query that takes everything available and stops; progress lives next to the output."""
    query = writer.option("checkpointLocation", f"{target}/_progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def parse_stage(
    documents: DataFrame, target: str, max_words: int = DEFAULT_MAX_WORDS, overlap: int = DEFAULT_OVERLAP
) -> StreamingQuery:
    """Chunk arriving documents and hand each one over as an analyse task.

    The chunks are the same narrow expression as in batch. The folders of a
    micro-batch are named by its id and replaced when the batch is run again; its
    tasks are written after its chunks, so a task never precedes what it names.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        chunks_path = f"{target}/chunks/batch={batch_id}"
        chunk_documents(spread(batch), max_words, overlap).write.mode("overwrite").parquet(chunks_path)
        stored = batch.sparkSession.read.parquet(chunks_path)
        tasks = analyze_payloads(stored.select("chunk_id", "document_id", "ord"), batch)
        tasks.withColumn("task_type", F.lit("analyze")).write.mode("overwrite").parquet(
            f"{target}/tasks/batch={batch_id}"
        )

    return run_to_end(documents.writeStream.foreachBatch(save), target)


def analyze_stage(documents: DataFrame, target: str, **options: Any) -> StreamingQuery:
    """Write chunks, summaries, embeddings and final statuses of each micro-batch.

    The folder of a micro-batch is named by its id and replaced when the batch is
    run again, so a restart neither loses nor repeats rows.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        save_tables(analyze_documents(spread(batch), **options), f"{target}/tables", str(batch_id))

    return run_to_end(documents.writeStream.foreachBatch(save), target)


def _reuse(ttl_seconds: int, names: list[str]) -> Callable:
    """Walk over rows sorted by (key, asked, at, ask_id): the entries of earlier micro-batches (ask_id and at are their source
    and expiry), then the asks of a key."""
    ttl = ttl_seconds * 1_000_000

    def reuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = expires = source = None
        begun = False  # a NULL key is a key like others
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, ids = batch.column("key"), batch.column("ask_id")
            codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
            starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            times, asked = batch.column("at").to_pylist(), batch.column("asked").to_pylist()
            # Sources by place: 0 is the one that came from the batch before, then the rows.
            own, expiries, answered_by = None, [0] * len(times), [0] * len(times)
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(times)], strict=True):
                at = start
                if begun and start == 0 and keys[0].as_py() == key:  # continues the last key
                    own = 0
                else:
                    own = expires = None
                while at < end and not asked[at]:  # the last one expires last
                    own, expires, at = at + 1, times[at], at + 1
                if own is not None:
                    until = bisect_left(times, expires, at, end)
                    answered_by[at:until], expiries[at:until] = [own] * (until - at), [expires] * (until - at)
                    at = until
                while at < end:
                    own, expires = at + 1, times[at] + ttl
                    until = max(bisect_left(times, expires, at, end), at + 1)
                    answered_by[at:until], expiries[at:until] = [own] * (until - at), [expires] * (until - at)
                    at = until
            sources = pa.concat_arrays([pa.array([source], ids.type), ids])
            key, source, begun = keys[-1].as_py(), sources[own].as_py(), True
            columns = [ids, keys, batch.column("ts"), sources.take(pa.array(answered_by)), pa.array(expiries, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(batch.column("asked"))

    return reuse


def reuse_stage(asks: DataFrame, target: str, ttl_seconds: int) -> StreamingQuery:
    """Answer reuse on a stream of asks(ask_id, key, ts); the answers also have `expires`, when what answered them does, in microseconds.

    State per key: expiry and source of the last answer, two values that are kept for every key. Every ask gets a row: there is no
    watermark, so none is late. Inside a micro-batch the asks of a key are sorted by time; one that
    arrives in a later micro-batch than newer asks is answered from the entry that is live
    on its arrival.

    The entries and the asks of a micro-batch meet in one shuffle by key and are walked in Arrow batches, so neither the
    number of keys nor the asks of one key are held. The entries that a micro-batch leaves go to a folder of its id, next to its answers,
    every STATE_FOLDERS-th time with all others. A later entry of a key always expires later, so the one that expires last holds.
    A micro-batch that is run again reads the folders before its own and replaces its own.
    """
    id_field = asks.schema["ask_id"]
    placed = asks.select("ask_id", "key", F.col("ts").cast("timestamp").alias("ts"))
    schema = T.StructType([*placed.schema.fields, T.StructField("source_id", id_field.dataType), T.StructField("expires", T.LongType())])
    entry_schema = T.StructType([asks.schema["key"], T.StructField("at", T.LongType()), id_field])

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        first = max(batch_id - 1, 0) // STATE_FOLDERS * STATE_FOLDERS
        folders = [f"{target}/state/batch={n}" for n in range(first, batch_id)]
        before = spark.read.schema(entry_schema).parquet(*folders) if folders else spark.createDataFrame([], entry_schema)
        rows = batch.withColumns({"at": F.coalesce(F.unix_micros("ts"), F.lit(NEVER)), "asked": F.lit(True)})
        rows = rows.unionByName(before.withColumn("asked", F.lit(False)), allowMissingColumns=True)
        ordered = rows.select("key", "asked", "at", "ask_id", "ts").repartition("key").sortWithinPartitions("key", "asked", "at", "ask_id")
        answered = ordered.mapInArrow(_reuse(ttl_seconds, schema.names), schema)
        answers = f"{target}/answers/batch={batch_id}"
        answered.write.mode("overwrite").parquet(answers)
        left = spark.read.schema(schema).parquet(answers).select("key", F.col("expires").alias("at"), F.col("source_id").alias("ask_id"))
        if batch_id % STATE_FOLDERS == 0:
            left = left.unionByName(before)
        newest = left.groupBy("key").agg(F.max(F.struct("at", "ask_id")).alias("entry")).select("key", "entry.*")
        newest.write.mode("overwrite").parquet(f"{target}/state/batch={batch_id}")

    return run_to_end(placed.writeStream.foreachBatch(save), target)
