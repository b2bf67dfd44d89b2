"""Helpers that several operators share: reading, Arrow batches, packed blocks of documents."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.session import materialize

BLOCK_CHARS = 12_000_000  # characters of text in one packed block; a longer text is a block of its own
BATCH_ROWS = 1000
BATCH_BYTES = 32 * 1024 * 1024


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents; Arrow batches of the session are bounded by rows and bytes for long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return read(spark, folder, "documents")


def whole_text(name: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts, the measure by which partition counts are chosen."""
    return int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def share(spark: SparkSession, value: object) -> Callable[[], object]:
    """Send a value of bounded size to the tasks; the result gives it there, on executors without this package too."""
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(shared.value)


def stable(docs: DataFrame) -> DataFrame:
    """The rows such that every read gives the same ones in the same order.

    A scan of files, filtered and projected, is read as it is. Anything else, above all rows that come from a
    shuffle, is written once.
    """

    def plain(node) -> bool:
        kind, children = node.getClass().getSimpleName(), node.children()
        if kind in ("Project", "Filter"):
            return node.deterministic() and plain(children.apply(0))
        return kind == "LogicalRelation"

    return docs if plain(docs._jdf.queryExecution().optimizedPlan()) else materialize(docs, "stable-input")


def squeeze(value: object) -> bytes:
    """Any plain value (lists, strings, numpy arrays) as compressed bytes."""
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(value, protocol=5))


def unsqueeze(blob: bytes) -> object:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def blocks(batches: Iterable[pa.RecordBatch], chars: int = BLOCK_CHARS) -> Iterator[tuple[int, list, list[str]]]:
    """Cut the rows (doc_id, text) of a task into blocks: (block id, doc ids, texts).

    The block id is a hash of the content, so two passes over the same rows in the same order (`stable`) name the same
    blocks, wherever and however often they run; equal ids mean equal content.
    """
    ids: list = []
    texts: list[str] = []
    held = 0

    def block() -> tuple[int, list, list[str]]:
        content = xxhash.xxh64(repr(ids).encode())
        for text in texts:
            content.update(text.encode())
            content.update(b"\xff")
        return content.intdigest() - 2**63, ids, texts

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = text or ""
            if texts and held + len(text) > chars:
                yield block()
                ids, texts, held = [], [], 0
            ids.append(doc_id)
            texts.append(text)
            held += len(text)
    if texts:
        yield block()


def slices(texts: list[str], chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about `chars` characters, one text at least."""
    start = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text) > chars:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


def pack_documents(docs: DataFrame) -> DataFrame:
    """(block, docs BINARY): the documents in compressed blocks, for one cheap shuffle."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, texts in blocks(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([squeeze((ids, texts))], pa.binary())], ["block", "docs"]
            )

    return docs.select("doc_id", "text").mapInArrow(pack, "block long, docs binary")
