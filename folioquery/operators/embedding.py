"""Embedding of texts: a built-in feature-hashing model and user models."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioquery.functions.keys import embedding_key
from folioquery.functions.isolation import call_isolated
from folioquery.functions.text import CONTROL_CHARACTERS, clean_text, terms_text, words

DEFAULT_WIDTH = 256
HASH_MODEL = "feature-hash"
STEP_BYTES = 2 * 1024 * 1024  # dense rows that one task holds at a time; their words take some ten times as much
MEMO_WORDS = 200_000  # words whose features a task remembers
MODEL_BATCH = 256  # texts per call of a user model
EMPTY_TEXT_ERROR = "text is empty after preprocessing"

Embedder = Callable[[list[str]], Sequence[Sequence[float]]]


def spoken_text(text: Column) -> Column:
    """The terms of a text, by blanks: its lower-cased runs of letters, marks and digits.

    The words of the chunks end at white space only and keep their marks; here "honey?" and "honey" are the same.
    """
    return terms_text(F.regexp_replace(text, CONTROL_CHARACTERS, ""))


def hash_embed_sparse(df: DataFrame, keys: list[str], text: str, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Signed feature hashing in long form: (keys, bucket, value), zeros left out.

    Bucket and sign come from the MD5 of a word: its first eight hex digits modulo
    the width, and the upper or lower half of the ninth digit. Partial sums are
    complete per input row, so the exchange carries at most `width` rows per text;
    on data partitioned by one of the keys there is no exchange at all.
    """
    digest = F.md5("word")
    return (
        df.select(*keys, F.explode(words(spoken_text(F.col(text)))).alias("word"))
        .select(
            *keys,
            (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % width).cast("int").alias("bucket"),
            F.when(F.substring(digest, 9, 1) < "8", F.lit(1)).otherwise(F.lit(-1)).alias("sign"),
        )
        .groupBy(*keys, "bucket")
        .agg(F.sum("sign").alias("value"))
        .where("value <> 0")
    )


class _Features(dict):
    """Word -> signed bucket (bucket + 1, negated for the second sign); a bounded memo."""

    def __init__(self, width: int):
        super().__init__()
        self.width = width

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        digest = hashlib.md5(word.encode("utf-8")).hexdigest()
        bucket = int(digest[:8], 16) % self.width + 1
        self[word] = feature = bucket if digest[8] < "8" else -bucket
        return feature


def _slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def _list_rows(matrix: np.ndarray, missing: np.ndarray | None = None) -> pa.ListArray:
    """Matrix rows as an Arrow list column of floats."""
    offsets = pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1])
    values = pa.array(matrix.astype(np.float32).ravel())
    return pa.ListArray.from_arrays(offsets, values, mask=None if missing is None else pa.array(missing))


def hash_embed(df: DataFrame, text: str, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Dense unit vectors of the same model, appended as `vector` (NULL for blank texts).

    Runs over Arrow batches without any shuffle: a text is hashed where it lies.
    The text column itself does not leave the scan side again.
    """
    kept = [c for c in df.columns if c != text]
    prepared = df.select(*kept, spoken_text(F.col(text)).alias("_text"))
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField("vector", T.ArrayType(T.FloatType()))])

    rows_per_step = max(1, STEP_BYTES // (8 * width))

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = _Features(width)
        for batch in (part for whole in batches for part in _slices(whole, rows_per_step)):
            texts = batch.column("_text").to_pylist()
            spoken = [[features[word] for word in text.split()] if text else [] for text in texts]
            signed = np.array([f for row in spoken for f in row], dtype=np.int64)
            rows = np.repeat(np.arange(len(texts)), [len(row) for row in spoken])
            cells = rows * width + np.abs(signed) - 1
            sums = np.bincount(cells, weights=np.sign(signed), minlength=len(texts) * width)
            matrix = sums.reshape(len(texts), width)
            lengths = np.sqrt((matrix * matrix).sum(axis=1))
            blank = np.array([not row for row in spoken], dtype=bool)
            lengths[lengths == 0] = 1.0
            vectors = _list_rows(matrix / lengths[:, None], blank)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + [vectors], names=[*kept, "vector"]
            )

    return prepared.mapInArrow(embed, schema)


def _no_vector(vector: Sequence[float] | None) -> str | None:
    return None if vector is not None and len(vector) else "the embedding model returned no vector"


def _unit(vector: Sequence[float]) -> np.ndarray:
    values = np.asarray(vector, dtype=np.float64)
    return (values / (np.sqrt((values * values).sum()) or 1.0)).astype(np.float32)


def embed_texts(
    df: DataFrame, embed_fn: Embedder, key: str, text: str, keep: tuple[str, ...] = (), batch_size: int = MODEL_BATCH,
    isolate: bool = False,
) -> DataFrame:
    """Run a user model over cleaned texts in Arrow batches: (key, *keep, vector).

    Blank texts are dropped; a model that returns another number of vectors than
    it got texts fails the task. Rows stay attached to their key. Vectors are
    L2-normalised, zero vectors are left as they are. With `isolate` a text that the model
    fails on gets no vector but an `error`, and does not fail the others.
    """
    carried = [key, *keep]
    prepared = df.select(*carried, clean_text(F.col(text)).alias("_text")).where("_text <> ''")
    schema = T.StructType([df.schema[c] for c in carried] + [T.StructField("vector", T.ArrayType(T.FloatType()))])
    if isolate:
        schema = schema.add("error", T.StringType())

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _slices(whole, batch_size)):
            if isolate:
                tried = call_isolated(embed_fn, batch.column("_text").to_pylist(), _no_vector)
                vectors = [None if v is None else _unit(v) for v, _ in tried]
                results = [pa.array(vectors, pa.list_(pa.float32())), pa.array([e for _, e in tried], pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in carried] + results, names=schema.names)
                continue
            matrix = np.asarray(embed_fn(batch.column("_text").to_pylist()), dtype=np.float64)
            if len(matrix) != batch.num_rows:
                raise ValueError(f"expected {batch.num_rows} embeddings, got {len(matrix)}")
            lengths = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
            lengths[lengths == 0] = 1.0
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in carried] + [_list_rows(matrix / lengths)], names=schema.names
            )

    return prepared.mapInArrow(embed, schema)


def embed_chunks(
    enriched: DataFrame,
    width: int = DEFAULT_WIDTH,
    embed_fn: Embedder | None = None,
    model: str = HASH_MODEL,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """chunks(chunk_id, document_id, enriched) -> embeddings(chunk_id, document_id, *keep, vector, model)."""
    carried = ["chunk_id", "document_id", *keep]
    if embed_fn is None:
        vectors = hash_embed(enriched.select(*carried, "enriched"), "enriched", width).where("vector IS NOT NULL")
    else:
        vectors = embed_texts(enriched, embed_fn, "chunk_id", "enriched", tuple(carried[1:]))
    return vectors.select(*carried, "vector", F.lit(model).alias("model"))


def embed_questions(questions: DataFrame, text: str = "question", width: int = DEFAULT_WIDTH) -> DataFrame:
    """Append `vector` and `error`; a question that is blank after cleaning has no vector."""
    embedded = hash_embed(questions.withColumn("_source", F.col(text)), "_source", width)
    return embedded.withColumn("error", F.when(F.col("vector").isNull(), F.lit(EMPTY_TEXT_ERROR)))


def embed_once(df: DataFrame, key: str, text: str, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Embed every distinct text once and fan the vector back out to all its rows.

    `embed` maps (text_key, text) to (text_key, vector). The distinct step combines
    map-side; in the fan-out the vectors are unique per key, so adaptive execution
    can split a text that a large share of the rows carries.
    """
    keyed = df.withColumn("text_key", embedding_key(F.col(text)))
    distinct = keyed.groupBy("text_key").agg(F.any_value(text).alias("text"))
    vectors = embed(distinct)
    return keyed.select(key, "text_key").join(vectors, "text_key", "left")


def embedding_width_violations(embeddings: DataFrame, width: int, vector: str = "vector") -> DataFrame:
    """Rows whose vector does not have the declared width."""
    actual = F.coalesce(F.size(vector), F.lit(-1))
    return embeddings.where(actual != width)
