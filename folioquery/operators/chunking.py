"""Overlapping word windows over documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioquery.functions.keys import chunk_id
from folioquery.functions.text import words

# --- fixed values -----------------------------------------------------------
DEFAULT_MAX_WORDS = 400
DEFAULT_OVERLAP = 80
# -----------------------------------------------------------------------------


def window_options(max_words: int, overlap: int) -> tuple[int, int]:
    """Effective (size, step) of the windows."""
    size = max_words if max_words > 0 else DEFAULT_MAX_WORDS
    step = size - max(overlap, 0)
    return size, step if step > 0 else size


def word_windows(text: Column, max_words: int, overlap: int) -> Column:
    """Array of (ord, text, token_count); NULL for a text without words.

    The number of windows follows from the word count, so no window consists of
    overlap only. The word array is bound once per row (outer transform) and is not
    copied into every exploded row, which keeps long documents linear.
    """
    size, step = window_options(max_words, overlap)

    def cut(ws: Column) -> Column:
        n = F.size(ws)
        last = F.ceil(F.greatest(n - size, F.lit(0)) / step).cast("int")
        return F.when(
            n > 0,
            F.transform(
                F.sequence(F.lit(0), last),
                lambda i: F.struct(
                    i.alias("ord"),
                    F.array_join(F.slice(ws, i * step + 1, size), " ").alias("text"),
                    F.least(F.lit(size), n - i * step).alias("token_count"),
                ),
            ),
        )

    return F.element_at(F.transform(F.array(words(text)), cut), 1)


def chunk_documents(
    documents: DataFrame,
    max_words: int = DEFAULT_MAX_WORDS,
    overlap: int = DEFAULT_OVERLAP,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """documents(document_id, content) -> chunks. Narrow: no shuffle."""
    cut = documents.select(
        "document_id", *keep, F.explode(word_windows(F.col("content"), max_words, overlap)).alias("w")
    )
    return cut.select(
        chunk_id(F.col("document_id"), F.col("w.ord")).alias("chunk_id"),
        "document_id",
        F.col("w.ord").alias("ord"),
        F.col("w.text").alias("text"),
        F.col("w.token_count").alias("token_count"),
        *keep,
    )


def list_chunks(chunks: DataFrame, document_ids: DataFrame) -> DataFrame:
    """Chunks of the requested documents in document order.

    The order holds inside each document: partitions are sorted, not the whole table.
    """
    wanted = document_ids.select("document_id").distinct()
    listed = chunks.join(wanted, "document_id", "left_semi")
    return listed.sortWithinPartitions("document_id", "ord")


def enrich_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Attach the document name in front of every chunk text (chunk join document)."""
    from folioquery.functions.text import enriched_text

    names = documents.select("document_id", "filename")
    return chunks.join(names, "document_id").withColumn("enriched", enriched_text(F.col("filename"), F.col("text")))


def _of_all(documents: DataFrame | None, grouped: DataFrame) -> DataFrame:
    """Keep documents without chunks, where the documents are given."""
    return grouped if documents is None else documents.select("document_id").join(grouped, "document_id", "left")


def concat_chunks(chunks: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """One text per document: chunk texts in order, each followed by a newline.

    The group is one document, and its result is a single string; chunks produced
    from document-partitioned data are concatenated without another shuffle.
    A document without chunks has an empty text.
    """
    ordered = F.array_sort(F.collect_list(F.struct("ord", "text")))
    texts = chunks.groupBy("document_id").agg(
        F.array_join(F.transform(ordered, lambda c: F.concat(c["text"], F.lit("\n"))), "").alias("content")
    )
    return _of_all(documents, texts).withColumn("content", F.coalesce("content", F.lit("")))


def analyze_payloads(chunks: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Payload of the follow-up task of each document: its chunk ids in order.

    A document without chunks has a task all the same; its ids are null.
    """
    ordered = F.array_sort(F.collect_list(F.struct("ord", "chunk_id")))
    ids = chunks.groupBy("document_id").agg(F.transform(ordered, lambda c: c["chunk_id"]).alias("chunk_ids"))
    body = F.struct("chunk_ids", F.col("document_id").cast("string").alias("document_id"))
    return _of_all(documents, ids).withColumn("payload", F.to_json(body, {"ignoreNullFields": "false"}))
