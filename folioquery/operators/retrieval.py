"""Retrieval: hits of questions with their chunks and document summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquery.operators.ivf import InvertedFile, top_k_ivf
from folioquery.functions.validation import TOP_K_MAX
from folioquery.operators.similarity import (
    BROADCAST_BYTES,
    MIN_SIMILARITY,
    asked_scopes,
    measure_questions,
    top_k,
)

HIT_BYTES = 256  # one hit row: ids, model, similarity and rank


def hits_are_small(n_questions: int, k: int = TOP_K_MAX, bound: int = BROADCAST_BYTES) -> bool:
    """At most k hits per question: their size is known before they are computed."""
    return n_questions * k * HIT_BYTES <= bound


def attach_chunks(hits: DataFrame, chunks: DataFrame, small_hits: bool = False) -> DataFrame:
    """hits join chunks on chunk_id.

    Chunk texts join after the top-k, so they take no part in the similarity stage.
    `small_hits` states the outcome of `hits_are_small`: the hits are then broadcast and
    the chunk table is scanned without being moved. Else both sides are shuffled.
    """
    return (F.broadcast(hits) if small_hits else hits).join(chunks, "chunk_id")


def attach_summaries(hits: DataFrame, summaries: DataFrame) -> DataFrame:
    """Left join on document_id; a document without a summary gets '' and no key points."""
    return hits.join(summaries.select("document_id", "summary", "key_points"), "document_id", "left").withColumns(
        {
            "summary": F.coalesce("summary", F.lit("")),
            "key_points": F.coalesce("key_points", F.array().cast("array<string>")),
        }
    )


def retrieve(
    questions: DataFrame,
    embeddings: DataFrame | None,
    chunks: DataFrame,
    summaries: DataFrame | None = None,
    *,
    scope: str | None = "document_id",
    threshold: float = MIN_SIMILARITY,
    k: int = 5,
    index: InvertedFile | None = None,
    nprobe: int | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    **options,
) -> DataFrame:
    """Restrict, compare, cut at the threshold, take the k best, add chunk and summary.

    questions(question_id, vector, scopes[, top_k]); embeddings(chunk_id, vector[, model], <scope>).
    Without `summaries` their columns are left out. With an inverted file, which holds
    the embeddings by list, only the nprobe nearest lists of a question are searched.
    """
    stored = embeddings if index is None else index.vectors
    options |= {
        "k": k, "threshold": threshold, "carry": ("model",) if "model" in stored.columns else (),
        "broadcast_bytes": broadcast_bytes,
    }
    size = measure_questions(questions)
    if index is None:
        hits = top_k(questions, embeddings, scope=scope, size=size, **options)
    else:
        hits = top_k_ivf(questions, index, nprobe, within=scope, **options)
    if scope == "document_id":  # the asked documents also bound what is read of the other tables
        asked = asked_scopes(questions, size)
        if asked is not None:
            chunks = chunks.where(F.col("document_id").isin(asked))
            summaries = summaries if summaries is None else summaries.where(F.col("document_id").isin(asked))
    found = attach_chunks(hits, chunks, hits_are_small(size.rows, size.top_k if "top_k" in questions.columns else k, broadcast_bytes))
    return found if summaries is None else attach_summaries(found, summaries)
