"""Documents -> chunks, summaries, embeddings and the final status."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquery.functions.text import enriched_text
from folioquery.operators.chunking import DEFAULT_MAX_WORDS, DEFAULT_OVERLAP, chunk_documents, concat_chunks
from folioquery.operators.embedding import DEFAULT_WIDTH, HASH_MODEL, Embedder, embed_chunks, embed_texts
from folioquery.operators.summarizing import Summarizer, extractive_summaries, model_responses, model_summaries, parse_responses
from folioquery.schemas import STATUS_READY
from folioquery.session import materialize


def summaries_of(documents: DataFrame, chunks: DataFrame, summarize_fn: Summarizer | None) -> DataFrame:
    """One row per document, also for documents without any sentence."""
    if summarize_fn is None:
        found = extractive_summaries(documents)
    else:
        found = model_summaries(concat_chunks(chunks, documents), summarize_fn)
    return documents.select("document_id").join(found, "document_id", "left").select(
        "document_id",
        F.coalesce("summary", F.lit("")).alias("summary"),
        F.coalesce("key_points", F.array().cast("array<string>")).alias("key_points"),
    )


def analyze_documents(
    documents: DataFrame,
    *,
    max_words: int = DEFAULT_MAX_WORDS,
    overlap: int = DEFAULT_OVERLAP,
    width: int = DEFAULT_WIDTH,
    embed_fn: Embedder | None = None,
    summarize_fn: Summarizer | None = None,
    model: str = HASH_MODEL,
) -> dict[str, DataFrame]:
    """The four tables of a batch of documents(document_id, filename, created_at, content).

    Chunking and embedding are narrow (the file name travels with the chunk, so the
    enrichment needs no join here); only the summaries place the texts by document.
    """
    cut = chunk_documents(documents, max_words, overlap, keep=("filename",))
    enriched = cut.withColumn("enriched", enriched_text(F.col("filename"), F.col("text")))
    chunks = cut.drop("filename")
    return {
        "documents": documents.drop("content").withColumn("status", F.lit(STATUS_READY)),
        "chunks": chunks,
        "summaries": summaries_of(documents, chunks, summarize_fn),
        "embeddings": embed_chunks(enriched, width, embed_fn, model),
    }


def analyze_isolated(
    documents: DataFrame,
    *,
    max_words: int = DEFAULT_MAX_WORDS,
    overlap: int = DEFAULT_OVERLAP,
    width: int = DEFAULT_WIDTH,
    embed_fn: Embedder | None = None,
    summarize_fn: Summarizer | None = None,
    model: str = HASH_MODEL,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """The four tables as `analyze_documents` gives them, and failures(document_id, error): one per document.

    A text that a user model fails on fails its document only; the caller leaves that document out of the tables.
    What the models gave is written once, because the tables and the failures are both read from it.
    """
    tables = analyze_documents(documents, max_words=max_words, overlap=overlap, width=width, model=model)
    failures = []
    if embed_fn is not None:
        cut = chunk_documents(documents, max_words, overlap, keep=("filename",))
        enriched = cut.withColumn("enriched", enriched_text(F.col("filename"), F.col("text")))
        tried = materialize(embed_texts(enriched, embed_fn, "chunk_id", "enriched", ("document_id",), isolate=True), "tried-embeddings")
        failures.append(tried.where("error IS NOT NULL").select("document_id", "error"))
        tables["embeddings"] = tried.where("error IS NULL").select("chunk_id", "document_id", "vector", F.lit(model).alias("model"))
    if summarize_fn is not None:
        tried = materialize(model_responses(concat_chunks(tables["chunks"], documents), summarize_fn, isolate=True), "tried-summaries")
        failures.append(tried.where("error IS NOT NULL").select("document_id", "error"))
        tables["summaries"] = parse_responses(tried.where("error IS NULL"))
    if not failures:
        return tables, documents.select("document_id", F.lit("").alias("error")).where(F.lit(False))
    return tables, reduce(DataFrame.unionByName, failures).groupBy("document_id").agg(F.min("error").alias("error"))
