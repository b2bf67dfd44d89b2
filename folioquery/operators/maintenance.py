"""Keyed table maintenance: updates, upserts, cascades, integrity checks, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquery.functions.validation import HEX_UUID
from folioquery.schemas import STATUS_FAILED, STATUSES


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key. `max` of a struct combines map-side, so a hot key is cheap."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*order, *rest), F.struct(*order)).alias("_newest"))
    return newest.select(*keys, *[F.col(f"_newest.{c}").alias(c) for c in order + rest]).select(*rows.columns)


def upsert(base: DataFrame, updates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Insert or replace by key, last write wins; rows of `base` are older than any update."""
    columns = base.columns
    newest = latest_per_key(updates, keys, [order])
    kept = base.join(newest.select(*keys), keys, "left_anti")
    return kept.unionByName(newest.select(*columns))


def update_status(documents: DataFrame, updates: DataFrame, order: list[str]) -> DataFrame:
    """documents with the last status given to each id in updates(document_id, status, <order>)."""
    valid = updates.where(F.col("status").isin(STATUSES))
    newest = latest_per_key(valid.select("document_id", *order, "status"), ["document_id"], order)
    newest = newest.select("document_id", F.col("status").alias("_status"))
    return documents.join(newest, "document_id", "left").withColumn(
        "status", F.coalesce("_status", "status")
    ).drop("_status")


def unknown_documents(documents: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates whose document does not exist; the caller reports them as errors."""
    return updates.join(documents.select("document_id"), "document_id", "left_anti").withColumn(
        "error", F.lit("document not found")
    )


def mark_failed(documents: DataFrame, dead_letters: DataFrame) -> DataFrame:
    """Documents whose task was given up get the status `failed`."""
    failed = dead_letters.select("document_id").distinct().withColumn("_failed", F.lit(True))
    return documents.join(failed, "document_id", "left").withColumn(
        "status", F.when(F.col("_failed"), F.lit(STATUS_FAILED)).otherwise(F.col("status"))
    ).drop("_failed")


def cascade_delete(
    deleted: DataFrame, documents: DataFrame, chunks: DataFrame, summaries: DataFrame, embeddings: DataFrame
) -> dict[str, DataFrame]:
    """The four tables without the deleted documents and everything that depends on them.

    Embeddings that carry their document_id need no detour over the chunk ids.
    """
    gone = deleted.select("document_id").distinct()
    if "document_id" in embeddings.columns:
        gone_embeddings, key = gone, "document_id"
    else:
        gone_embeddings, key = chunks.join(gone, "document_id", "left_semi").select("chunk_id"), "chunk_id"
    return {
        "documents": documents.join(gone, "document_id", "left_anti"),
        "chunks": chunks.join(gone, "document_id", "left_anti"),
        "summaries": summaries.join(gone, "document_id", "left_anti"),
        "embeddings": embeddings.join(gone_embeddings, key, "left_anti"),
    }


def orphan_counts(documents: DataFrame, chunks: DataFrame, summaries: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Number of rows per relation whose parent is missing."""

    def orphans(child: DataFrame, parent: DataFrame, key: str, relation: str) -> DataFrame:
        missing = child.select(key).join(parent.select(key), key, "left_anti")
        return missing.agg(F.count("*").alias("orphans")).select(F.lit(relation).alias("relation"), "orphans")

    return (
        orphans(chunks, documents, "document_id", "chunks")
        .unionByName(orphans(summaries, documents, "document_id", "summaries"))
        .unionByName(orphans(embeddings, chunks, "chunk_id", "embeddings"))
    )


def document_lookup(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """Requested documents with an outcome column: found or not found."""
    known = documents.select("document_id", "filename", "status", F.lit(True).alias("_known"))
    return requests.join(known, "document_id", "left").withColumn(
        "outcome", F.when(F.col("_known"), F.lit("found")).otherwise(F.lit("document not found"))
    ).drop("_known")


def summary_lookup(requests: DataFrame, summaries: DataFrame, uuid_ids: bool = False) -> DataFrame:
    """Requested summaries with an outcome column: found, not ready, or a malformed id."""
    known = summaries.select("document_id", "summary", "key_points", F.lit(True).alias("_known"))
    outcome = F.when(F.col("_known"), F.lit("found")).otherwise(F.lit("summary not ready"))
    if uuid_ids:
        outcome = F.when(~F.col("document_id").rlike(f"^{HEX_UUID}$"), F.lit("invalid document id")).otherwise(outcome)
    return requests.join(known, "document_id", "left").withColumn("outcome", outcome).drop("_known")
