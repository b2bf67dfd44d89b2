"""Reading uploaded files and test or production tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.functions.validation import MAX_UPLOAD_BYTES, resolved_type, upload_error
from folioquery.schemas import STATUS_PROCESSING
from folioquery.session import spread


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a folder, spread over the cores when it is a single small file."""
    return spread(spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet"))


def read_uploads(spark: SparkSession, path: str, pattern: str = "*", max_bytes: int | None = None) -> DataFrame:
    """Files below a folder as (filename, content_type, content BINARY, size, modified_at, path).

    Files above `max_bytes` are listed without content: the scan skips their bytes.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
        .load(path)
    )

    def listed(rows: DataFrame, content: Column) -> DataFrame:
        return rows.select(
            F.element_at(F.split("path", "/"), -1).alias("filename"),
            F.lit("").alias("content_type"),
            content.alias("content"),
            F.col("length").alias("size"),
            F.col("modificationTime").alias("modified_at"),
            "path",
        )

    if max_bytes is None:
        return listed(files, F.col("content"))
    small = listed(files.where(F.col("length") <= max_bytes), F.col("content"))
    return small.unionByName(listed(files.where(F.col("length") > max_bytes), F.lit(None).cast("binary")))


def decode_text(content: Column) -> Column:
    """Plain-text bytes as a string; invalid sequences show as the replacement character."""
    return F.make_valid_utf8(content.cast("string"))


def validate_uploads(uploads: DataFrame, max_bytes: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """uploads(filename, content_type, content) with `resolved_type` and `error`; `size`, if given, is the length."""
    size = F.col("size") if "size" in uploads.columns else F.octet_length("content")
    return uploads.withColumn("resolved_type", resolved_type(F.col("filename"), F.col("content_type"))).withColumn(
        "error", upload_error(F.col("filename"), F.col("content_type"), size, max_bytes)
    )


def ingest_documents(uploads: DataFrame, document_id: Column, created_at: Column) -> DataFrame:
    """Accepted uploads as document rows in status `processing`."""
    return uploads.select(
        document_id.alias("document_id"),
        "filename",
        F.lit(STATUS_PROCESSING).alias("status"),
        created_at.alias("created_at"),
        decode_text(F.col("content")).alias("content"),
    )


def assemble_pages(pages: DataFrame) -> DataFrame:
    """pages(document_id, page_no, text) -> one text per document.

    Pages are taken in order, pages without text are skipped, a newline follows each.
    A document whose pages are all skipped has an empty text.
    """
    ordered = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("page_no", "text"))))
    return pages.groupBy("document_id").agg(
        F.array_join(F.transform(ordered, lambda p: F.concat(p["text"], F.lit("\n"))), "").alias("content")
    )
