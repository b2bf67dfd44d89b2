"""Queries: uploads, decoding, validation, requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.catalog import query
from folioquery.catalog.inputs import DOCUMENTS, documents, uuid_of, uuid_sql
from folioquery.functions.keys import embedding_key, query_key
from folioquery.functions.validation import effective_top_k, parse_document_ids
from folioquery.operators.tasks import decode_payloads
from folioquery.plans.ask import validated
from folioquery.sources.files import assemble_pages, decode_text, ingest_documents, read_table, validate_uploads


@query(
    "ingest_documents",
    f"WITH {DOCUMENTS} SELECT document_id, filename, 'processing' AS status, content FROM d",
)
def _ingest(spark: SparkSession, folder: str) -> DataFrame:
    uploads = documents(spark, folder).withColumn("content", F.encode("content", "UTF-8"))
    ingested = ingest_documents(uploads, F.col("document_id"), F.current_timestamp())
    return ingested.select("document_id", "filename", "status", "content")


@query(
    "decode_text",
    "SELECT doc_id AS document_id, octet_length(encode(text)) AS n_bytes, decode(encode(text)) AS content FROM documents",
)
def _decode(spark: SparkSession, folder: str) -> DataFrame:
    raw = documents(spark, folder).withColumn("content", F.encode("content", "UTF-8"))
    return raw.select(
        "document_id", F.octet_length("content").cast("bigint").alias("n_bytes"),
        decode_text(F.col("content")).alias("content"),
    )


@query(
    "assemble_pages",
    """
SELECT conv_id AS document_id,
       coalesce(string_agg(text || chr(10), '' ORDER BY turn, text) FILTER (WHERE turn % 5 <> 3), '') AS content
FROM conversations GROUP BY conv_id""",
)
def _pages(spark: SparkSession, folder: str) -> DataFrame:
    pages = read_table(spark, folder, "conversations").select(
        F.col("conv_id").alias("document_id"),
        F.col("turn").alias("page_no"),
        F.when(F.col("turn") % 5 != 3, F.col("text")).alias("text"),
    )
    return assemble_pages(pages)


@query(
    "decode_payloads",
    """
WITH p AS (
  SELECT event_id, CASE WHEN event_id % 10 = 0 THEN left(props, length(props) - 1) ELSE props END AS payload
  FROM events)
SELECT event_id, NOT json_valid(payload) AS malformed,
       CASE WHEN json_valid(payload) THEN CAST(json_extract_string(payload, '$.k') AS BIGINT) END AS k
FROM p""",
)
def _payloads(spark: SparkSession, folder: str) -> DataFrame:
    payload = F.when(F.col("event_id") % 10 == 0, F.left("props", F.length("props") - 1)).otherwise(F.col("props"))
    tasks = read_table(spark, folder, "events").select("event_id", payload.alias("payload"))
    return decode_payloads(tasks, "payload", "k bigint").select(
        "event_id", "malformed", F.col("decoded.k").alias("k")
    )


@query(
    "validate_uploads",
    f"""
WITH {DOCUMENTS}, u AS (
  SELECT document_id, octet_length(encode(content)) AS n_bytes,
         CASE document_id % 4 WHEN 0 THEN '.TXT' WHEN 1 THEN '.pdf' WHEN 2 THEN '.docx' ELSE '' END AS ext,
         CASE document_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'text/plain' ELSE 'application/msword' END AS declared
  FROM d),
t AS (
  SELECT document_id, n_bytes,
         CASE WHEN declared <> '' THEN declared WHEN lower(ext) = '.txt' THEN 'text/plain'
              WHEN lower(ext) = '.pdf' THEN 'application/pdf' END AS resolved_type
  FROM u)
SELECT document_id, resolved_type,
       CASE WHEN n_bytes > 2000 THEN 'file too large (max 2000 bytes)'
            WHEN resolved_type IS NULL OR resolved_type NOT IN ('text/plain', 'application/pdf')
            THEN 'unsupported file type (only PDF and TXT allowed)' END AS error
FROM t""",
)
def _uploads(spark: SparkSession, folder: str) -> DataFrame:
    number = F.col("document_id") % 4
    extension = F.when(number == 0, ".TXT").when(number == 1, ".pdf").when(number == 2, ".docx").otherwise("")
    declared = F.col("document_id") % 3
    uploads = documents(spark, folder).select(
        "document_id",
        F.concat(F.col("collection"), F.lit("/"), F.col("document_id").cast("string"), extension).alias("filename"),
        F.when(declared == 0, "").when(declared == 1, "text/plain").otherwise("application/msword").alias("content_type"),
        F.encode("content", "UTF-8").alias("content"),
    )
    return validate_uploads(uploads, max_bytes=2000).select("document_id", "resolved_type", "error")


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """Question requests derived from documents and their whole texts, some of them invalid."""
    number = F.col("document_id")
    first = F.when(number % 7 == 0, F.concat(F.lit("x"), uuid_of(number))).otherwise(uuid_of(number))
    second = F.when(number % 5 == 0, F.upper(uuid_of(number + 1))).otherwise(uuid_of(number + 1))
    ids = F.when(number % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(first, second))
    return documents(spark, folder).select(
        number.alias("question_id"), F.col("content").alias("question"), ids.alias("document_ids"),
        (number % 25).cast("int").alias("top_k"),
    )


REQUESTS = f"""
r AS (
  SELECT doc_id AS question_id, text AS question,
         CASE WHEN doc_id % 11 = 0 THEN CAST([] AS VARCHAR[]) ELSE [
           CASE WHEN doc_id % 7 = 0 THEN 'x' || {uuid_sql('doc_id')} ELSE {uuid_sql('doc_id')} END,
           CASE WHEN doc_id % 5 = 0 THEN upper({uuid_sql('doc_id + 1')}) ELSE {uuid_sql('doc_id + 1')} END] END
         AS document_ids,
         CAST(doc_id % 25 AS INTEGER) AS top_k
  FROM documents)"""
_UUID4 = "^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"


@query(
    "validate_requests",
    f"""
WITH {REQUESTS}, m AS (
  SELECT question_id,
         CASE WHEN top_k = 0 THEN 5 ELSE top_k END AS top_k,
         list_filter(list_concat(list_concat(
           [CASE WHEN question IS NULL OR question = '' THEN 'Question is required'
                 WHEN length(question) < 3 THEN 'Question must be at least 3'
                 WHEN length(question) > 500 THEN 'Question must be at most 500' END,
            CASE WHEN len(document_ids) < 1 THEN 'DocumentIDs must be at least 1' END],
           list_transform(document_ids, lambda x, i: CASE WHEN NOT regexp_full_match(x, '{_UUID4}')
             THEN concat('DocumentIDs[', i - 1, '] must be a valid UUID') END)),
           [CASE WHEN top_k > 20 THEN 'TopK must be at most 20' END]), lambda x: x IS NOT NULL) AS messages
  FROM r)
SELECT question_id, CAST(top_k AS INTEGER) AS top_k, nullif(array_to_string(messages, '; '), '') AS error FROM m""",
)
def _requests(spark: SparkSession, folder: str) -> DataFrame:
    return validated(requests(spark, folder)).select("question_id", "top_k", "error")


@query(
    "parse_document_ids",
    f"""
WITH {REQUESTS}
SELECT question_id, coalesce(array_to_string(list_transform(
         list_filter(document_ids, lambda x: length(x) = 36), lambda x: lower(x)), ','), '') AS document_ids
FROM r""",
)
def _ids(spark: SparkSession, folder: str) -> DataFrame:
    return requests(spark, folder).select(
        "question_id", F.array_join(parse_document_ids(F.col("document_ids")), ",").alias("document_ids")
    )


@query(
    "query_cache_key",
    f"""
WITH {REQUESTS}
SELECT question_id, sha256(concat('q:', question, '|docs:', coalesce(array_to_string(list_sort(document_ids), ','), ''),
       '|k:', CASE WHEN top_k = 0 THEN 5 ELSE top_k END)) AS key
FROM r""",
)
def _query_key(spark: SparkSession, folder: str) -> DataFrame:
    k = effective_top_k(F.col("top_k"))
    return requests(spark, folder).select(
        "question_id", query_key(F.col("question"), F.col("document_ids"), k).alias("key")
    )


@query("embedding_cache_key", "SELECT doc_id AS document_id, sha256(text) AS key FROM documents")
def _embedding_key(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("document_id", embedding_key(F.col("content")).alias("key"))
