"""Schemas of the stored tables and of the task payloads."""

from pyspark.sql import types as T

STATUS_PROCESSING, STATUS_READY, STATUS_FAILED = "processing", "ready", "failed"
STATUSES = [STATUS_PROCESSING, STATUS_READY, STATUS_FAILED]

DOCUMENTS = T.StructType(
    [
        T.StructField("document_id", T.StringType(), False),
        T.StructField("filename", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("content", T.StringType()),
    ]
)
CHUNKS = T.StructType(
    [
        T.StructField("chunk_id", T.StringType(), False),
        T.StructField("document_id", T.StringType(), False),
        T.StructField("ord", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("token_count", T.IntegerType()),
    ]
)
SUMMARIES = T.StructType(
    [
        T.StructField("document_id", T.StringType(), False),
        T.StructField("summary", T.StringType()),
        T.StructField("key_points", T.ArrayType(T.StringType())),
    ]
)
EMBEDDINGS = T.StructType(
    [
        T.StructField("chunk_id", T.StringType(), False),
        T.StructField("document_id", T.StringType(), False),
        T.StructField("vector", T.ArrayType(T.FloatType())),
        T.StructField("model", T.StringType()),
    ]
)
REQUESTS = T.StructType(
    [
        T.StructField("question_id", T.StringType(), False),
        T.StructField("question", T.StringType()),
        T.StructField("document_ids", T.ArrayType(T.StringType())),
        T.StructField("top_k", T.IntegerType()),
    ]
)
SOURCES = "array<struct<chunk_id:string,score:double,preview:string>>"
PARSE_PAYLOAD = "document_id string, filename string, content string"
ANALYZE_PAYLOAD = "document_id string, chunk_ids array<string>"
