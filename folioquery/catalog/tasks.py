"""Queries: task tables, retries, answer reuse, streams."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.catalog import query
from folioquery.catalog.chunks import PAYLOADS
from folioquery.catalog.inputs import DOCUMENTS, WIDTH, chunks_sql, documents, timestamp_sql, timestamp_text
from folioquery.catalog.tables import TABLES_SQL, events, per_document, stored_documents
from folioquery.functions.retry import backoff_ms
from folioquery.operators.cache import DEFAULT_TTL_SECONDS, reuse_within_ttl
from folioquery.operators.embedding import Embedder
from folioquery.operators.maintenance import mark_failed
from folioquery.operators.tasks import due_tasks, retry_state, task_route
from folioquery.session import run_folder
from folioquery.sources.store import load_tables
from folioquery.streaming.stages import analyze_stage, parse_stage, read_file_stream, read_table_stream, reuse_stage
from folioquery.streaming.worker import analyze_tasks_stage, outcomes, run_due, waiting_tasks

_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def tasks(spark: SparkSession, folder: str) -> DataFrame:
    """Events as tasks: attempts, limit and type follow from the payload and the number."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    number = F.col("event_id") % 3
    return events(spark, folder).select(
        "event_id", "event_type", F.col("user_id").alias("document_id"), F.col("ts").alias("failed_at"),
        (k % 6).cast("int").alias("attempts"), (k % 7).cast("int").alias("max_attempts"),
        F.when(number == 0, "parse").when(number == 1, "analyze").alias("task_type"),
        F.when(k % 10 != 0, F.col("ts") + F.make_dt_interval(secs=F.col("value"))).alias("not_before"),
    )


_RETRY = f"""
t AS (SELECT event_id, event_type, user_id, ts, {_K} % 6 + 1 AS attempts,
             CASE WHEN {_K} % 7 = 0 THEN 5 ELSE {_K} % 7 END AS bound FROM events),
r AS (SELECT *, attempts >= bound AS dead, 1000 * CAST(pow(2, attempts) AS BIGINT) AS wait FROM t)"""


@query(
    "retry_tasks",
    f"""
WITH {_RETRY}
SELECT event_id, CAST(attempts AS INTEGER) AS attempts, dead, CASE WHEN NOT dead THEN wait END AS delay_ms,
       CASE WHEN NOT dead THEN {timestamp_sql('ts + to_microseconds(wait * 1000)')} END AS not_before
FROM r""",
)
def _retry(spark: SparkSession, folder: str) -> DataFrame:
    state = retry_state(tasks(spark, folder))
    return state.select("event_id", "attempts", "dead", "delay_ms", timestamp_text("not_before").alias("not_before"))


@query(
    "mark_failed",
    f"""
WITH {_RETRY}
SELECT doc_id AS document_id,
       CASE WHEN doc_id IN (SELECT user_id FROM r WHERE dead AND event_type = 'error') THEN 'failed' ELSE 'processing' END AS status
FROM documents""",
)
def _mark_failed(spark: SparkSession, folder: str) -> DataFrame:
    dead = retry_state(tasks(spark, folder).where("event_type = 'error'")).where("dead")
    return mark_failed(stored_documents(spark, folder), dead).select("document_id", "status")


AS_OF = "2024-01-15 12:00:00"


@query(
    "due_tasks",
    f"""
WITH t AS (SELECT event_id, CASE WHEN {_K} % 10 <> 0 THEN ts + to_microseconds(CAST(round(value * 1000000) AS BIGINT)) END AS nb FROM events)
SELECT event_id, {timestamp_sql('nb')} AS not_before FROM t WHERE nb IS NULL OR nb <= TIMESTAMP '{AS_OF}'""",
)
def _due(spark: SparkSession, folder: str) -> DataFrame:
    due = due_tasks(tasks(spark, folder), F.lit(AS_OF).cast("timestamp_ntz"))
    return due.select("event_id", timestamp_text("not_before").alias("not_before"))


@query(
    "route_tasks",
    """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'tasks.parse' WHEN 1 THEN 'tasks.analyze' ELSE 'task type required' END AS route
FROM events""",
)
def _route(spark: SparkSession, folder: str) -> DataFrame:
    return tasks(spark, folder).select("event_id", task_route(["parse", "analyze"]).alias("route"))


@query(
    "backoff_schedule",
    f"""
SELECT event_id, 100 * CAST(pow(2, {_K} % 6) AS BIGINT) AS delay_ms
FROM events""",
)
def _backoff(spark: SparkSession, folder: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return events(spark, folder).select("event_id", backoff_ms(k % 6, 100).alias("delay_ms"))


def _reuse_sql(key: str) -> str:
    return f"""
WITH RECURSIVE asks AS (SELECT event_id AS ask_id, {key} AS key, ts FROM events),
computed AS (
  SELECT key, min(ts) AS ts FROM asks GROUP BY key
  UNION ALL
  SELECT m.key, min(a.ts) FROM computed m JOIN asks a ON a.key = m.key AND a.ts >= m.ts + INTERVAL 24 HOUR GROUP BY m.key, m.ts),
sources AS (SELECT c.key, c.ts, min(a.ask_id) AS source_id FROM computed c JOIN asks a ON a.key = c.key AND a.ts = c.ts GROUP BY ALL)
SELECT a.ask_id, a.key, s.source_id, a.ask_id <> s.source_id AS reused
FROM asks a ASOF JOIN sources s ON a.key = s.key AND a.ts >= s.ts"""


_USER_KEY = "concat(user_id, ':', event_type)"


def ask_log(frame: DataFrame, *key: str) -> DataFrame:
    return frame.select(
        F.col("event_id").alias("ask_id"), F.concat_ws(":", *[F.col(c).cast("string") for c in key]).alias("key"), "ts"
    )


@query("ttl_reuse", _reuse_sql(_USER_KEY))
def _reuse(spark: SparkSession, folder: str) -> DataFrame:
    return reuse_within_ttl(ask_log(events(spark, folder), "user_id", "event_type")).drop("ts")


@query("ttl_reuse_hot_keys", _reuse_sql("event_type"))
def _reuse_hot(spark: SparkSession, folder: str) -> DataFrame:
    """Few keys with a large share of the rows each; all of them are cut into slices, in two levels."""
    log = ask_log(events(spark, folder), "event_type")
    return reuse_within_ttl(log, hot_rows=100, slice_rows=max(1, log.count() // 20), fan=4).drop("ts")


FILES_PER_BATCH = 1000
_PART = "CASE floor(hour(ts) / 6) WHEN 2 THEN 0 WHEN 0 THEN 1 WHEN 3 THEN 2 ELSE 3 END"


@query(
    "stream_ttl_reuse_late",
    f"""
WITH RECURSIVE asks AS (
  SELECT event_id AS ask_id, {_USER_KEY} AS key, ts, row_number() OVER (PARTITION BY {_USER_KEY} ORDER BY {_PART}, ts, event_id) AS o
  FROM events),
computed AS (
  SELECT key, CAST(1 AS BIGINT) AS o FROM asks WHERE o = 1
  UNION ALL
  SELECT c.key, min(a.o) FROM computed m JOIN asks c ON c.key = m.key AND c.o = m.o
  JOIN asks a ON a.key = c.key AND a.o > c.o AND a.ts >= c.ts + INTERVAL 24 HOUR GROUP BY c.key, c.o)
SELECT a.ask_id, a.key, s.ask_id AS source_id, a.ask_id <> s.ask_id AS reused
FROM asks a ASOF JOIN computed m ON a.key = m.key AND a.o >= m.o JOIN asks s ON s.key = m.key AND s.o = m.o""",
)
def _stream_reuse_late(spark: SparkSession, folder: str) -> DataFrame:
    """Asks in several micro-batches whose order is not that of time: each is answered from the entry that is live on its arrival."""
    log = ask_log(events(spark, folder), "user_id", "event_type")
    source, target = run_folder(spark, "late-asks"), run_folder(spark, "stream-late")
    for part in (2, 0, 3, 1):  # a part is what arrives before the stream goes on: one micro-batch of all its files
        hour = F.floor(F.hour("ts") / 6)
        log.where(hour == part).coalesce(FILES_PER_BATCH).write.mode("append").parquet(source)
        reuse_stage(read_file_stream(spark, source, log.schema, files_per_batch=FILES_PER_BATCH), target, DEFAULT_TTL_SECONDS)
    answers = spark.read.parquet(f"{target}/answers")
    return answers.select("ask_id", "key", "source_id", (F.col("ask_id") != F.col("source_id")).alias("reused"))


@query("stream_ttl_reuse", _reuse_sql(_USER_KEY))
def _stream_reuse(spark: SparkSession, folder: str) -> DataFrame:
    schema = spark.read.parquet(f"{folder.rstrip('/')}/events.parquet").schema
    stream = read_table_stream(spark, folder, "events", schema)
    target = run_folder(spark, "stream-reuse")
    reuse_stage(ask_log(stream, "user_id", "event_type"), target, DEFAULT_TTL_SECONDS)
    answers = spark.read.parquet(f"{target}/answers")
    return answers.select("ask_id", "key", "source_id", (F.col("ask_id") != F.col("source_id")).alias("reused"))


def document_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = spark.read.parquet(f"{folder.rstrip('/')}/documents.parquet").schema
    stream = read_table_stream(spark, folder, "documents", schema)
    return stream.select(
        F.col("doc_id").alias("document_id"), F.col("text").alias("content"),
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
    )


@query(
    "stream_chunks",
    f"WITH {DOCUMENTS}, {chunks_sql()} SELECT chunk_id, document_id, ord, text, token_count FROM c",
)
def _stream_chunks(spark: SparkSession, folder: str) -> DataFrame:
    target = run_folder(spark, "stream-chunks")
    parse_stage(document_stream(spark, folder), target)
    return spark.read.parquet(f"{target}/chunks").drop("batch")


@query("stream_tasks", PAYLOADS)
def _stream_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """The analyse tasks that the parse stage hands over."""
    target = run_folder(spark, "stream-tasks")
    parse_stage(document_stream(spark, folder), target)
    handed_over = spark.read.parquet(f"{target}/tasks")
    return handed_over.select("document_id", F.array_join("chunk_ids", ",").alias("chunk_ids"), "payload")


@query("stream_analyze", TABLES_SQL)
def _stream_analyze(spark: SparkSession, folder: str) -> DataFrame:
    target = run_folder(spark, "stream-analyze")
    analyze_stage(document_stream(spark, folder), target, width=WIDTH)
    return per_document(load_tables(spark, f"{target}/tables"))


START = datetime(2024, 3, 1)
ROUNDS = (2, 6, 14, 30)  # seconds after the stream's round: when a first, second ... failure is due again


def _embedder(healed: bool) -> Embedder:
    """A stand-in for a user model that fails on documents of one collection, and of another until it is healed."""

    def embed(texts: list[str]) -> list[list[float]]:
        for text in texts:
            if text.startswith("Document: src3/") or (text.startswith("Document: src5/") and not healed):
                raise RuntimeError("no vector")
        return [[float(len(t)), 1.0] for t in texts]

    return embed


@query(
    "stream_analyze_tasks",
    f"""
WITH {DOCUMENTS}, {chunks_sql()},
n AS (SELECT document_id, count(*) AS n_chunks FROM c GROUP BY document_id),
docs AS (SELECT document_id, collection, coalesce(n_chunks, 0) AS n_chunks FROM d LEFT JOIN n USING (document_id)),
t AS (
  SELECT 'd' || document_id AS task, document_id, 5 AS bound FROM docs
  UNION ALL
  SELECT 'e' || event_id, user_id * 10, CASE WHEN {_K} % 7 = 0 THEN 5 ELSE {_K} % 7 END FROM events WHERE event_type = 'error'),
f AS (
  SELECT task, t.document_id, bound,
         CASE WHEN docs.document_id IS NULL THEN 9 WHEN n_chunks = 0 THEN 0 WHEN collection = 'src3' THEN 9 WHEN collection = 'src5' THEN 2 ELSE 0 END AS failures,
         CASE WHEN docs.document_id IS NULL THEN 'document not found' ELSE 'RuntimeError: no vector' END AS reason
  FROM t LEFT JOIN docs USING (document_id)),
s AS (SELECT *, least(failures, {1 + len(ROUNDS)}, bound) AS attempts FROM f)
SELECT 'task' AS kind, task AS id, CASE WHEN attempts = bound AND failures >= bound THEN 'dead' WHEN failures > attempts THEN 'waiting' ELSE 'done' END AS state,
       CAST(attempts AS BIGINT) AS n, CASE WHEN attempts = bound AND failures >= bound THEN reason END AS error
FROM s
UNION ALL
SELECT 'task', 'v' || event_id, 'quarantined', 0,
       CASE event_id % 3 WHEN 1 THEN 'payload names no document' ELSE 'task type required' END
FROM events WHERE event_type = 'view' AND event_id % 3 <> 0
UNION ALL
SELECT 'document', CAST(document_id AS VARCHAR), CASE WHEN collection = 'src3' AND n_chunks > 0 THEN 'failed' ELSE 'ready' END,
       CASE WHEN collection = 'src3' THEN 0 ELSE n_chunks END, NULL
FROM docs""",
)
def _stream_analyze_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """Tasks of the parse stage, of events that name documents and of events that name none; then the rounds of the retries."""
    parsed, tasks_folder = run_folder(spark, "stream-parsed"), run_folder(spark, "stream-tasks")
    log, store = run_folder(spark, "task-log"), run_folder(spark, "task-store")
    parse_stage(document_stream(spark, folder), parsed)
    columns = ["task_id", "task_type", "payload", "max_attempts"]
    handed_over = spark.read.parquet(f"{parsed}/tasks").withColumn("max_attempts", F.lit(None).cast("int"))
    handed_over = handed_over.withColumn("task_id", F.concat(F.lit("d"), F.col("document_id").cast("string")))
    log_rows = events(spark, folder)
    number = F.col("event_id") % 3
    named = log_rows.where("event_type = 'error'").select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("task_id"), F.lit("analyze").alias("task_type"),
        F.to_json(F.struct((F.col("user_id") * 10).alias("document_id"))).alias("payload"),
        (F.get_json_object("props", "$.k").cast("bigint") % 7).cast("int").alias("max_attempts"),
    )
    nameless = log_rows.where("event_type = 'view'").select(
        F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("task_id"),
        F.when(number == 0, "parse").when(number == 1, "analyze").alias("task_type"),
        F.when(F.col("event_id") % 10 == 0, F.expr("left(props, length(props) - 1)")).otherwise(F.col("props")).alias("payload"),
        F.lit(None).cast("int").alias("max_attempts"),
    )
    for part in (handed_over, named, nameless):
        part.select(columns).coalesce(1).write.mode("append").parquet(tasks_folder)
    schema = spark.read.parquet(tasks_folder).schema
    docs = documents(spark, folder).drop("collection")
    stream = read_file_stream(spark, tasks_folder, schema)
    analyze_tasks_stage(stream, log, store, docs, lambda: START, embed_fn=_embedder(False))
    for after in ROUNDS:
        run_due(spark, log, store, docs, START + timedelta(seconds=after), embed_fn=_embedder(after >= 6))
    done = outcomes(spark, log).select("task_id", "state", "attempts", "error")
    waiting = waiting_tasks(spark, log).select("task_id", F.lit("waiting").alias("state"), "attempts")
    states = done.unionByName(waiting, allowMissingColumns=True)
    rows = states.select(F.lit("task").alias("kind"), F.col("task_id").alias("id"), "state", F.col("attempts").cast("bigint").alias("n"), "error")
    tables = load_tables(spark, store, newest=True)
    chunks = tables["embeddings"].groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    stored = tables["documents"].join(chunks, "document_id", "left").select(
        F.lit("document").alias("kind"), F.col("document_id").cast("string").alias("id"), F.col("status").alias("state"),
        F.coalesce("n", F.lit(0)).alias("n"), F.lit(None).cast("string").alias("error"),
    )
    return rows.unionByName(stored)
