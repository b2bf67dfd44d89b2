"""Queries: table maintenance, lookups, caches, whole ingest job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.catalog import query
from folioquery.catalog.chunks import summaries_sql
from folioquery.catalog.inputs import (
    DOCUMENTS,
    WIDTH,
    chunks_sql,
    documents,
    timestamp_sql,
    timestamp_text,
)
from folioquery.catalog.vectors import label_summaries, stored_vectors
from folioquery.functions.keys import embedding_key
from folioquery.operators import cache, maintenance
from folioquery.operators.chunking import chunk_documents
from folioquery.operators.embedding import HASH_MODEL
from folioquery.plans.analyze import analyze_documents
from folioquery.plans.ask import question_vectors
from folioquery.session import run_folder
from folioquery.sources.files import read_table
from folioquery.sources.cache_store import add_entries, compact_cache, drop_answers, entries_of
from folioquery.sources.store import compact, delete_documents, load_tables, register_model, save_rows, save_tables, update_statuses


def stored_documents(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("document_id", "filename", F.lit("processing").alias("status"))


def events(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "events")


_STATUS_SQL = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'processing' ELSE 'ready' END"


@query(
    "update_status",
    f"""
WITH u AS (SELECT event_id, ts, user_id * 10 AS document_id, {_STATUS_SQL} AS status FROM events),
n AS (SELECT document_id, status FROM u QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT doc_id AS document_id, coalesce(n.status, 'processing') AS status, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS error
FROM documents LEFT JOIN n ON n.document_id = doc_id
UNION ALL
SELECT document_id, status, event_id, 'document not found' FROM u WHERE document_id NOT IN (SELECT doc_id FROM documents)""",
)
def _update_status(spark: SparkSession, folder: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "processing")
    updates = events(spark, folder).select(
        (F.col("user_id") * 10).alias("document_id"), "ts", "event_id", status.otherwise("ready").alias("status")
    )
    base = stored_documents(spark, folder)
    updated = maintenance.update_status(base, updates, ["ts", "event_id"]).select("document_id", "status")
    unknown = maintenance.unknown_documents(base, updates).drop("ts")
    return updated.unionByName(unknown, allowMissingColumns=True)


@query(
    "upsert_summaries",
    """
WITH n AS (SELECT user_id AS document_id, event_type AS summary FROM events
           QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
SELECT coalesce(n.document_id, doc_id) AS document_id, coalesce(n.summary, concat('quality ', quality)) AS summary
FROM labels FULL JOIN n ON n.document_id = doc_id""",
)
def _upsert_summaries(spark: SparkSession, folder: str) -> DataFrame:
    base = label_summaries(spark, folder).select("document_id", "summary")
    updates = events(spark, folder).select(
        F.col("user_id").alias("document_id"), F.col("event_type").alias("summary"), F.col("event_id").alias("seq")
    )
    return maintenance.upsert(base, updates, ["document_id"], "seq")


@query(
    "upsert_embeddings",
    """
WITH u AS (SELECT vec_id + 100 AS chunk_id, vec_id AS seq, embedding FROM embeddings
           UNION ALL SELECT vec_id + 200, vec_id + 100000, embedding FROM embeddings),
n AS (SELECT chunk_id, embedding FROM u QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY seq DESC) = 1),
a AS (SELECT coalesce(n.chunk_id, vec_id) AS chunk_id, coalesce(n.embedding, e.embedding) AS v
      FROM embeddings e FULL JOIN n ON n.chunk_id = vec_id)
SELECT chunk_id, round(list_sum(CAST(v AS DOUBLE[])), 6) AS total, CAST(len(v) AS INTEGER) AS width FROM a""",
)
def _upsert_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    base = stored_vectors(spark, folder).select("chunk_id", "vector")
    first = base.select((F.col("chunk_id") + 100).alias("chunk_id"), F.col("chunk_id").alias("seq"), "vector")
    second = base.select(
        (F.col("chunk_id") + 200).alias("chunk_id"), (F.col("chunk_id") + 100000).alias("seq"), "vector"
    )
    merged = maintenance.upsert(base, first.unionByName(second), ["chunk_id"], "seq")
    total = F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda acc, x: acc + x)
    return merged.select("chunk_id", F.round(total, 6).alias("total"), F.size("vector").alias("width"))


_TOXIC = "(SELECT doc_id FROM labels WHERE toxic = 1)"


def toxic_documents(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "labels").where("toxic = 1").select(F.col("doc_id").alias("document_id"))


@query(
    "cascade_delete",
    f"""
WITH {DOCUMENTS}, {chunks_sql()}
SELECT 'documents' AS relation, CAST(doc_id AS VARCHAR) AS id FROM documents WHERE doc_id NOT IN {_TOXIC}
UNION ALL SELECT 'chunks', chunk_id FROM c WHERE document_id NOT IN {_TOXIC}
UNION ALL SELECT 'summaries', CAST(doc_id AS VARCHAR) FROM labels WHERE doc_id NOT IN {_TOXIC}
UNION ALL SELECT 'embeddings', chunk_id FROM c WHERE document_id NOT IN {_TOXIC}""",
)
def _cascade(spark: SparkSession, folder: str) -> DataFrame:
    chunks = chunk_documents(documents(spark, folder)).select("chunk_id", "document_id")
    left = maintenance.cascade_delete(
        toxic_documents(spark, folder), stored_documents(spark, folder), chunks, label_summaries(spark, folder),
        chunks.select("chunk_id"),
    )
    ids = {"documents": "document_id", "chunks": "chunk_id", "summaries": "document_id", "embeddings": "chunk_id"}
    parts = [
        left[name].select(F.lit(name).alias("relation"), F.col(key).cast("string").alias("id"))
        for name, key in ids.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    "orphan_check",
    f"""
WITH {DOCUMENTS}, {chunks_sql()}
SELECT 'chunks' AS relation, count(*) AS orphans FROM c WHERE document_id IN {_TOXIC}
UNION ALL SELECT 'summaries', count(*) FROM labels WHERE doc_id IN {_TOXIC}
UNION ALL SELECT 'embeddings', count(*) FROM embeddings WHERE sha256(concat(vec_id, ':0')) NOT IN (SELECT chunk_id FROM c)""",
)
def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    chunks = chunk_documents(documents(spark, folder)).select("chunk_id", "document_id")
    kept = stored_documents(spark, folder).join(toxic_documents(spark, folder), "document_id", "left_anti")
    embeddings = stored_vectors(spark, folder).select(
        F.sha2(F.concat(F.col("chunk_id").cast("string"), F.lit(":0")), 256).alias("chunk_id")
    )
    return maintenance.orphan_counts(kept, chunks, label_summaries(spark, folder), embeddings)


@query(
    "document_lookup",
    """
SELECT event_id AS document_id, CASE WHEN doc_id IS NULL THEN NULL ELSE concat(source, '/', doc_id, '.txt') END AS filename,
       CASE WHEN doc_id IS NULL THEN NULL ELSE 'processing' END AS status,
       CASE WHEN doc_id IS NULL THEN 'document not found' ELSE 'found' END AS outcome
FROM events LEFT JOIN documents ON doc_id = event_id""",
)
def _document_lookup(spark: SparkSession, folder: str) -> DataFrame:
    requests = events(spark, folder).select(F.col("event_id").alias("document_id"))
    return maintenance.document_lookup(requests, stored_documents(spark, folder))


@query(
    "summary_lookup",
    """
SELECT d.doc_id AS document_id, CASE WHEN l.doc_id IS NULL THEN NULL ELSE concat('quality ', quality) END AS summary,
       CASE WHEN l.doc_id IS NULL THEN NULL ELSE concat('toxic ', toxic) END AS key_points,
       CASE WHEN l.doc_id IS NULL THEN 'summary not ready' ELSE 'found' END AS outcome
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def _summary_lookup(spark: SparkSession, folder: str) -> DataFrame:
    found = maintenance.summary_lookup(
        documents(spark, folder).select("document_id"), label_summaries(spark, folder)
    )
    return found.withColumn("key_points", F.when(F.col("key_points").isNotNull(), F.array_join("key_points", "|")))


TTL = 10 * 24 * 60 * 60


def stored_answers(spark: SparkSession, folder: str, event_type: str) -> DataFrame:
    """Answers written at the events of one type; the key is the user."""
    return events(spark, folder).where(F.col("event_type") == event_type).select(
        F.col("user_id").alias("key"), F.col("value").alias("payload"),
        F.array("user_id", F.col("user_id") + 1).alias("document_ids"), F.col("ts").alias("written_at"),
    )


def answer_cache(spark: SparkSession, folder: str, event_type: str) -> DataFrame:
    entries = cache.cache_entries(stored_answers(spark, folder, event_type), TTL)
    return maintenance.latest_per_key(entries, ["key"], ["written_at"])


def _cache_sql(name: str, event_type: str) -> str:
    return f"""
{name} AS (
  SELECT user_id AS key, value AS payload, ts AS written_at, ts + INTERVAL 10 DAY AS expires_at FROM events
  WHERE event_type = '{event_type}' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1)"""


@query(
    "cache_write",
    f"""
WITH {_cache_sql('a', 'signup')}, {_cache_sql('b', 'purchase')},
m AS (SELECT * FROM b UNION ALL SELECT * FROM a WHERE key NOT IN (SELECT key FROM b))
SELECT key, payload, {timestamp_sql('written_at')} AS written_at, {timestamp_sql('expires_at')} AS expires_at FROM m""",
)
def _cache_write(spark: SparkSession, folder: str) -> DataFrame:
    written = cache.write_cache(
        answer_cache(spark, folder, "signup"), stored_answers(spark, folder, "purchase"), TTL
    )
    return written.select(
        "key", "payload", timestamp_text("written_at").alias("written_at"), timestamp_text("expires_at").alias("expires_at")
    )


_LIVE = "a.key = user_id AND ts >= written_at AND ts < expires_at"


def asks(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).select("event_id", F.col("user_id").alias("key"), F.col("ts").alias("asked_at"))


@query(
    "cache_lookup",
    f"""
WITH {_cache_sql('a', 'signup')}
SELECT event_id, a.key IS NOT NULL AS cached, payload FROM events LEFT JOIN a ON {_LIVE}""",
)
def _cache_lookup(spark: SparkSession, folder: str) -> DataFrame:
    found = cache.lookup(asks(spark, folder), answer_cache(spark, folder, "signup"))
    return found.select("event_id", "cached", "payload")


@query(
    "cache_misses",
    f"WITH {_cache_sql('a', 'signup')} SELECT event_id FROM events WHERE NOT EXISTS (SELECT 1 FROM a WHERE {_LIVE})",
)
def _cache_misses(spark: SparkSession, folder: str) -> DataFrame:
    return cache.misses(asks(spark, folder), answer_cache(spark, folder, "signup")).select("event_id")


@query(
    "cache_invalidate",
    f"WITH {_cache_sql('a', 'signup')} SELECT key, payload FROM a WHERE key NOT IN {_TOXIC} AND key + 1 NOT IN {_TOXIC}",
)
def _cache_invalidate(spark: SparkSession, folder: str) -> DataFrame:
    kept = cache.invalidate(answer_cache(spark, folder, "signup"), toxic_documents(spark, folder))
    return kept.select("key", "payload")


TABLES_SQL = f"""
WITH {DOCUMENTS}, {chunks_sql()}, {summaries_sql()},
n AS (SELECT document_id, count(*) AS n_chunks, CAST(sum(token_count) AS BIGINT) AS n_words FROM c GROUP BY document_id)
SELECT document_id, filename, 'ready' AS status, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_words, 0) AS n_words,
       coalesce(n_chunks, 0) AS n_embeddings, coalesce(summary, '') AS summary
FROM d LEFT JOIN n USING (document_id) LEFT JOIN s USING (document_id)"""


def per_document(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per document with the numbers of its rows in the other tables."""
    chunks = tables["chunks"].groupBy("document_id").agg(
        F.count("*").alias("n_chunks"), F.sum("token_count").alias("n_words")
    )
    vectors = tables["embeddings"].groupBy("document_id").agg(F.count("*").alias("n_embeddings"))
    joined = (
        tables["documents"].select("document_id", "filename", "status")
        .join(chunks, "document_id", "left").join(vectors, "document_id", "left")
        .join(tables["summaries"].select("document_id", "summary"), "document_id", "left")
    )
    return joined.na.fill(0, ["n_chunks", "n_words", "n_embeddings"])


@query("corpus_roundtrip", TABLES_SQL)
def _roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Analyse the corpus, write the four tables, read them back."""
    path = run_folder(spark, "corpus")
    save_tables(analyze_documents(documents(spark, folder), width=WIDTH), path, "0")
    return per_document(load_tables(spark, path))


@query("store_delete", f"{TABLES_SQL} WHERE document_id NOT IN {_TOXIC}")
def _store_delete(spark: SparkSession, folder: str) -> DataFrame:
    """Store the corpus, delete the documents labelled toxic, read what is left."""
    path = run_folder(spark, "corpus")
    save_tables(analyze_documents(documents(spark, folder), width=WIDTH), path, "0")
    delete_documents(toxic_documents(spark, folder), path)
    return per_document(load_tables(spark, path))


_GERMAN = 100  # words of a chunk when the German documents come again


@query(
    "store_versions",
    f"""
WITH {DOCUMENTS}, {chunks_sql()}, {chunks_sql(_GERMAN, 0, 'g')}, {summaries_sql()},
n AS (SELECT document_id, count(*) AS n_chunks, CAST(sum(token_count) AS BIGINT) AS n_words FROM c GROUP BY document_id),
m AS (SELECT document_id, count(*) AS n_chunks, CAST(sum(token_count) AS BIGINT) AS n_words FROM g GROUP BY document_id),
u AS (SELECT user_id * 10 AS document_id, {_STATUS_SQL} AS status FROM events
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
e AS (SELECT user_id AS document_id, event_type AS summary FROM events
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
SELECT d.document_id, filename,
       CASE WHEN quality = 0 THEN 'failed' WHEN lang = 'de' THEN 'ready' ELSE coalesce(u.status, 'ready') END AS status,
       coalesce(CASE WHEN lang = 'de' THEN m.n_chunks ELSE n.n_chunks END, 0) AS n_chunks,
       coalesce(CASE WHEN lang = 'de' THEN m.n_words ELSE n.n_words END, 0) AS n_words,
       coalesce(CASE WHEN lang = 'de' THEN m.n_chunks ELSE n.n_chunks END, 0) AS n_embeddings,
       coalesce(CASE WHEN lang <> 'de' THEN e.summary END, s.summary, '') AS summary
FROM d JOIN documents ON doc_id = d.document_id LEFT JOIN n ON n.document_id = d.document_id LEFT JOIN m ON m.document_id = d.document_id
LEFT JOIN s ON s.document_id = d.document_id LEFT JOIN u ON u.document_id = d.document_id LEFT JOIN e ON e.document_id = d.document_id
LEFT JOIN labels ON labels.doc_id = d.document_id
WHERE d.document_id NOT IN {_TOXIC}""",
)
def _store_versions(spark: SparkSession, folder: str) -> DataFrame:
    """A batch, later summaries and statuses, the German documents again with other windows, deletions, a compaction, more statuses."""
    path, docs = run_folder(spark, "versions"), documents(spark, folder)
    german = read_table(spark, folder, "documents").where("lang = 'de'").select(F.col("doc_id").alias("document_id"))
    register_model(spark, path, HASH_MODEL, WIDTH)
    save_tables(analyze_documents(docs, width=WIDTH), path, "all")
    log = events(spark, folder)
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "processing").otherwise("ready")
    updates = log.select((F.col("user_id") * 10).alias("document_id"), "ts", "event_id", status.alias("status"))
    update_statuses(updates, path, ["ts", "event_id"])
    summaries = log.select(F.col("user_id").alias("document_id"), "event_id", F.col("event_type").alias("summary"))
    summaries = maintenance.latest_per_key(summaries, ["document_id"], ["event_id"]).drop("event_id")
    save_rows({"summaries": summaries.withColumn("key_points", F.array().cast("array<string>"))}, path)
    save_tables(analyze_documents(docs.join(german, "document_id", "left_semi"), max_words=_GERMAN, overlap=0, width=WIDTH), path, "german")
    delete_documents(toxic_documents(spark, folder), path)
    compact(spark, path)
    poor = read_table(spark, folder, "labels").where("quality = 0").select(F.col("doc_id").alias("document_id"))
    update_statuses(poor.select("document_id", F.lit("failed").alias("status"), F.lit(1).alias("seq")), path, ["seq"])
    return per_document(load_tables(spark, path, newest=True))


_COMPACTED = "2024-01-20 00:00:00"


@query(
    "cache_folder",
    f"""
WITH a AS (
  SELECT user_id AS key, value AS payload, ts AS written_at, ts + INTERVAL 10 DAY AS expires_at FROM events
  WHERE event_type IN ('signup', 'purchase') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1),
l AS (
  SELECT * FROM a WHERE expires_at > TIMESTAMP '{_COMPACTED}' AND key NOT IN {_TOXIC} AND key + 1 NOT IN {_TOXIC})
SELECT event_id, l.key IS NOT NULL AS cached, payload FROM events LEFT JOIN l ON l.key = user_id AND ts >= written_at AND ts < expires_at""",
)
def _cache_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Answers added in two steps, those of toxic documents dropped by their links, the folder compacted, then asked."""
    path = run_folder(spark, "cache")
    for event_type in ("purchase", "signup"):
        entries = answer_cache(spark, folder, event_type)
        ids = F.transform("document_ids", lambda i: i.cast("string"))
        times = [F.col(c).cast("timestamp").alias(c) for c in ("written_at", "expires_at")]
        add_entries(entries.select(F.col("key").cast("string").alias("key"), "payload", ids.alias("document_ids"), *times), path)
    drop_answers(toxic_documents(spark, folder), path)
    compact_cache(spark, path, spark.sql(f"SELECT unix_timestamp(TIMESTAMP '{_COMPACTED}')").first()[0])
    asked = events(spark, folder).select("event_id", F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("asked_at"))
    found = cache.lookup(asked, entries_of(asked, path, "key string, payload double, document_ids array<string>, written_at timestamp, expires_at timestamp"))
    return found.select("event_id", "cached", "payload")


def _length_vectors(texts: list[str]) -> list[list[float]]:
    """A stand-in for a user model; vectors are scaled to length 1 afterwards."""
    return [[float(len(t)), 0.0] for t in texts]


@query(
    "embedding_cache_reuse",
    """
WITH e AS (SELECT text, min(item_id) AS first FROM benchmark GROUP BY text)
SELECT item_id AS question_id, first % 3 = 0 AS known, CAST(CASE WHEN first % 3 = 0 THEN first ELSE 1 END AS DOUBLE) AS value
FROM benchmark JOIN e USING (text)""",
)
def _embedding_cache_reuse(spark: SparkSession, folder: str) -> DataFrame:
    """Of the questions a third is known, a third has expired and a third was never embedded."""
    at = F.lit("2024-02-01 00:00:00").cast("timestamp")
    items = read_table(spark, folder, "benchmark")
    first = items.groupBy("text").agg(F.min("item_id").alias("first")).where("first % 3 <> 2")
    written = first.select(
        embedding_key(F.col("text")).alias("key"), F.array(F.col("first").cast("float"), F.lit(0.0).cast("float")).alias("vector"),
        F.when(F.col("first") % 3 == 0, at).otherwise(at - cache.seconds(TTL)).alias("written_at"),
    )
    asked = items.select(F.col("item_id").alias("question_id"), F.col("text").alias("question"), at.alias("written_at"))
    vectors = question_vectors(asked, 2, _length_vectors, cache.cache_entries(written, TTL))
    return vectors.select("question_id", "known", F.element_at("vector", 1).cast("double").alias("value"))
