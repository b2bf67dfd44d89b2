"""Queries: chunking, text preparation, embedding, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.catalog import query
from folioquery.catalog.inputs import (
    DOCUMENTS,
    WIDTH,
    chunks_sql,
    clean_sql,
    documents,
    hashed_sql,
    preview_sql,
    sentences_sql,
    trim_sql,
    unit_sql,
    words_sql,
)
from folioquery.functions.keys import chunk_id
from folioquery.functions.text import clean_text, enriched_text, preview, words
from folioquery.operators import chunking, embedding, summarizing
from folioquery.plans.analyze import summaries_of
from folioquery.sources.files import read_table

CHUNK_COLUMNS = "document_id, ord, text, token_count"


def _chunk_query(name: str, max_words: int, overlap: int) -> None:
    @query(name, f"WITH {DOCUMENTS}, {chunks_sql(max_words, overlap)} SELECT {CHUNK_COLUMNS} FROM c")
    def _chunks(spark: SparkSession, folder: str) -> DataFrame:
        return chunking.chunk_documents(documents(spark, folder), max_words, overlap).drop("chunk_id")


_chunk_query("chunk_documents", 400, 80)
_chunk_query("chunk_no_overlap", 100, 0)
_chunk_query("chunk_wide_overlap", 50, 60)


@query("word_counts", f"SELECT doc_id AS document_id, len({words_sql('text')}) AS n_words FROM documents")
def _word_counts(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("document_id", F.size(words(F.col("content"))).cast("bigint").alias("n_words"))


@query("chunk_ids", f"WITH {DOCUMENTS}, {chunks_sql()} SELECT chunk_id, document_id, ord FROM c")
def _chunk_ids(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.chunk_documents(documents(spark, folder)).select("chunk_id", "document_id", "ord")


@query(
    "list_chunks",
    f"""
WITH {DOCUMENTS}, {chunks_sql()}
SELECT chunk_id, {CHUNK_COLUMNS} FROM c WHERE document_id IN (SELECT doc_id FROM labels)""",
)
def _list_chunks(spark: SparkSession, folder: str) -> DataFrame:
    asked = read_table(spark, folder, "labels").select(F.col("doc_id").alias("document_id"))
    return chunking.list_chunks(chunking.chunk_documents(documents(spark, folder)), asked)


_DIRTY = "concat(' ', chr(9), replace(text, ' ', chr(1) || ' ' || chr(9)), chr(127), chr(10))"


@query("clean_text", f"SELECT doc_id AS document_id, {clean_sql(_DIRTY)} AS text FROM documents")
def _clean(spark: SparkSession, folder: str) -> DataFrame:
    dirty = F.concat(F.lit(" \t"), F.replace("content", F.lit(" "), F.lit("\x01 \t")), F.lit("\x7f\n"))
    return documents(spark, folder).select("document_id", clean_text(dirty).alias("text"))


@query(
    "enrich_chunks",
    f"""
WITH {DOCUMENTS}, {chunks_sql()}
SELECT chunk_id, concat('Document: ', filename, chr(10), chr(10), text) AS enriched FROM c""",
)
def _enrich(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return chunking.enrich_chunks(chunking.chunk_documents(docs), docs).select("chunk_id", "enriched")


ENRICHED = "e AS (SELECT *, concat('Document: ', filename, chr(10), chr(10), text) AS enriched FROM c)"


def enriched_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks with their enriched text; the file name travels with the chunk, no join."""
    cut = chunking.chunk_documents(documents(spark, folder), keep=("filename", "collection"))
    return cut.withColumn("enriched", enriched_text(F.col("filename"), F.col("text")))


PLACED_BYTES = 8 * 1024 * 1024  # of text that one task embeds in long form


@query(
    "hash_embed_chunks",
    f"""
WITH {DOCUMENTS}, {chunks_sql()}, {ENRICHED}, {hashed_sql('e', 'chunk_id', 'enriched', 'h')}
SELECT chunk_id, bucket, value, '{embedding.HASH_MODEL}' AS model FROM h""",
)
def _hash_chunks(spark: SparkSession, folder: str) -> DataFrame:
    # Texts are placed by document once; grouping by document and position needs no exchange
    # then, and the short keys travel with every word instead of the chunk id.
    # The number of partitions follows the bytes of text, so that what a task sums up stays small.
    docs = documents(spark, folder)
    n_bytes = docs.agg(F.sum(F.octet_length("content").cast("bigint"))).first()[0] or 0
    n_parts = max(spark.sparkContext.defaultParallelism, -(-n_bytes // PLACED_BYTES))
    placed = docs.repartition(n_parts, "document_id")
    cut = chunking.chunk_documents(placed, keep=("filename",))
    enriched = cut.withColumn("enriched", enriched_text(F.col("filename"), F.col("text")))
    sparse = embedding.hash_embed_sparse(enriched, ["document_id", "ord"], "enriched", WIDTH)
    return sparse.select(
        chunk_id(F.col("document_id"), F.col("ord")).alias("chunk_id"), "bucket", "value",
        F.lit(embedding.HASH_MODEL).alias("model"),
    )


_TURNS = "q AS (SELECT conv_id, turn, role, CASE WHEN turn % 4 = 2 THEN ' ' || chr(1) ELSE text END AS question FROM conversations)"


@query(
    "hash_embed_questions",
    f"""
WITH {_TURNS}, qk AS (SELECT concat(conv_id, ':', turn, ':', role, ':', md5(question)) AS question_id, question FROM q),
{hashed_sql('qk', 'question_id', 'question', 'h')}, {unit_sql('h', 'question_id', 'u')}
SELECT question_id, bucket, round(x, 6) AS value, CAST(NULL AS VARCHAR) AS error FROM u_unit
UNION ALL
SELECT question_id, NULL, NULL, '{embedding.EMPTY_TEXT_ERROR}' FROM qk WHERE {clean_sql('question')} = ''""",
)
def _hash_questions(spark: SparkSession, folder: str) -> DataFrame:
    text = F.when(F.col("turn") % 4 == 2, F.lit(" \x01")).otherwise(F.col("text"))
    asked = read_table(spark, folder, "conversations").select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role", F.md5(text)).alias(
            "question_id"
        ),
        text.alias("question"),
    )
    embedded = embedding.embed_questions(asked, "question", WIDTH)
    return (
        embedded.select("question_id", "error", F.posexplode_outer("vector").alias("bucket", "value"))
        .where("value <> 0 OR error IS NOT NULL")
        .select("question_id", "bucket", F.round(F.col("value").cast("double"), 6).alias("value"), "error")
    )


def _count_model(texts: list[str]) -> list[list[float]]:
    """A stand-in for a user model: characters, blanks and a constant."""
    return [[float(len(t)), float(t.count(" ")), 1.0] for t in texts]


@query(
    "embed_map_in_pandas",
    f"""
WITH {DOCUMENTS}, {chunks_sql()}, {ENRICHED},
t AS (SELECT chunk_id, {clean_sql('enriched')} AS text FROM e),
v AS (SELECT chunk_id, CAST(length(text) AS DOUBLE) AS a, CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS b
      FROM t WHERE text <> '')
SELECT chunk_id, round(CAST(a / sqrt(a * a + b * b + 1) AS FLOAT)::DOUBLE, 6) AS x,
       round(CAST(b / sqrt(a * a + b * b + 1) AS FLOAT)::DOUBLE, 6) AS y,
       round(CAST(1 / sqrt(a * a + b * b + 1) AS FLOAT)::DOUBLE, 6) AS z
FROM v""",
)
def _embed_map(spark: SparkSession, folder: str) -> DataFrame:
    vectors = embedding.embed_texts(enriched_chunks(spark, folder), _count_model, "chunk_id", "enriched")
    return vectors.select(
        "chunk_id", *[F.round(F.element_at("vector", i).cast("double"), 6).alias(c) for i, c in ((1, "x"), (2, "y"), (3, "z"))]
    )


@query(
    "embed_once",
    f"""
WITH {DOCUMENTS}, t AS (SELECT content FROM d GROUP BY content),
h0 AS (SELECT sha256(content) AS text_key, content FROM t),
{hashed_sql('h0', 'text_key', 'content', 'h')}, s AS (SELECT text_key, count(*) AS cells, sum(abs(value)) AS mass FROM h GROUP BY ALL)
SELECT document_id, sha256(content) AS text_key, coalesce(cells, 0) AS n_cells
FROM d LEFT JOIN s ON s.text_key = sha256(d.content)""",
)
def _embed_once(spark: SparkSession, folder: str) -> DataFrame:
    def embed(texts: DataFrame) -> DataFrame:
        return embedding.hash_embed(texts, "text", WIDTH)

    once = embedding.embed_once(documents(spark, folder), "document_id", "content", embed)
    cells = F.size(F.filter(F.coalesce("vector", F.array().cast("array<float>")), lambda x: x != 0))
    return once.select("document_id", "text_key", cells.cast("bigint").alias("n_cells"))


@query(
    "concat_chunks",
    f"""
WITH {DOCUMENTS}, {chunks_sql()},
t AS (SELECT document_id, string_agg(text || chr(10), '' ORDER BY ord) AS content FROM c GROUP BY document_id)
SELECT document_id, coalesce(t.content, '') AS content FROM d LEFT JOIN t USING (document_id)""",
)
def _concat(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return chunking.concat_chunks(chunking.chunk_documents(docs), docs)


PAYLOADS = f"""
WITH {DOCUMENTS}, {chunks_sql()}, p AS (SELECT document_id, list(chunk_id ORDER BY ord) AS ids FROM c GROUP BY document_id)
SELECT document_id, array_to_string(ids, ',') AS chunk_ids,
       concat('{{"chunk_ids":', CASE WHEN ids IS NULL THEN 'null' ELSE concat('["', array_to_string(ids, '","'), '"]') END,
              ',"document_id":"', document_id, '"}}') AS payload
FROM d LEFT JOIN p USING (document_id)"""


@query("analyze_payloads", PAYLOADS)
def _payloads(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    payloads = chunking.analyze_payloads(chunking.chunk_documents(docs), docs)
    return payloads.withColumn("chunk_ids", F.array_join("chunk_ids", ","))


@query("preview", f"SELECT doc_id AS document_id, {preview_sql('text')} AS preview FROM documents")
def _preview(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("document_id", preview(F.col("content")).alias("preview"))


_LINES = "list_transform(string_split(text, chr(10)), lambda l, i: CASE WHEN i % 2 = 0 THEN ' - ' || l ELSE l END)"


@query(
    "parse_summary",
    f"""
WITH r AS (SELECT doc_id AS document_id, {_LINES} AS lines FROM documents),
t AS (SELECT document_id, list_filter(list_transform(lines, lambda l: {trim_sql('l')}), lambda l: l <> '') AS lines FROM r)
SELECT document_id,
       coalesce(array_to_string(list_filter(lines, lambda l: NOT regexp_matches(l, '^[-*]')), ' '), '') AS summary,
       coalesce(array_to_string(list_transform(list_filter(lines, lambda l: regexp_matches(l, '^[-*]')),
         lambda l: regexp_replace(l, '^[-* ]+', '')), '|'), '') AS key_points
FROM t""",
)
def _parse_summary(spark: SparkSession, folder: str) -> DataFrame:
    lines = F.transform(F.split("content", "\n"), lambda l, i: F.when(i % 2 == 1, F.concat(F.lit(" - "), l)).otherwise(l))
    responses = documents(spark, folder).select("document_id", F.array_join(lines, "\n").alias("response"))
    return summarizing.parse_responses(responses).withColumn("key_points", F.array_join("key_points", "|"))


def summaries_sql(name: str = "s") -> str:
    """CTEs from `d` to extractive summaries (document_id, summary, key_points VARCHAR[])."""
    return f"""
{name}_parts AS (SELECT document_id, {sentences_sql('content')} AS parts FROM d),
{name}_sent AS (
  SELECT document_id, unnest(range(0, len(parts))) AS pos, unnest(parts) AS sentence FROM {name}_parts),
{name}_words AS (
  SELECT document_id, pos, sentence, unnest({words_sql('lower(sentence)')}) AS word FROM {name}_sent WHERE sentence <> ''),
{name}_freq AS (SELECT document_id, word, count(*) AS n FROM {name}_words GROUP BY ALL),
{name}_score AS (
  SELECT document_id, pos, sentence, round(avg(n), 9) AS score
  FROM {name}_words JOIN {name}_freq USING (document_id, word) GROUP BY ALL),
{name}_rank AS (
  SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, pos) AS rank FROM {name}_score),
{name} AS (
  SELECT document_id, max(sentence) FILTER (WHERE rank = 1) AS summary,
         coalesce(list(sentence ORDER BY rank) FILTER (WHERE rank BETWEEN 2 AND 4), []) AS key_points
  FROM {name}_rank GROUP BY document_id)"""


_SUMMARIES = f"""
WITH {DOCUMENTS}, {summaries_sql()}
SELECT document_id, summary, coalesce(array_to_string(key_points, '|'), '') AS key_points FROM s"""


@query("summarize_extractive", _SUMMARIES)
def _summaries(spark: SparkSession, folder: str) -> DataFrame:
    found = summarizing.extractive_summaries(documents(spark, folder))
    return found.withColumn("key_points", F.array_join("key_points", "|"))


@query("summarize_relational", _SUMMARIES)
def _summaries_relational(spark: SparkSession, folder: str) -> DataFrame:
    found = summarizing.extractive_summaries_relational(documents(spark, folder))
    return found.withColumn("key_points", F.array_join("key_points", "|"))


def _count_summaries(texts: list[str]) -> list[str]:
    """A stand-in for a user model: a response of one line and one bullet."""
    return [f"{len(text.split())} words\n- {len(text)} characters" for text in texts]


@query(
    "summarize_map_in_pandas",
    f"""
WITH {DOCUMENTS}, {chunks_sql()},
t AS (SELECT document_id, string_agg(text || chr(10), '' ORDER BY ord) AS content FROM c GROUP BY document_id),
a AS (SELECT document_id, coalesce(t.content, '') AS content FROM d LEFT JOIN t USING (document_id))
SELECT document_id, concat(len({words_sql('content')}), ' words') AS summary, concat(length(content), ' characters') AS key_points
FROM a""",
)
def _model_summaries(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    found = summaries_of(docs, chunking.chunk_documents(docs), _count_summaries)
    return found.withColumn("key_points", F.array_join("key_points", "|"))
