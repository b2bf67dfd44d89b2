"""Queries over text: retrieval for text questions, contexts, sources, answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.catalog import query
from folioquery.catalog.chunks import ENRICHED, enriched_chunks, summaries_sql
from folioquery.catalog.inputs import (
    DOCUMENTS,
    TEXT_THRESHOLD,
    WIDTH,
    chunks_sql,
    documents,
    hashed_sql,
    preview_sql,
    sentences_sql,
    unit_sql,
    uuid_of,
    uuid_sql,
)
from folioquery.operators import answering
from folioquery.operators.embedding import HASH_MODEL, embed_chunks, embed_questions
from folioquery.operators.retrieval import retrieve
from folioquery.operators.summarizing import extractive_summaries
from folioquery.plans.analyze import analyze_documents
from folioquery.plans.ask import answer_questions
from folioquery.session import materialize
from folioquery.sources.files import read_table

K = 5


def text_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items as questions; each asks two of the collections."""
    item = F.col("item_id")
    collections = F.array(
        F.concat(F.lit("src"), (item % 20).cast("string")), F.concat(F.lit("src"), ((item * 7 + 3) % 20).cast("string"))
    )
    return read_table(spark, folder, "benchmark").select(
        item.alias("question_id"), F.col("text").alias("question"), collections.alias("scopes")
    )


def text_hits(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(questions, hits with chunk texts) over the whole corpus."""
    questions = text_questions(spark, folder)
    chunks = enriched_chunks(spark, folder)
    vectors = embed_chunks(chunks, WIDTH)
    asked = embed_questions(questions, "question", WIDTH).select("question_id", "vector")
    with_text = retrieve(
        asked, vectors, chunks.select("chunk_id", "text"), scope=None, threshold=TEXT_THRESHOLD, k=K
    )
    return questions.drop("scopes"), with_text


def _hits_sql(condition: str = "true") -> str:
    """CTEs up to hit (question_id, chunk_id, similarity, rank, text, ...) for text questions."""
    return f"""
WITH {DOCUMENTS}, {chunks_sql()}, {ENRICHED}, {hashed_sql('e', 'chunk_id', 'enriched', 'h')}, {unit_sql('h', 'chunk_id', 'cv')},
q AS (SELECT item_id AS question_id, text AS question FROM benchmark),
{hashed_sql('q', 'question_id', 'question', 'hq')}, {unit_sql('hq', 'question_id', 'qv')},
dots AS (SELECT question_id, chunk_id, sum(qv_unit.x * cv_unit.x) AS dot FROM qv_unit JOIN cv_unit USING (bucket) GROUP BY ALL),
sims AS (
  SELECT question_id, chunk_id, collection, round(dot / (qv_norm.norm * cv_norm.norm), 9) AS similarity
  FROM dots JOIN qv_norm USING (question_id) JOIN cv_norm USING (chunk_id) JOIN c USING (chunk_id)),
ranked AS (
  SELECT question_id, chunk_id, similarity,
         row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC, chunk_id) AS rank
  FROM sims WHERE similarity >= {TEXT_THRESHOLD} AND {condition}),
hit AS (
  SELECT question_id, chunk_id, similarity, CAST(rank AS INTEGER) AS rank, document_id, ord, token_count, text
  FROM ranked JOIN c USING (chunk_id) WHERE rank <= {K})"""


_SCOPED = "collection IN ('src' || (question_id % 20), 'src' || ((question_id * 7 + 3) % 20))"


@query(
    "retrieve",
    f"""{_hits_sql(_SCOPED)}, {summaries_sql()}
SELECT question_id, rank, chunk_id, hit.document_id, ord, token_count, text, round(similarity, 6) AS similarity,
       '{HASH_MODEL}' AS model, coalesce(summary, '') AS summary,
       coalesce(array_to_string(key_points, '|'), '') AS key_points
FROM hit LEFT JOIN s ON s.document_id = hit.document_id""",
)
def retrieve_text(spark: SparkSession, folder: str) -> DataFrame:
    """Flagship: questions restricted to collections, over chunks embedded from all documents."""
    docs = documents(spark, folder)
    chunks = enriched_chunks(spark, folder)
    vectors = embed_chunks(chunks, WIDTH, keep=("collection",))
    questions = embed_questions(text_questions(spark, folder), "question", WIDTH)
    hits = retrieve(
        questions.select("question_id", "vector", "scopes"),
        vectors,
        chunks.select("chunk_id", "document_id", "ord", "text", "token_count"),
        extractive_summaries(docs),
        scope="collection",
        threshold=TEXT_THRESHOLD,
        k=K,
    )
    return hits.withColumns(
        {"similarity": F.round("similarity", 6), "key_points": F.array_join("key_points", "|")}
    )


_CONTEXT = """
ctx AS (SELECT question_id, string_agg(text || chr(10), '' ORDER BY rank) AS context, avg(similarity) AS quality FROM hit GROUP BY question_id),
full_ctx AS (SELECT q.question_id, q.question, coalesce(context, '') AS context, coalesce(quality, 0.0) AS quality FROM q LEFT JOIN ctx USING (question_id))"""


@query("build_context", f"{_hits_sql()}, {_CONTEXT} SELECT question_id, context FROM full_ctx")
def _context(spark: SparkSession, folder: str) -> DataFrame:
    return answering.build_context(*text_hits(spark, folder))


@query("context_quality", f"{_hits_sql()}, {_CONTEXT} SELECT question_id, round(quality, 6) AS quality FROM full_ctx")
def _quality(spark: SparkSession, folder: str) -> DataFrame:
    quality = answering.context_quality(*text_hits(spark, folder))
    return quality.withColumn("quality", F.round("quality", 6))


@query(
    "build_sources",
    f"""{_hits_sql()}
SELECT question_id, rank - 1 AS pos, chunk_id, round(similarity, 6) AS score, {preview_sql('text')} AS preview FROM hit""",
)
def _sources(spark: SparkSession, folder: str) -> DataFrame:
    sources = answering.build_sources(*text_hits(spark, folder))
    return sources.select("question_id", F.posexplode("sources").alias("pos", "s")).select(
        "question_id", "pos", "s.chunk_id", F.round("s.score", 6).alias("score"), "s.preview"
    )


def log_probabilities(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "events").select(
        F.col("user_id").alias("question_id"), (-F.col("value") / 100).alias("logprob")
    )


_TOKENS = """
tok AS (SELECT user_id AS question_id, avg(exp(-value / 100)) AS confidence FROM events GROUP BY user_id)"""


@query(
    "token_confidence",
    f"""WITH {_TOKENS}
SELECT doc_id AS question_id, round(coalesce(confidence, 1.0), 6) AS confidence
FROM documents LEFT JOIN tok ON tok.question_id = doc_id""",
)
def _token_confidence(spark: SparkSession, folder: str) -> DataFrame:
    answers = read_table(spark, folder, "documents").select(F.col("doc_id").alias("question_id"))
    tokens = answering.token_confidence(answers, log_probabilities(spark, folder), "question_id")
    return tokens.withColumn("confidence", F.round("confidence", 6))


@query(
    "answer_confidence",
    f"""{_hits_sql()}, {_CONTEXT}, {_TOKENS}
SELECT question_id, round(quality * coalesce(confidence, 1.0), 6) AS confidence
FROM full_ctx LEFT JOIN tok USING (question_id)""",
)
def _answer_confidence(spark: SparkSession, folder: str) -> DataFrame:
    questions, hits = text_hits(spark, folder)
    quality = answering.context_quality(questions, hits)
    tokens = answering.token_confidence(questions, log_probabilities(spark, folder), "question_id")
    combined = answering.answer_confidence(quality, tokens, "question_id")
    return combined.withColumn("confidence", F.round("confidence", 6))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


INSTRUCTION = "Use only the passages below."


@query(
    "build_prompts",
    f"""{_hits_sql()}, {_CONTEXT}
SELECT question_id, 'system' AS role, {_quoted(INSTRUCTION)} AS content FROM full_ctx
UNION ALL
SELECT question_id, 'user', concat('Context:', chr(10), context, chr(10), chr(10), 'Question: ', question) FROM full_ctx""",
)
def _prompts(spark: SparkSession, folder: str) -> DataFrame:
    questions, hits = text_hits(spark, folder)
    contexts = answering.per_question(questions, hits)
    messages = F.explode(answering.prompt(F.col("context"), F.col("question"), INSTRUCTION)).alias("m")
    return contexts.select("question_id", messages).select("question_id", "m.role", "m.content")


def spoken_sql(text: str) -> str:
    """Letters, marks and digits; what lies between parts them."""
    return f"list_filter(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda x: x <> '')"


def _answers_sql(hits: str = "hit", questions: str = "q") -> str:
    """CTE answer (question_id, answer) of the extractive answerer."""
    return f"""
asked AS (SELECT question_id, list_distinct({spoken_sql('question')}) AS ws FROM {questions}),
parts AS (SELECT question_id, rank, {sentences_sql('text')} AS parts FROM {hits}),
sent AS (SELECT question_id, rank, unnest(range(0, len(parts))) AS pos, unnest(parts) AS sentence FROM parts),
scored AS (
  SELECT question_id, rank, pos, sentence,
         len(list_intersect(ws, list_distinct({spoken_sql('sentence')}))) AS score
  FROM sent JOIN asked USING (question_id) WHERE sentence <> ''),
chosen AS (
  SELECT question_id, sentence, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, rank, pos) AS r FROM scored),
answer AS (
  SELECT a.question_id, coalesce(sentence, {_quoted(answering.NOT_ENOUGH_INFORMATION)}) AS answer
  FROM {questions} a LEFT JOIN chosen ON chosen.question_id = a.question_id AND r = 1)"""


@query("answer_extractive", f"{_hits_sql()}, {_answers_sql()} SELECT question_id, answer FROM answer")
def _answers(spark: SparkSession, folder: str) -> DataFrame:
    return answering.extractive_answers(*text_hits(spark, folder))


ASK_THRESHOLD = 0.3
ASKED_DOCUMENTS = 20


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select(uuid_of(F.col("document_id")).alias("document_id"), "filename", "content")


def question_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Every benchmark item asked of twenty documents from all over the corpus; every ninth names a malformed id."""
    item = F.col("item_id")
    n = 1 + (documents(spark, folder).agg(F.max("document_id")).first()[0] or 0)
    places = F.sequence(F.lit(0), F.lit(ASKED_DOCUMENTS - 1))
    asked_of = F.transform(places, lambda i: uuid_of((item + i * max(n // ASKED_DOCUMENTS, 1)) % n))
    return read_table(spark, folder, "benchmark").select(
        item.cast("string").alias("question_id"),
        F.col("text").alias("question"),
        F.when(item % 9 == 8, F.array(F.lit("none"))).otherwise(asked_of).alias("document_ids"),
        (item % 7).cast("int").alias("top_k"),
        F.lit("2024-02-01 00:00:00").cast("timestamp").alias("asked_at"),
    )


@query(
    "answer_questions",
    f"""
WITH {DOCUMENTS.replace('doc_id AS document_id', f"{uuid_sql('doc_id')} AS document_id")}, {chunks_sql()}, {ENRICHED},
{hashed_sql('e', 'chunk_id', 'enriched', 'h')}, {unit_sql('h', 'chunk_id', 'cv')},
q AS (
  SELECT CAST(item_id AS VARCHAR) AS question_id, text AS question,
         CASE WHEN item_id % 7 = 0 THEN 5 ELSE item_id % 7 END AS top_k,
         list_transform(range(0, {ASKED_DOCUMENTS}), lambda i: {uuid_sql('((item_id + i * greatest(n // 20, 1)) % n)')}) AS ids
  FROM benchmark, (SELECT coalesce(max(doc_id), 0) + 1 AS n FROM documents) WHERE item_id % 9 <> 8 AND length(text) BETWEEN 3 AND 500),
{hashed_sql('q', 'question_id', 'question', 'hq')}, {unit_sql('hq', 'question_id', 'qv')},
dots AS (SELECT question_id, chunk_id, sum(qv_unit.x * cv_unit.x) AS dot FROM qv_unit JOIN cv_unit USING (bucket) GROUP BY ALL),
sims AS (
  SELECT question_id, chunk_id, text, round(dot / (qv_norm.norm * cv_norm.norm), 9) AS similarity, top_k
  FROM dots JOIN qv_norm USING (question_id) JOIN cv_norm USING (chunk_id) JOIN c USING (chunk_id) JOIN q USING (question_id)
  WHERE list_contains(ids, document_id)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC, chunk_id) AS rank
  FROM sims WHERE similarity >= {ASK_THRESHOLD}),
hit AS (SELECT * FROM ranked WHERE rank <= top_k),
quality AS (
  SELECT question_id, avg(similarity) AS quality, count(*) AS n, string_agg(chunk_id, ',' ORDER BY rank) AS ids
  FROM hit GROUP BY question_id), {_answers_sql()}
SELECT question_id, answer, round(coalesce(quality, 0.0), 6) AS confidence, coalesce(n, 0) AS n_sources,
       coalesce(quality.ids, '') AS source_ids, false AS cached, CAST(NULL AS VARCHAR) AS error
FROM answer LEFT JOIN quality USING (question_id)
UNION ALL
SELECT CAST(item_id AS VARCHAR), NULL, NULL, NULL, NULL, NULL,
       array_to_string(list_filter([CASE WHEN length(text) > 500 THEN 'Question must be at most 500' END,
         CASE WHEN item_id % 9 = 8 THEN 'DocumentIDs[0] must be a valid UUID' END], lambda m: m IS NOT NULL), '; ')
FROM benchmark WHERE item_id % 9 = 8 OR length(text) > 500""",
)
def _answer_questions(spark: SparkSession, folder: str) -> DataFrame:
    tables = analyze_documents(corpus(spark, folder), width=WIDTH)
    tables = {name: materialize(tables[name], name) for name in ("chunks", "embeddings")}
    result = answer_questions(question_requests(spark, folder), tables, threshold=ASK_THRESHOLD, width=WIDTH)
    answered = result.answers.select(
        "question_id", "answer", F.round("confidence", 6).alias("confidence"),
        F.size("sources").cast("bigint").alias("n_sources"),
        F.array_join(F.transform("sources", lambda s: s["chunk_id"]), ",").alias("source_ids"), "cached",
        F.lit(None).cast("string").alias("error"),
    )
    return answered.unionByName(result.rejected, allowMissingColumns=True)


@query(
    "answer_json",
    f"""{_hits_sql()}, {_CONTEXT}, {_answers_sql()},
first AS (SELECT question_id, chunk_id FROM hit WHERE rank = 1)
SELECT question_id, answer, round(quality, 6) AS confidence, chunk_id AS first_source, 'false' AS cached
FROM answer JOIN full_ctx USING (question_id) LEFT JOIN first USING (question_id)""",
)
def _answer_json(spark: SparkSession, folder: str) -> DataFrame:
    """Answers as JSON documents, read back field by field."""
    questions, hits = text_hits(spark, folder)
    contexts = answering.per_question(questions, hits)
    answers = contexts.join(answering.extractive_answers(questions, hits), "question_id")
    encoded = answering.answer_json(answers.withColumns({"confidence": F.col("quality"), "cached": F.lit(False)}))

    def field(path: str) -> Column:
        return F.get_json_object("json", path)

    return encoded.select(
        "question_id", field("$.answer").alias("answer"),
        F.round(field("$.confidence").cast("double"), 6).alias("confidence"),
        field("$.sources[0].chunk_id").alias("first_source"), field("$.cached").alias("cached"),
    )


def _count_answers(questions: list[str], contexts: list[str]) -> list[tuple[str, list[float] | None]]:
    """A stand-in for a user model: sizes as the answer, two token log-probabilities."""
    return [(f"{len(q)} / {len(c)}", [-0.1, -0.2] if c else None) for q, c in zip(questions, contexts)]


@query(
    "answer_map_in_pandas",
    f"""{_hits_sql()}, {_CONTEXT}
SELECT question_id, concat(length(question), ' / ', length(context)) AS answer,
       round(quality * CASE WHEN context = '' THEN 1.0 ELSE (exp(-0.1) + exp(-0.2)) / 2 END, 6) AS confidence
FROM full_ctx""",
)
def _model_answers(spark: SparkSession, folder: str) -> DataFrame:
    contexts = answering.per_question(*text_hits(spark, folder))
    answers = answering.model_answers(contexts, _count_answers)
    return answers.select("question_id", "answer", F.round("confidence", 6).alias("confidence"))
