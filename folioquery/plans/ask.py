"""A batch of question requests -> answers, with result and embedding caches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquery.functions.keys import embedding_key, query_key
from folioquery.functions.text import clean_text
from folioquery.functions.validation import effective_top_k, parse_document_ids, request_errors
from folioquery.operators.answering import Answerer, extractive_answers, model_answers, per_question
from folioquery.operators.cache import DEFAULT_TTL_SECONDS, cache_entries, lookup, misses
from folioquery.operators.embedding import DEFAULT_WIDTH, Embedder, embed_once, embed_questions, embed_texts
from folioquery.operators.ivf import InvertedFile
from folioquery.operators.retrieval import retrieve
from folioquery.operators.similarity import MIN_SIMILARITY
from folioquery.schemas import SOURCES
from folioquery.session import materialize


#: Entries of a cache: the table itself, or a function that gives the entries of the keys it is handed.
Entries = DataFrame | Callable[[DataFrame], DataFrame] | None

COMPUTED = f"key string, answer string, confidence double, sources {SOURCES}, document_ids array<string>, written_at timestamp"


@dataclass
class AskResult:
    answers: DataFrame  # question_id, question, answer, confidence, sources, cached
    rejected: DataFrame  # question_id, error
    cache_entries: DataFrame  # key, answer, confidence, sources, document_ids, written_at, expires_at
    embedding_entries: DataFrame  # key, vector, written_at, expires_at


def validated(requests: DataFrame) -> DataFrame:
    """requests(question_id, question, document_ids, top_k) with `error` and the effective top_k."""
    errors = request_errors(F.col("question"), F.col("document_ids"), F.col("top_k"))
    error = F.nullif(F.array_join(errors, "; "), F.lit(""))
    # Nothing that could be embedded is left of the question.
    blank = F.when(clean_text(F.col("question")) == "", F.lit("Question is blank"))
    return requests.withColumn("error", F.coalesce(error, blank)).withColumn("top_k", effective_top_k(F.col("top_k")))


def question_vectors(
    pending: DataFrame, width: int, embed_fn: Embedder | None, embedding_cache: Entries = None
) -> DataFrame:
    """pending(question_id, question, written_at) -> question_id, vector, known.

    A question with a live entry in embedding_cache(key, vector, written_at, expires_at) takes its vector from
    there (`known`); of the others each text is embedded once. The cache belongs to one model.
    """

    def embed(texts: DataFrame) -> DataFrame:
        if embed_fn is None:
            return embed_questions(texts, "text", width).select("text_key", "vector")
        return embed_texts(texts, embed_fn, "text_key", "text")

    def embedded(texts: DataFrame) -> DataFrame:
        vectors = embed_once(texts, "question_id", "question", embed)
        return vectors.select("question_id", "vector", F.lit(False).alias("known"))

    if embedding_cache is None:
        return embedded(pending)
    asked = pending.select("question_id", "question", embedding_key(F.col("question")).alias("key"), F.col("written_at").alias("asked_at"))
    held = embedding_cache(asked.select("key").distinct()) if callable(embedding_cache) else embedding_cache
    entries = held.select("key", "vector", "written_at", "expires_at")
    known = lookup(asked, entries).where("cached").select("question_id", "vector", F.lit(True).alias("known"))
    return known.unionByName(embedded(misses(asked, entries)))


def embedding_entries(pending: DataFrame, ttl_seconds: int) -> DataFrame:
    """The cache entries of the questions that were embedded, one per text."""
    new = pending.where("vector IS NOT NULL AND NOT known").groupBy(embedding_key(F.col("question")).alias("key"))
    return cache_entries(
        new.agg(F.min_by("vector", "question_id").alias("vector"), F.min("written_at").alias("written_at")), ttl_seconds
    )


def foreign_widths(pending: DataFrame, embeddings: DataFrame | None, widths: list[int] | None) -> dict[int, str]:
    """Widths of question vectors that no stored vector has, with the error to report.

    `widths` are those of the registered models. Without them the stored vectors are looked through, and
    the first one of a width ends its search. An empty store has no width to differ from.
    """
    asked = [r["width"] for r in pending.where("vector IS NOT NULL").select(F.size("vector").alias("width")).distinct().collect()]
    if widths is None:
        if embeddings is None or embeddings.isEmpty():
            return {}
        widths = [w for w in asked if not embeddings.where(F.size("vector") == w).isEmpty()]
    return {w: f"the question's vector is {w} wide, no stored vector is" for w in asked if w not in widths}


def _computed(pending, tables, answer_fn, stored, **search) -> DataFrame:
    """Answers of the pending questions under their keys."""
    hits = retrieve(
        pending.where("vector IS NOT NULL").select("question_id", "vector", "scopes", "top_k"),
        tables.get("embeddings"),
        tables["chunks"],
        **search,
    )
    hits = stored(hits.select("question_id", "rank", "chunk_id", "similarity", "text"), "hits")
    questions = pending.select("question_id", "question", "document_ids", "written_at")
    contexts = per_question(questions, hits)
    if answer_fn is None:
        answered = contexts.join(extractive_answers(questions, hits), "question_id").withColumn(
            "confidence", F.col("quality")
        )
    else:
        answered = model_answers(contexts, answer_fn)
    return answered.select(
        F.col("question_id").alias("key"), "answer", "confidence", "sources", "document_ids", "written_at"
    )


def answer_questions(
    requests: DataFrame,
    tables: dict[str, DataFrame],
    *,
    cache: Entries = None,
    embedding_cache: Entries = None,
    threshold: float = MIN_SIMILARITY,
    ttl_seconds: int = DEFAULT_TTL_SECONDS,
    width: int = DEFAULT_WIDTH,
    embed_fn: Embedder | None = None,
    answer_fn: Answerer | None = None,
    index: InvertedFile | None = None,
    nprobe: int | None = None,
    widths: list[int] | None = None,
    store_intermediate: bool = True,
) -> AskResult:
    """Validate, look up, embed, retrieve, answer and collect the cache writes.

    requests(question_id, question, document_ids, top_k, asked_at). Every request gets
    an answer or an error. Equal requests of one batch are computed once. Without a
    cache every request is a miss, and the answers are the same. The same holds for the embedding
    cache (one entry per key). A question whose vector has a width that no stored vector has (`widths`, those of
    the registered models, where they are known) gets an error and leaves no entry in a cache. The pending
    questions and the hits are written to the shared folder once, because several branches read them.
    """

    def stored(df: DataFrame, name: str) -> DataFrame:
        return materialize(df, name) if store_intermediate else df

    # Written once: every branch sees the same requests at the same time, and what is live is decided once.
    checked = stored(validated(requests), "requests")
    rejected = checked.where("error IS NOT NULL").select("question_id", "error")
    asked = checked.where("error IS NULL").drop("error").withColumn(
        "key", query_key(F.col("question"), F.col("document_ids"), F.col("top_k"))
    )
    if callable(cache):
        cache = stored(cache(asked.select("key").distinct()), "cached")
    open_requests = asked if cache is None else misses(asked, cache)
    # The answer is computed under the key: equal requests share it.
    pending = open_requests.groupBy("key").agg(
        F.min_by(F.struct("question", "document_ids", "top_k"), "question_id").alias("r"),
        F.min("asked_at").alias("written_at"),
    ).select(F.col("key").alias("question_id"), "r.question", "r.document_ids", "r.top_k", "written_at")
    pending = pending.withColumn("scopes", parse_document_ids(F.col("document_ids")))
    pending = stored(pending.join(question_vectors(pending, width, embed_fn, embedding_cache), "question_id", "left"), "pending")

    searched = tables.get("embeddings") if index is None else index.vectors
    if foreign := foreign_widths(pending, searched, widths):
        known = F.coalesce(F.size("vector").isin(list(foreign)), F.lit(False))
        error = F.element_at(F.create_map(*(F.lit(v) for item in foreign.items() for v in item)), F.size("vector"))
        bad = pending.where(known).select(F.col("question_id").alias("key"), error.alias("error"))
        rejected = rejected.unionByName(open_requests.join(bad, "key").select("question_id", "error"))
        open_requests = open_requests.join(bad.select("key"), "key", "left_anti")
        pending = pending.where(~known)
    if pending.isEmpty():
        computed = requests.sparkSession.createDataFrame([], COMPUTED)
    else:
        computed = stored(
            _computed(pending, tables, answer_fn, stored, threshold=threshold, index=index, nprobe=nprobe), "computed"
        )
    entries = cache_entries(computed, ttl_seconds)

    columns = ["question_id", "question", "answer", "confidence", "sources"]
    fresh = open_requests.join(computed.select("key", "answer", "confidence", "sources"), "key")
    answers = fresh.select(*columns, F.lit(False).alias("cached"))
    if cache is not None:
        served = lookup(asked, cache.select("key", "answer", "confidence", "sources", "written_at", "expires_at"))
        answers = answers.unionByName(served.where("cached").select(*columns, F.lit(True).alias("cached")))
    return AskResult(answers, rejected, entries, embedding_entries(pending, ttl_seconds))
