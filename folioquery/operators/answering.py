"""From hits to answers: context, quality, confidence, sources and prompts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioquery.functions.text import preview, sentences, terms_text, words
from folioquery.operators.embedding import MODEL_BATCH
from folioquery.schemas import SOURCES

# --- fixed values -----------------------------------------------------------
NOT_ENOUGH_INFORMATION = "I don't have enough information to answer this question"
ANSWER_USER_FORMAT = "Context:\n%s\n\nQuestion: %s"
# -----------------------------------------------------------------------------

# (questions, contexts) -> (answer, log-probabilities of its tokens or None) per row
Answerer = Callable[[list[str], list[str]], list[tuple[str, list[float] | None]]]


def per_question(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Context, quality and sources of every question, hits or not.

    hits(question_id, rank, chunk_id, similarity, text): at most top_k rows per
    question, so the ordered group is small by definition of the operator. One
    exchange on question_id serves all three aggregates.
    """
    ordered = F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "similarity", "text")))
    grouped = hits.groupBy("question_id").agg(ordered.alias("hits"), F.avg("similarity").alias("quality"))
    context = F.array_join(F.transform("hits", lambda h: F.concat(h["text"], F.lit("\n"))), "")
    sources = F.transform(
        "hits",
        lambda h: F.struct(
            h["chunk_id"].cast("string").alias("chunk_id"),
            h["similarity"].alias("score"),
            preview(h["text"]).alias("preview"),
        ),
    )
    return questions.join(grouped, "question_id", "left").select(
        *questions.columns,
        F.coalesce(context, F.lit("")).alias("context"),
        F.coalesce("quality", F.lit(0.0)).alias("quality"),
        F.coalesce(sources, F.array().cast(SOURCES)).alias("sources"),
    )


def build_context(questions: DataFrame, hits: DataFrame) -> DataFrame:
    return per_question(questions, hits).select("question_id", "context")


def context_quality(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Average similarity, 0.0 without hits. The average combines map-side."""
    grouped = hits.groupBy("question_id").agg(F.avg("similarity").alias("quality"))
    return questions.select("question_id").join(grouped, "question_id", "left").withColumn(
        "quality", F.coalesce("quality", F.lit(0.0))
    )


def build_sources(questions: DataFrame, hits: DataFrame) -> DataFrame:
    return per_question(questions, hits).select("question_id", "sources")


def token_confidence(answers: DataFrame, log_probabilities: DataFrame, key: str) -> DataFrame:
    """Average token probability per answer; 1.0 where no log-probabilities exist."""
    grouped = log_probabilities.groupBy(key).agg(F.avg(F.exp("logprob")).alias("confidence"))
    return answers.select(key).join(grouped, key, "left").withColumn(
        "confidence", F.coalesce("confidence", F.lit(1.0))
    )


def list_confidence(logprobs: Column) -> Column:
    """The same for log-probabilities that arrive as an array with the answer."""
    total = F.aggregate(logprobs, F.lit(0.0), lambda acc, x: acc + F.exp(x))
    return F.when(F.coalesce(F.size(logprobs), F.lit(0)) > 0, total / F.size(logprobs)).otherwise(F.lit(1.0))


def answer_confidence(quality: DataFrame, tokens: DataFrame, key: str) -> DataFrame:
    return quality.join(tokens, key).select(
        key, (F.col("quality") * F.col("confidence")).alias("confidence")
    )


def prompt(context: Column, question: Column, instruction: str) -> Column:
    """Messages for an answer model: array of (role, content); the instruction is the caller's."""
    user = F.format_string(ANSWER_USER_FORMAT, context, question)
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(instruction).alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")),
    )


def term_set(text: Column) -> Column:
    """The distinct terms of a text: a question mark is no part of the last word."""
    return F.array_distinct(words(terms_text(text)))


def extractive_answers(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Built-in answerer: the context sentence that shares most terms with the question.

    Ties go to the better hit, then to the earlier sentence. Only the best sentence
    of each hit leaves the first stage: the minimum combines map-side.
    """
    asked = questions.select("question_id", term_set(F.col("question")).alias("asked"))
    scored = (
        hits.join(asked, "question_id")
        .select("question_id", "rank", "asked", F.explode(sentences(F.col("text"))).alias("s"))
        .select(
            "question_id",
            F.struct(
                (-F.size(F.array_intersect("asked", term_set(F.col("s.sentence"))))).alias("order"),
                F.col("rank"),
                F.col("s.pos").alias("pos"),
                F.col("s.sentence").alias("sentence"),
            ).alias("candidate"),
        )
    )
    best = scored.groupBy("question_id").agg(F.min("candidate").alias("best"))
    return questions.select("question_id").join(best, "question_id", "left").select(
        "question_id", F.coalesce("best.sentence", F.lit(NOT_ENOUGH_INFORMATION)).alias("answer")
    )


def model_answers(contexts: DataFrame, answer_fn: Answerer) -> DataFrame:
    """Run a user model, MODEL_BATCH questions a call: append `answer` and `confidence`.

    contexts(question_id, question, context, quality, ...). Confidence is the
    context quality times the average token probability.
    """
    schema = T.StructType(
        [
            *contexts.schema.fields,
            T.StructField("answer", T.StringType()),
            T.StructField("logprobs", T.ArrayType(T.DoubleType())),
        ]
    )

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = (b.iloc[at : at + MODEL_BATCH] for b in batches for at in range(0, len(b), MODEL_BATCH))
        for batch in parts:
            replies = answer_fn(batch["question"].tolist(), batch["context"].tolist())
            if len(replies) != len(batch) or any(not text for text, _ in replies):
                raise ValueError("the answer model returned no answer for some question")
            yield batch.assign(answer=[a for a, _ in replies], logprobs=[p for _, p in replies])

    asked = contexts.mapInPandas(ask, schema)
    return asked.withColumn("confidence", F.col("quality") * list_confidence(F.col("logprobs"))).drop("logprobs")


def answer_json(answers: DataFrame) -> DataFrame:
    """One JSON document per question, as it is handed to a client or to a cache."""
    return answers.select("question_id", F.to_json(F.struct("answer", "confidence", "sources", "cached")).alias("json"))
