"""Document summaries: a built-in extractive model and user models."""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from folioquery.functions.isolation import call_isolated
from folioquery.functions.text import (
    SENTENCE_END,
    WHITE_SPACE,
    response_key_points,
    response_summary,
    sentences,
    trim_blanks,
    words,
)
from folioquery.operators.embedding import MODEL_BATCH

KEY_POINTS = 3
SPLIT_SENTENCES = re.compile(SENTENCE_END)
ASCII_BLANKS = " \t\n\v\f\r"
# `str.split` also splits at four separators that are no white space here.
NO_BLANK = re.compile("[\x1c-\x1f]")
WORD = re.compile(f"(?:(?!{WHITE_SPACE}).)+", re.DOTALL)

# texts -> model responses (a paragraph and bullet lines)
Summarizer = Callable[[list[str]], list[str]]


def _best_sentences(text: str | None) -> list[str]:
    """The best sentences of one text: highest mean count of their words first."""
    spoken = []
    counts: Counter[str] = Counter()
    for pos, part in enumerate(SPLIT_SENTENCES.split(text or "")):
        sentence = part.strip(ASCII_BLANKS)
        if sentence:
            lowered = sentence.lower()
            tokens = lowered.split() if not NO_BLANK.search(lowered) else WORD.findall(lowered)
            counts.update(tokens)
            spoken.append((pos, sentence, tokens))
    scored = [
        (-round(sum(counts[word] for word in tokens) / len(tokens), 9), pos, sentence)
        for pos, sentence, tokens in spoken
        if tokens
    ]
    return [sentence for _, _, sentence in heapq.nsmallest(1 + KEY_POINTS, scored)]


def extractive_summaries(documents: DataFrame) -> DataFrame:
    """documents(document_id, content) -> (document_id, summary, key_points).

    A sentence scores the mean document frequency of its words (Luhn 1958); the best
    sentence is the summary, the next three are the key points. Everything it needs
    lies in the document's own row, so texts are scored in Arrow batches where they
    are read: no exchange. `extractive_summaries_relational` says the same in joins
    and windows.
    """
    schema = T.StructType(
        [documents.schema["document_id"], T.StructField("top", T.ArrayType(T.StringType()))]
    )

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            top = [_best_sentences(text) for text in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("document_id"), pa.array(top, pa.list_(pa.string()))], names=schema.names
            )

    found = documents.select("document_id", "content").mapInArrow(summarize, schema).where(F.size("top") > 0)
    return found.select(
        "document_id", F.element_at("top", 1).alias("summary"), F.slice("top", 2, KEY_POINTS).alias("key_points")
    )


def extractive_summaries_relational(documents: DataFrame, partition: bool = True) -> DataFrame:
    """The same summaries as a relational plan.

    The text rows are placed by document_id once, before they are exploded; every
    later step groups by document_id and more, so none of the exploded words crosses
    the network. A table bucketed by document_id needs no placing (`partition=False`).
    """
    placed = documents.select("document_id", "content")
    if partition:
        placed = placed.repartition("document_id")
    # Only positions travel with the words; the few chosen sentences are cut out again.
    spoken = placed.select("document_id", F.explode(sentences(F.col("content"))).alias("s")).select(
        "document_id", "s.pos", F.explode(words(F.lower(F.col("s.sentence")))).alias("word")
    )
    frequency = F.count("*").over(Window.partitionBy("document_id", "word"))
    scored = (
        spoken.withColumn("frequency", frequency)
        .groupBy("document_id", "pos")
        .agg(F.round(F.avg("frequency"), 9).alias("score"))
    )
    best_first = Window.partitionBy("document_id").orderBy(F.desc("score"), "pos")
    ranked = scored.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= 1 + KEY_POINTS)
    chosen = F.transform(F.array_sort(F.collect_list(F.struct("rank", "pos"))), lambda c: c["pos"])
    best = ranked.groupBy("document_id").agg(chosen.alias("chosen"))
    top = F.transform(
        F.array(F.split("content", SENTENCE_END)),
        lambda parts: F.transform("chosen", lambda pos: trim_blanks(F.element_at(parts, pos + 1))),
    )
    return best.join(placed, "document_id").select("document_id", F.element_at(top, 1).alias("top")).select(
        "document_id", F.element_at("top", 1).alias("summary"), F.slice("top", 2, KEY_POINTS).alias("key_points")
    )


def model_responses(texts: DataFrame, summarize_fn: Summarizer, isolate: bool = False) -> DataFrame:
    """Run a user model over (document_id, content), MODEL_BATCH texts a call: document_id, response[, error].

    A missing response fails the task; with `isolate` it is the error of its row, as is an exception of the model.
    """
    fields = [texts.schema["document_id"], T.StructField("response", T.StringType())]
    schema = T.StructType(fields + [T.StructField("error", T.StringType())] * isolate)
    nothing = "the summary model returned no response for some document"

    def summarize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = (b.iloc[at : at + MODEL_BATCH] for b in batches for at in range(0, len(b), MODEL_BATCH))
        for batch in parts:
            if isolate:
                tried = call_isolated(summarize_fn, batch["content"].tolist(), lambda r: None if r else nothing)
                columns = {"response": [r for r, _ in tried], "error": [e for _, e in tried]}
                yield pd.DataFrame({"document_id": batch["document_id"].tolist(), **columns})
                continue
            responses = summarize_fn(batch["content"].tolist())
            if len(responses) != len(batch) or any(not r for r in responses):
                raise ValueError(nothing)
            yield pd.DataFrame({"document_id": batch["document_id"], "response": responses})

    return texts.select("document_id", "content").mapInPandas(summarize, schema)


def model_summaries(texts: DataFrame, summarize_fn: Summarizer) -> DataFrame:
    """Summaries and key points by a user model; a missing response fails the task."""
    return parse_responses(model_responses(texts, summarize_fn))


def parse_responses(responses: DataFrame) -> DataFrame:
    response = F.col("response")
    return responses.select(
        "document_id",
        response_summary(response).alias("summary"),
        response_key_points(response).alias("key_points"),
    )
