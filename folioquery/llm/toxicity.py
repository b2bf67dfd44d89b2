"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or.

A document is a bag of sentences. Each sentence gets a probability from its distinct words, each
taken as itself and by its first letters, so that inflected forms count together; a
document is toxic unless every sentence is clean: p(doc) = 1 - prod(1 - p(sentence)). Only
documents carry labels; the gradient through the noisy-or tells which sentences earned them,
so that the trained model also locates the offending sentences.

Null and empty texts have no sentence and score 0. Equal texts have equal scores; repeated rows
are scored one by one, very long texts sentence by sentence like others. A document labelled both ways counts as toxic.
Without labels of both kinds the weights stay zero and nothing is toxic.
An empty table gives no rows. Other columns of the documents are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioquery.llm.common import share, slices, whole_text

THRESHOLD = 0.7
SENTENCE_THRESHOLD = 0.5
BUCKETS = 1 << 20
SAMPLE_PER_CLASS = 1500  # labelled documents of each kind that the model is fitted on
ROUNDS = 200
STEP = 0.25
SHRINK = 0.0004  # pull towards no weight, as a gradient; words below it in all rounds keep none
PRIOR = -6.0  # log odds of a sentence of which nothing is known
PREFIXES = (4, 5)
MIN_DOCS = 3  # words in fewer sampled documents get no weight

TOKEN = re.compile(r"[.!?\n]+|\w+")
SENTENCE = re.compile(r"[^.!?\n]+")
CACHED_WORDS = 120_000


class Words(dict):
    """Number of a word, the end of a sentence as -1; filled as words come."""

    def __init__(self) -> None:
        super().__init__()
        self.features: list[tuple[int, ...]] = []  # of each word, hashed; 0 for none

    def __missing__(self, word: str) -> int:
        value = -1
        if word[0] not in ".!?\n":
            value = len(self.features)
            parts = [word] + [f"{word[:n]}-" if len(word) >= n else "" for n in PREFIXES]
            self.features.append(tuple(crc32(p.encode()) % (BUCKETS - 1) + 1 if p else 0 for p in parts))
        self[word] = value
        return value

    def ready(self) -> Words:
        """Between batches: start anew rather than grow without bound."""
        return Words() if len(self) > CACHED_WORDS else self

    def table(self) -> np.ndarray:
        return np.array(self.features, np.int64).reshape(-1, 1 + len(PREFIXES))


@dataclass
class Bags:
    """Distinct words of sentences of documents, flat: word -> sentence -> document."""

    word: np.ndarray
    sentence: np.ndarray
    document: np.ndarray  # of each sentence


def bags(texts: list[str], words: Words) -> Bags:
    codes, sizes = [], []
    for text in texts:
        found = [words[w] for w in TOKEN.findall(text.lower())]
        found.append(-1)
        codes.append(np.array(found, np.int64))
        sizes.append(len(found))
    flat = np.concatenate(codes) if codes else np.zeros(0, np.int64)
    document = np.repeat(np.arange(len(texts)), sizes)
    sentence = np.cumsum(np.r_[0, flat[:-1] < 0]) if len(flat) else flat
    spoken = flat >= 0
    key = np.unique(sentence[spoken] << 32 | flat[spoken])
    used, index = np.unique(key >> 32, return_inverse=True)
    last = np.zeros(sentence[-1] + 1 if len(flat) else 0, np.int64)
    last[sentence] = document
    return Bags(key & 0xFFFFFFFF, index, last[used])


def sentence_logits(bag: Bags, logits: np.ndarray, bias: float) -> np.ndarray:
    """logits: of each word"""
    return bias + np.bincount(bag.sentence, logits[bag.word], len(bag.document))


def noisy_or(bag: Bags, logits: np.ndarray, n: int) -> np.ndarray:
    """log of the probability that all sentences of a document are clean."""
    return -np.bincount(bag.document, np.logaddexp(0, logits), n)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, texts: list[str], words: Words) -> np.ndarray:
        bag = bags(texts, words)
        used, index = np.unique(bag.word, return_inverse=True)
        own = np.array([words.features[i] for i in used], np.int64).reshape(-1, 1 + len(PREFIXES))
        bag = Bags(index, bag.sentence, bag.document)
        logits = self.weights[own].sum(1, dtype=float)
        return -np.expm1(noisy_or(bag, sentence_logits(bag, logits, self.bias), len(texts)))

    def offending(self, text: str, words: Words) -> list[dict]:
        """Sentences above the sentence threshold with their place in the text."""
        places = [(m.start(), m.end()) for m in SENTENCE.finditer(text)]
        scores = self.score([text[a:b] for a, b in places], words)
        return [
            {"start": places[i][0], "end": places[i][1], "score": float(scores[i])}
            for i in np.flatnonzero(scores >= SENTENCE_THRESHOLD)
        ]


def fit(texts: list[str], labels: list[int]) -> Model:
    """Full-batch proximal gradient descent on the log loss of the noisy-or."""
    y = np.array(labels, float)
    weights, bias = np.zeros(BUCKETS), PRIOR
    if not 0 < y.sum() < len(y):
        return Model(weights, bias)
    words = Words()
    bag = bags(texts, words)
    pairs = np.unique(bag.word * len(texts) + bag.document[bag.sentence])
    table = words.table()
    held = np.zeros(BUCKETS, np.int64)  # documents of each feature, at least
    for column in table.T:
        held += np.bincount(column[pairs // len(texts)], minlength=BUCKETS)
    held[0] = 0
    table = np.where(held[table] >= MIN_DOCS, table, 0)
    features, table = np.unique(table, return_inverse=True)
    table = table.reshape(-1, 1 + len(PREFIXES))
    none = features == 0
    w, m = np.zeros(len(features)), np.zeros(len(features))
    size, bias_m, bias_v = 0.0, 0.0, 0.0
    for t in range(1, ROUNDS + 1):
        z = sentence_logits(bag, w[table].sum(1), bias)
        clean = np.minimum(noisy_or(bag, z, len(y)), -1e-12)
        pull = np.where(y > 0, np.exp(clean) / np.expm1(clean), 1.0)  # d loss / d (-log clean)
        dz = pull[bag.document] / (1 + np.exp(-z)) / len(y)
        # One step size for all words: a word moves by its share in the loss, so that words of
        # a few toxic documents don't keep up with words of many.
        by_word = np.bincount(bag.word, dz[bag.sentence], len(table))
        g = sum(np.bincount(column, by_word, len(features)) for column in table.T)
        m = 0.9 * m + 0.1 * np.where(none, 0, g)
        size = max(0.98 * size, float(np.abs(m).max(initial=0)), 1e-9)
        w -= STEP * m / size
        w = np.sign(w) * np.maximum(np.abs(w) - STEP * SHRINK / size, 0)
        bias_m, bias_v = 0.9 * bias_m + 0.1 * dz.sum(), 0.99 * bias_v + 0.01 * dz.sum() ** 2
        bias -= 0.05 * (bias_m / (1 - 0.9**t)) / (np.sqrt(bias_v / (1 - 0.99**t)) + 1e-9)
    weights[features] = w
    return Model(weights.astype(np.float32), float(bias))


def held_out() -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text, remainder 1 of 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[list[str], list[int]]:
    """At most `per_class` labelled documents of each kind, chosen by a hash of the id."""
    known = labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    known = known.where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = None
    for label in (0, 1):
        part = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    # The picked ids are 2 * per_class rows at most, so they can be sent to the scan.
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"] or ""))
    return [r["text"] or "" for r in rows], [r["toxic"] for r in rows]


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    return fit(*training_rows(docs, labels, per_class))


def toxic_score(docs: DataFrame, model: Model) -> Column:
    """The score of the text of a row as a column (0 to 1)."""
    sent = share(docs.sparkSession, model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words, model_ = Words(), sent()
        for texts in batches:
            words = words.ready()
            whole = texts.tolist()
            parts = [model_.score(whole[a:b], words) for a, b in slices(whole)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return score(whole_text())


def offending_sentences(docs: DataFrame, model: Model) -> Column:
    """Sentences that make a document toxic: array of (start, end, score), by place."""
    sent = share(docs.sparkSession, model)

    @F.pandas_udf("array<struct<start:int,end:int,score:double>>")
    def locate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words, model_ = Words(), sent()
        for texts in batches:
            words = words.ready()
            whole = texts.tolist()
            scores = np.concatenate([model_.score(whole[a:b], words) for a, b in slices(whole)] or [np.zeros(0)])
            yield pd.Series(
                [model_.offending(t, words) if s >= SENTENCE_THRESHOLD else [] for t, s in zip(whole, scores, strict=True)],
                dtype=object,
            )

    return locate(whole_text())


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs(doc_id, text, ...), labels(doc_id, toxic, ...) -> doc_id, held_out, score, predicted, offending."""
    model = train(docs, labels)
    sent = share(docs.sparkSession, model)

    @F.pandas_udf("score double, offending array<struct<start:int,end:int,score:double>>")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words, model_ = Words(), sent()
        for texts in batches:
            words = words.ready()
            whole = texts.tolist()
            scores = np.concatenate([model_.score(whole[a:b], words) for a, b in slices(whole)] or [np.zeros(0)])
            places = [
                model_.offending(t, words) if s >= SENTENCE_THRESHOLD else []
                for t, s in zip(whole, scores, strict=True)
            ]
            yield pd.DataFrame({"score": scores, "offending": pd.Series(places, dtype=object)})

    judged = docs.select("doc_id", held_out().alias("held_out"), judge(whole_text()).alias("judged"))
    return judged.select(
        "doc_id",
        "held_out",
        "judged.score",
        (F.col("judged.score") >= threshold).cast("int").alias("predicted"),
        "judged.offending",
    )


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    return docs.where(toxic_score(docs, train(docs, labels)) < threshold)
