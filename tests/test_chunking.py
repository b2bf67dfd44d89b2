import random

import pytest
from pyspark.sql import functions as F

from folioquery.operators.chunking import (
    analyze_payloads,
    chunk_documents,
    concat_chunks,
    enrich_chunks,
    list_chunks,
    window_options,
)


def chunks_of(spark, text, max_words, overlap):
    docs = spark.createDataFrame([("d", text)], "document_id string, content string")
    return sorted((r["ord"], r["text"], r["token_count"]) for r in chunk_documents(docs, max_words, overlap).collect())


def model(text, max_words, overlap):
    """Plain statement of the windows: cover the words, stop at the window that reaches the end."""
    words, (size, step) = text.split(), window_options(max_words, overlap)
    starts = [i for i in range(0, len(words), step) if i == 0 or i - step + size < len(words)]
    return [(n, " ".join(words[i : i + size]), len(words[i : i + size])) for n, i in enumerate(starts)]


def test_windows_with_overlap(spark):
    found = chunks_of(spark, "one two three four five six seven eight nine ten", 4, 1)
    assert len(found) == 3
    assert found[0][2] == 4
    assert found[0][1] != found[1][1]


def test_empty_and_blank_texts_have_no_chunks(spark):
    assert chunks_of(spark, "", 4, 1) == []
    assert chunks_of(spark, " \n\t　 ", 4, 1) == []


def test_no_overlap(spark):
    assert [c[2] for c in chunks_of(spark, "a b c d e f", 3, 0)] == [3, 3]


def test_unset_options_give_400_words_without_overlap(spark):
    found = chunks_of(spark, " ".join(["word"] * 501), 0, 0)
    assert [c[2] for c in found] == [400, 101]


def test_thousand_words(spark):
    assert len(chunks_of(spark, " ".join(str(i) for i in range(1000)), 400, 80)) == 3


def test_no_window_of_overlap_only(spark):
    # The first window ends exactly at the last word.
    assert len(chunks_of(spark, " ".join(["w"] * 400), 400, 80)) == 1


@pytest.mark.parametrize("options,want", [((400, 80), (400, 320)), ((0, 80), (400, 320)), ((5, -3), (5, 5)), ((5, 5), (5, 5)), ((5, 9), (5, 5))])
def test_window_options(options, want):
    assert window_options(*options) == want


def test_unicode_white_space_separates_words(spark):
    assert chunks_of(spark, "a b c　d\u0085e\vf", 10, 0) == [(0, "a b c d e f", 6)]
    # The zero-width space is no white space.
    assert chunks_of(spark, "a​b", 10, 0) == [(0, "a​b", 1)]


def test_random_texts_equal_the_model(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab \n\t ") for _ in range(rng.randint(0, 300))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "document_id long, content string")
    for size, overlap in [(4, 1), (3, 0), (7, 6), (5, 5), (1, 0)]:
        rows = chunk_documents(docs, size, overlap).collect()
        for number, text in enumerate(texts):
            found = sorted((r["ord"], r["text"], r["token_count"]) for r in rows if r["document_id"] == number)
            assert found == model(text, size, overlap)


def test_chunk_ids_are_deterministic_and_distinct(spark):
    docs = spark.createDataFrame([("a", "x y z"), ("b", "x y z")], "document_id string, content string")
    first = {r["chunk_id"] for r in chunk_documents(docs, 1, 0).collect()}
    second = {r["chunk_id"] for r in chunk_documents(docs, 1, 0).collect()}
    assert first == second and len(first) == 6


@pytest.fixture
def two_chunks(spark):
    return spark.createDataFrame(
        [("c1", "d", 1, "Second chunk", 2), ("c0", "d", 0, "First chunk", 2)],
        "chunk_id string, document_id string, ord int, text string, token_count int",
    )


def test_concatenation_keeps_order_and_ends_lines(two_chunks):
    assert concat_chunks(two_chunks).first()["content"] == "First chunk\nSecond chunk\n"


def test_enrichment_prefix(spark):
    chunks = spark.createDataFrame([("c", "d", "Test chunk")], "chunk_id string, document_id string, text string")
    docs = spark.createDataFrame([("d", "test.pdf")], "document_id string, filename string")
    assert enrich_chunks(chunks, docs).first()["enriched"] == "Document: test.pdf\n\nTest chunk"


def test_payload_lists_chunk_ids_in_order(two_chunks):
    assert analyze_payloads(two_chunks).first()["payload"] == '{"chunk_ids":["c0","c1"],"document_id":"d"}'


def test_documents_without_chunks_stay(spark, two_chunks):
    docs = spark.createDataFrame([("d",), ("empty",)], "document_id string")
    assert dict(map(tuple, concat_chunks(two_chunks, docs).collect()))["empty"] == ""
    payloads = {r["document_id"]: r["payload"] for r in analyze_payloads(two_chunks, docs).collect()}
    assert payloads["empty"] == '{"chunk_ids":null,"document_id":"empty"}'


def test_listing_is_restricted_and_ordered(spark, two_chunks):
    other = two_chunks.withColumn("document_id", F.lit("other"))
    listed = list_chunks(two_chunks.unionByName(other), spark.createDataFrame([("d",)], "document_id string")).collect()
    assert [(r["document_id"], r["ord"]) for r in listed] == [("d", 0), ("d", 1)]


def test_chunking_does_not_shuffle(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select(
        F.col("doc_id").alias("document_id"), F.col("text").alias("content")
    )
    plan = chunk_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
