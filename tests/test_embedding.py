import numpy as np
import pytest
from pyspark.sql import functions as F

from folioquery.operators.embedding import (
    embed_chunks,
    embed_once,
    embed_questions,
    embed_texts,
    embedding_width_violations,
    hash_embed,
    hash_embed_sparse,
)
from folioquery.operators.summarizing import extractive_summaries, model_summaries

TEXTS = ["the cat the dog", "The CAT\tthe\x01 dog", "", " \x02 ", "äöü ß Straße ÉTÉ", "a b c d e f g a a"]


@pytest.fixture
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")


def test_dense_and_sparse_forms_agree(texts):
    dense = {r["id"]: r["vector"] for r in hash_embed(texts, "text", 16).collect()}
    sparse = {}
    for r in hash_embed_sparse(texts, ["id"], "text", 16).collect():
        sparse.setdefault(r["id"], np.zeros(16))[r["bucket"]] = r["value"]
    assert dense[2] is None and dense[3] is None and 2 not in sparse and 3 not in sparse
    for i in (0, 1, 4, 5):
        assert np.allclose(dense[i], sparse[i] / np.linalg.norm(sparse[i]), atol=1e-6)
        assert np.linalg.norm(dense[i]) == pytest.approx(1, abs=1e-6)
    assert dense[0] == dense[1]  # cleaned and lower-cased alike


def test_many_rows_in_small_steps(spark, monkeypatch):
    from folioquery.operators import embedding

    frame = spark.range(500).select("id", F.concat_ws(" ", F.lit("w"), F.col("id").cast("string")).alias("text"))
    whole = {r["id"]: r["vector"] for r in hash_embed(frame, "text", 32).collect()}
    monkeypatch.setattr(embedding, "STEP_BYTES", 8 * 32 * 7)
    stepped = {r["id"]: r["vector"] for r in hash_embed(frame, "text", 32).collect()}
    assert whole == stepped and len(whole) == 500


def test_dense_embedding_does_not_shuffle(texts):
    plan = hash_embed(texts, "text", 16)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan


def test_user_model_keeps_rows_and_keys_together(texts):
    def lengths(batch):
        return [[len(t), 1.0] for t in batch]

    found = {r["id"]: r["vector"] for r in embed_texts(texts, lengths, "id", "text", batch_size=2).collect()}
    assert set(found) == {0, 1, 4, 5}  # blank texts are dropped
    assert found[0] == pytest.approx([15 / np.hypot(15, 1), 1 / np.hypot(15, 1)])


def test_user_model_zero_vectors_stay(texts):
    found = embed_texts(texts, lambda batch: [[0.0, 0.0] for _ in batch], "id", "text").collect()
    assert {tuple(r["vector"]) for r in found} == {(0.0, 0.0)}


def test_wrong_number_of_vectors_fails(texts):
    with pytest.raises(Exception, match="expected"):
        embed_texts(texts, lambda batch: [[1.0]] * (len(batch) + 1), "id", "text").collect()


def test_blank_questions_carry_an_error(spark):
    frame = spark.createDataFrame([(1, "what is it"), (2, "\x01 ")], "question_id int, question string")
    found = {r["question_id"]: r for r in embed_questions(frame, width=16).collect()}
    assert found[1]["error"] is None and len(found[1]["vector"]) == 16
    assert found[2]["error"] == "text is empty after preprocessing" and found[2]["vector"] is None
    assert found[1]["question"] == "what is it"


def test_every_distinct_text_is_embedded_once(spark):
    frame = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, "copy").otherwise(F.col("id").cast("string")).alias("text"))
    seen = spark.sparkContext.accumulator(0)

    def counted(batch):
        seen.add(len(batch))
        return [[float(len(t))] for t in batch]

    vectors = embed_once(frame, "id", "text", lambda t: embed_texts(t, counted, "text_key", "text")).collect()
    assert len(vectors) == 300 and all(v["vector"] == [1.0] for v in vectors)
    assert seen.value == 201


def test_chunk_embeddings_with_a_user_model(spark):
    chunks = spark.createDataFrame([("c", "d", "Document: f\n\nx")], "chunk_id string, document_id string, enriched string")
    row = embed_chunks(chunks, embed_fn=lambda b: [[float(len(b[0]))]], model="own").first()
    assert (row["chunk_id"], row["document_id"], row["vector"], row["model"]) == ("c", "d", [1.0], "own")


def test_width_check(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None)], "id int, vector array<float>")
    assert {r["id"] for r in embedding_width_violations(frame, 2).collect()} == {2, 3}


def test_extractive_summary(spark):
    text = "Cats sleep. Dogs and cats and birds! Cats and cats? Fish.\nCats and dogs."
    docs = spark.createDataFrame([(1, text), (2, ""), (3, "One")], "document_id int, content string")
    found = {r["document_id"]: r for r in extractive_summaries(docs).collect()}
    # Word counts: cats 5, and 4, dogs 2, the others 1.
    assert found[1]["summary"] == "Cats and cats"
    assert found[1]["key_points"] == ["Cats and dogs", "Dogs and cats and birds", "Cats sleep"]
    assert 2 not in found and found[3]["key_points"] == []


def test_summaries_move_the_texts_once(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select(
        F.col("doc_id").alias("document_id"), F.col("text").alias("content")
    )
    plan = extractive_summaries(docs)._jdf.queryExecution().executedPlan().toString()
    # The text rows are placed once for each side of the last join; nothing else is exchanged.
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_COL")


def test_model_summaries(spark):
    docs = spark.createDataFrame([(1, "text")], "document_id int, content string")
    row = model_summaries(docs, lambda texts: [f"About {t}.\n- a point\n* another" for t in texts]).first()
    assert (row["summary"], row["key_points"]) == ("About text.", ["a point", "another"])
    with pytest.raises(Exception, match="no response"):
        model_summaries(docs, lambda texts: [""]).collect()


def test_a_task_remembers_a_bounded_number_of_words():
    import tracemalloc

    from folioquery.operators.embedding import _Features

    tracemalloc.start()
    try:
        features = _Features(256)
        for i in range(600_000):
            features[f"word{i}"]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 48 * 1024 * 1024
    assert features["word0"] == _Features(256)["word0"]


def test_long_form_takes_as_many_tasks_as_the_text_needs(spark, data, monkeypatch):
    from folioquery.catalog import chunks

    usual = chunks._hash_chunks(spark, data)
    monkeypatch.setattr(chunks, "PLACED_BYTES", 20_000, raising=False)
    spread_out = chunks._hash_chunks(spark, data)
    assert spread_out.rdd.getNumPartitions() > 8
    assert usual.exceptAll(spread_out).count() == 0 == spread_out.exceptAll(usual).count()
