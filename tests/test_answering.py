import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folioquery.operators import answering
from folioquery.plans.analyze import analyze_documents
from folioquery.plans.ask import answer_questions
from folioquery.schemas import REQUESTS

NOW = datetime(2024, 1, 1)
DOC_A, DOC_B, DOC_C = (f"{n}b8f4a1e-3c5d-4e6f-8a9b-0c1d2e3f4a5b" for n in "abc")


@pytest.fixture(scope="module")
def tables(spark):
    rows = [
        (DOC_A, "birds.txt", NOW, "Owls hunt mice at night. Eagles hunt fish by day."),
        (DOC_B, "cars.txt", NOW, "Engines burn fuel. Wheels turn on the road."),
        (DOC_C, "empty.txt", NOW, "   "),
    ]
    docs = spark.createDataFrame(rows, "document_id string, filename string, created_at timestamp, content string")
    found = analyze_documents(docs, max_words=6, overlap=0)
    return {name: table.cache() for name, table in found.items()}


def ask(spark, tables, rows, **options):
    requests = spark.createDataFrame(rows, REQUESTS).withColumn("asked_at", F.lit(NOW + timedelta(hours=1)))
    return answer_questions(requests, tables, threshold=0.2, **options)


QUESTIONS = [
    ("q1", "When do owls hunt mice?", [DOC_A, DOC_B], 2),
    ("q2", "When do owls hunt mice?", [DOC_B, DOC_A], 2),  # same key as q1
    ("q3", "When do owls hunt mice?", [DOC_B], None),
    ("q4", "Hi", [DOC_A], None),
    ("q5", "Anything in here?", [DOC_C], None),
]


def test_empty_document_is_ready_without_chunks(tables):
    assert {r["status"] for r in tables["documents"].collect()} == {"ready"}
    assert tables["chunks"].where(F.col("document_id") == DOC_C).count() == 0
    assert tables["embeddings"].where(F.col("document_id") == DOC_C).count() == 0
    row = tables["summaries"].where(F.col("document_id") == DOC_C).first()
    assert (row["summary"], row["key_points"]) == ("", [])


def test_answers(spark, tables):
    result = ask(spark, tables, QUESTIONS)
    answers = {r["question_id"]: r for r in result.answers.collect()}
    assert set(answers) == {"q1", "q2", "q3", "q5"}
    assert answers["q1"]["answer"] == "Owls hunt mice at night"
    assert answers["q1"]["answer"] == answers["q2"]["answer"]
    sources = answers["q1"]["sources"]
    assert answers["q1"]["confidence"] == pytest.approx(sum(s["score"] for s in sources) / len(sources))
    assert [s["score"] for s in sources] == sorted((s["score"] for s in sources), reverse=True)
    assert sources[0]["preview"].startswith("Owls hunt mice at night.")
    assert answers["q5"]["answer"] == answering.NOT_ENOUGH_INFORMATION
    assert (answers["q5"]["confidence"], answers["q5"]["sources"]) == (0.0, [])
    rejected = {r["question_id"]: r["error"] for r in result.rejected.collect()}
    assert rejected == {"q4": "Question must be at least 3"}


def test_equal_requests_are_computed_once(spark, tables):
    entries = ask(spark, tables, QUESTIONS).cache_entries.collect()
    assert len(entries) == 3
    assert {r["expires_at"] - r["written_at"] for r in entries} == {timedelta(hours=24)}


def test_cache_does_not_change_answers(spark, tables):
    without = ask(spark, tables, QUESTIONS)
    warm = ask(spark, tables, QUESTIONS, cache=without.cache_entries)
    cold = ask(spark, tables, QUESTIONS, cache=without.cache_entries.where(F.lit(False)))
    columns = ["question_id", "answer", "confidence"]
    want = sorted(map(tuple, without.answers.select(columns).collect()))
    for result, cached in ((warm, True), (cold, False)):
        rows = result.answers.collect()
        assert sorted((r["question_id"], r["answer"], r["confidence"]) for r in rows) == want
        assert {r["cached"] for r in rows} == {cached}
    assert warm.cache_entries.count() == 0


def test_expired_entries_are_computed_again(spark, tables):
    stale = ask(spark, tables, QUESTIONS).cache_entries.withColumn("expires_at", F.lit(NOW + timedelta(hours=1)))
    assert {r["cached"] for r in ask(spark, tables, QUESTIONS, cache=stale).answers.collect()} == {False}


def test_user_models(spark, tables):
    def embed(texts):
        return [[1.0, 0.0] if "owl" in t.lower() else [0.0, 1.0] for t in texts]

    def answer(questions, contexts):
        return [(f"{q} / {len(c)}", [math.log(0.5), math.log(1.0)] if c else None) for q, c in zip(questions, contexts)]

    own = dict(tables)
    own["embeddings"] = tables["chunks"].select(
        "chunk_id", "document_id", F.when(F.lower("text").contains("owl"), F.array(F.lit(1.0), F.lit(0.0)))
        .otherwise(F.array(F.lit(0.0), F.lit(1.0))).cast("array<float>").alias("vector"), F.lit("own").alias("model"),
    )
    answers = {
        r["question_id"]: r
        for r in ask(spark, own, [QUESTIONS[0], QUESTIONS[4]], embed_fn=embed, answer_fn=answer).answers.collect()
    }
    assert answers["q1"]["confidence"] == pytest.approx(0.75)
    assert len(answers["q1"]["sources"]) == 1
    assert answers["q5"]["answer"] == "Anything in here? / 0"
    assert answers["q5"]["confidence"] == 0.0


def test_quality_and_confidence(spark):
    questions = spark.createDataFrame([(1, "a"), (2, "b")], "question_id int, question string")
    hits = spark.createDataFrame([(1, 1, "c", 0.95, "text")], "question_id int, rank int, chunk_id string, similarity double, text string")
    quality = answering.context_quality(questions, hits)
    assert dict(map(tuple, quality.collect())) == {1: 0.95, 2: 0.0}
    assert dict(map(tuple, answering.build_context(questions, hits).collect())) == {1: "text\n", 2: ""}
    assert {r["question_id"]: len(r["sources"]) for r in answering.build_sources(questions, hits).collect()} == {1: 1, 2: 0}
    logprobs = spark.createDataFrame([(1, math.log(0.5)), (1, 0.0)], "question_id int, logprob double")
    tokens = answering.token_confidence(questions, logprobs, "question_id")
    assert dict(map(tuple, tokens.collect())) == {1: pytest.approx(0.75), 2: 1.0}
    combined = dict(map(tuple, answering.answer_confidence(quality, tokens, "question_id").collect()))
    assert combined == {1: pytest.approx(0.7125), 2: 0.0}


def test_context_follows_rank(spark):
    questions = spark.createDataFrame([(1, "a")], "question_id int, question string")
    hits = spark.createDataFrame(
        [(1, r, f"c{r}", 1 - r / 100, f"t{r}") for r in (10, 2, 1, 3)],
        "question_id int, rank int, chunk_id string, similarity double, text string",
    )
    assert answering.build_context(questions, hits).first()["context"] == "t1\nt2\nt3\nt10\n"


def test_extractive_ties(spark):
    questions = spark.createDataFrame([(1, "red blue"), (2, "x")], "question_id int, question string")
    hits = spark.createDataFrame(
        [(1, 2, "c2", 0.5, "Red car."), (1, 1, "c1", 0.9, "None here. A blue car. A red car.")],
        "question_id int, rank int, chunk_id string, similarity double, text string",
    )
    found = dict(map(tuple, answering.extractive_answers(questions, hits).collect()))
    assert found == {1: "A blue car", 2: answering.NOT_ENOUGH_INFORMATION}


def test_prompt_and_json(spark):
    frame = spark.createDataFrame([("ctx", "why?")], "context string, question string")
    messages = frame.select(answering.prompt(F.col("context"), F.col("question"), "be brief")).first()[0]
    assert [m["role"] for m in messages] == ["system", "user"]
    assert messages[1]["content"] == "Context:\nctx\n\nQuestion: why?"
    answers = spark.createDataFrame(
        [("q", "a", 0.5, [("c", 0.5, "p")], False)],
        "question_id string, answer string, confidence double, "
        "sources array<struct<chunk_id:string,score:double,preview:string>>, cached boolean",
    )
    assert answering.answer_json(answers).first()["json"] == (
        '{"answer":"a","confidence":0.5,"sources":[{"chunk_id":"c","score":0.5,"preview":"p"}],"cached":false}'
    )


def test_asked_documents_reach_the_scans(spark, tables, tmp_path):
    from folioquery.operators.embedding import embed_questions
    from folioquery.operators.retrieval import retrieve
    from folioquery.sources.store import load_tables, save_tables

    save_tables(tables, str(tmp_path), "1")
    stored = load_tables(spark, str(tmp_path))
    questions = spark.createDataFrame([(1, "owls hunt", [DOC_A])], "question_id int, question string, scopes array<string>")
    hits = retrieve(
        embed_questions(questions).drop("question", "error"), stored["embeddings"], stored["chunks"],
        stored["summaries"], threshold=0.1,
    )
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert {r["document_id"] for r in hits.collect()} == {DOC_A}
    scans = [line for line in plan.split("\n") if "FileScan" in line]
    assert len(scans) == 3 and all(DOC_A in line.split("PushedFilters")[1] for line in scans)


def test_a_question_of_another_width_is_an_error(spark, tables):
    asked = ask(spark, tables, QUESTIONS)
    for widths in (None, [256]):
        other = ask(spark, tables, QUESTIONS, embed_fn=lambda texts: [[1.0, 0.0, 0.0]] * len(texts), widths=widths)
        assert other.answers.count() == 0 and other.cache_entries.count() == 0 and other.embedding_entries.count() == 0
        wrong = {r["question_id"]: r["error"] for r in other.rejected.collect() if "wide" in r["error"]}
        assert set(wrong) == {r["question_id"] for r in asked.answers.collect()}
        assert set(wrong.values()) == {"the question's vector is 3 wide, no stored vector is"}


def test_marks_do_not_hide_a_word(spark):
    questions = spark.createDataFrame([("q", "Who makes Honey?")], "question_id string, question string")
    text = "Engines burn fuel. Bees make (honey), in summer."
    hits = spark.createDataFrame([("q", 1, "c", 0.5, text)], "question_id string, rank int, chunk_id string, similarity double, text string")
    assert answering.extractive_answers(questions, hits).first()["answer"] == "Bees make (honey), in summer"
    from folioquery.operators.embedding import embed_questions

    rows = [(1, "honey?"), (2, "«Honey»"), (3, "honey"), (4, "?!")]
    vectors = embed_questions(spark.createDataFrame(rows, "question_id int, question string"), width=16).orderBy("question_id").collect()
    assert vectors[0]["vector"] == vectors[1]["vector"] == vectors[2]["vector"] and vectors[3]["vector"] is None


def test_user_models_get_batches_of_bounded_size(spark):
    from folioquery.operators.answering import model_answers
    from folioquery.operators.embedding import MODEL_BATCH
    from folioquery.operators.summarizing import model_summaries

    def summarize(texts):
        assert len(texts) <= MODEL_BATCH
        return ["a summary"] * len(texts)

    def answer(questions, contexts):
        assert len(questions) <= MODEL_BATCH
        return [("an answer", None)] * len(questions)

    rows = 2 * MODEL_BATCH + 1
    texts = spark.range(rows, numPartitions=1).selectExpr("id AS document_id", "'a text' AS content")
    assert model_summaries(texts, summarize).where("summary = 'a summary'").count() == rows
    asked = spark.range(rows, numPartitions=1).selectExpr("id AS question_id", "'q' AS question", "'c' AS context", "1.0D AS quality")
    assert model_answers(asked, answer).count() == rows


def test_known_questions_are_not_embedded_again(spark, tables):
    def refuse(texts):
        raise AssertionError("the model was called")

    first = ask(spark, tables, QUESTIONS)
    entries = first.embedding_entries
    assert entries.count() == 2  # two texts in four accepted requests
    again = ask(spark, tables, QUESTIONS, embedding_cache=entries, embed_fn=refuse)
    assert sorted(again.answers.collect()) == sorted(first.answers.collect())
    assert again.embedding_entries.count() == 0
    expired = entries.withColumn("expires_at", F.col("written_at"))
    with pytest.raises(Exception, match="the model was called"):
        ask(spark, tables, QUESTIONS, embedding_cache=expired, embed_fn=refuse)
    assert ask(spark, tables, QUESTIONS, embedding_cache=expired).embedding_entries.count() == 2
