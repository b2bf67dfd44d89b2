import pytest
from pyspark.sql import functions as F

from folioquery.operators import maintenance, tasks
from folioquery.sources.store import load_tables, save_json, save_tables


@pytest.fixture
def documents(spark):
    return spark.createDataFrame([("a", "a.txt", "processing"), ("b", "b.txt", "processing")], "document_id string, filename string, status string")


def test_status_updates(spark, documents):
    rows = [("a", "ready", 1), ("a", "failed", 3), ("a", "ready", 2), ("x", "ready", 1), ("b", "odd", 9)]
    updates = spark.createDataFrame(rows, "document_id string, status string, seq int")
    found = maintenance.update_status(documents, updates, ["seq"])
    assert {r["document_id"]: r["status"] for r in found.collect()} == {"a": "failed", "b": "processing"}
    unknown = maintenance.unknown_documents(documents, updates).collect()
    assert [(r["document_id"], r["error"]) for r in unknown] == [("x", "document not found")]


def test_upsert(spark):
    base = spark.createDataFrame([(1, "base"), (2, "base")], "k int, v string")
    updates = spark.createDataFrame([(2, "first", 1), (2, None, 2), (3, "new", 1)], "k int, v string, seq int")
    assert sorted(map(tuple, maintenance.upsert(base, updates, ["k"], "seq").collect())) == [(1, "base"), (2, None), (3, "new")]
    nothing = updates.where(F.lit(False))
    assert maintenance.upsert(base, nothing, ["k"], "seq").count() == 2


def test_latest_combines_before_the_exchange(spark):
    plan = maintenance.latest_per_key(spark.range(10).selectExpr("id % 2 AS k", "id AS seq", "'x' AS v"), ["k"], ["seq"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in text


@pytest.fixture
def relations(spark):
    chunks = spark.createDataFrame([("c1", "a"), ("c2", "a"), ("c3", "b"), ("c4", "gone")], "chunk_id string, document_id string")
    summaries = spark.createDataFrame([("a", "s"), ("gone", "s")], "document_id string, summary string")
    embeddings = spark.createDataFrame([("c1",), ("c3",), ("c9",)], "chunk_id string")
    return chunks, summaries, embeddings


@pytest.mark.parametrize("with_document", [False, True])
def test_cascade(spark, documents, relations, with_document):
    chunks, summaries, embeddings = relations
    if with_document:
        embeddings = embeddings.join(chunks, "chunk_id")
    left = maintenance.cascade_delete(documents.where("document_id = 'a'"), documents, chunks, summaries, embeddings)
    assert {r["document_id"] for r in left["documents"].collect()} == {"b"}
    assert {r["chunk_id"] for r in left["chunks"].collect()} == {"c3", "c4"}
    assert {r["document_id"] for r in left["summaries"].collect()} == {"gone"}
    assert {r["chunk_id"] for r in left["embeddings"].collect()} == ({"c3"} if with_document else {"c3", "c9"})


def test_orphans(documents, relations):
    found = {r["relation"]: r["orphans"] for r in maintenance.orphan_counts(documents, *relations).collect()}
    assert found == {"chunks": 1, "summaries": 1, "embeddings": 1}


def test_lookups(spark, documents):
    ids = ["0b8f4a1e-3c5d-4e6f-8a9b-0c1d2e3f4a5b", "1b8f4a1e-3c5d-4e6f-8a9b-0c1d2e3f4a5b", "bad"]
    summaries = spark.createDataFrame([(ids[0], "s", ["p"])], "document_id string, summary string, key_points array<string>")
    requests = spark.createDataFrame([(i,) for i in ids], "document_id string")
    found = {r["document_id"]: r["outcome"] for r in maintenance.summary_lookup(requests, summaries, uuid_ids=True).collect()}
    assert found == {ids[0]: "found", ids[1]: "summary not ready", "bad": "invalid document id"}
    wanted = spark.createDataFrame([("a",), ("z",)], "document_id string")
    outcomes = {r["document_id"]: r["outcome"] for r in maintenance.document_lookup(wanted, documents).collect()}
    assert outcomes == {"a": "found", "z": "document not found"}


def test_failed_tasks_mark_their_documents(spark, documents):
    dead = spark.createDataFrame([("a",), ("a",)], "document_id string")
    assert sorted(map(tuple, maintenance.mark_failed(documents, dead).collect())) == [
        ("a", "a.txt", "failed"), ("b", "b.txt", "processing"),
    ]


def test_retry_state(spark):
    rows = [(i, a, m) for i, (a, m) in enumerate([(0, 0), (1, None), (2, 5), (3, 5), (4, 5), (5, 5), (0, 1), (2, 3), (None, 3)])]
    failed = spark.createDataFrame(rows, "id int, attempts int, max_attempts int").withColumn(
        "failed_at", F.lit("2024-01-01 00:00:00").cast("timestamp")
    )
    found = {r["id"]: r for r in tasks.retry_state(failed).collect()}
    assert [found[i]["attempts"] for i in range(9)] == [1, 2, 3, 4, 5, 6, 1, 3, 1]
    assert [found[i]["delay_ms"] for i in range(9)] == [2000, 4000, 8000, 16000, None, None, None, None, 2000]
    assert [found[i]["dead"] for i in range(9)] == [False] * 4 + [True] * 4 + [False]
    assert str(found[3]["not_before"]) == "2024-01-01 00:00:16"


def test_payloads(spark):
    texts = ['{"document_id":"a","chunk_ids":["x"]}', '{"document_id":"a"', "", None, "[]", "{}", '{"document_id":"a","chunk_ids":7}']
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, payload string")
    rows = tasks.decode_payloads(frame, "payload", "document_id string, chunk_ids array<string>").orderBy("id").collect()
    assert [r["malformed"] for r in rows] == [False, True, True, True, True, False, True]
    assert rows[0]["decoded"]["chunk_ids"] == ["x"] and rows[1]["decoded"] is None


def test_routes_and_due_tasks(spark):
    rows = [(1, "parse", None), (2, "analyze", "2024-01-01"), (3, None, "2024-01-02"), (4, "other", "2024-01-03"), (5, "", None)]
    frame = spark.createDataFrame(rows, "id int, task_type string, nb string").withColumn("not_before", F.col("nb").cast("timestamp"))
    routed = tasks.route_tasks(frame, ["parse", "analyze"])
    assert {k: {r["id"] for r in v.collect()} for k, v in routed.items()} == {"parse": {1}, "analyze": {2}, "quarantine": {3, 4, 5}}
    routes = [r[0] for r in frame.orderBy("id").select(tasks.task_route(["parse", "analyze"])).collect()]
    assert routes == ["tasks.parse", "tasks.analyze", "task type required", "unknown task type", "task type required"]
    due = tasks.due_tasks(frame, F.lit("2024-01-02").cast("timestamp"))
    assert {r["id"] for r in due.collect()} == {1, 2, 3, 5}


def test_tables_are_stored_per_batch(spark, tmp_path, documents, relations):
    chunks, summaries, embeddings = relations
    tables = {"documents": documents, "chunks": chunks, "summaries": summaries, "embeddings": embeddings.withColumn("model", F.lit("m"))}
    path = str(tmp_path / "store")
    save_tables(tables, path, "0")
    save_tables(tables, path, "0")  # a repeated batch replaces itself
    loaded = load_tables(spark, path)
    assert {n: t.count() for n, t in loaded.items()} == {"documents": 2, "chunks": 4, "summaries": 2, "embeddings": 3}
    assert set(loaded["embeddings"].columns) == {"chunk_id", "model"}
    save_tables(tables, path, "1")
    assert load_tables(spark, path)["chunks"].count() == 8


def test_json_sink(spark, tmp_path, documents):
    save_json(documents, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
