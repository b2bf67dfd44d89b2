"""The task-driven analyse stage: states, retries, isolation, rounds that are run again."""

import json
from datetime import datetime, timedelta

import pytest

from folioquery.functions.isolation import call_isolated
from folioquery.sources.store import load_tables
from folioquery.streaming import worker
from folioquery.streaming.stages import read_file_stream
from folioquery.streaming.worker import analyze_tasks_stage, outcomes, run_due, run_round, waiting_tasks

START = datetime(2024, 5, 1)
DOCS = [("a", "a.txt", "Alpha one."), ("b", "b.txt", "Bad two."), ("c", "c.txt", ""), ("d", "d.txt", "Delta four. Good.")]


@pytest.fixture
def documents(spark):
    return spark.createDataFrame(DOCS, "document_id string, filename string, content string")


def task(doc, type_="analyze", payload=None, limit=None, task_id=None):
    payload = json.dumps({"document_id": doc, "chunk_ids": []}) if payload is None else payload
    return (payload, type_, limit, task_id)


def frame(spark, rows):
    return spark.createDataFrame(rows, "payload string, task_type string, max_attempts int, task_id string")


def embedder():
    """A local function travels to the workers by value."""

    def embed(texts):
        if any("Bad" in t for t in texts):
            raise ValueError("bad text")
        return [[1.0, float(len(t))] for t in texts]

    return embed


embed = embedder()


def states(spark, log):
    found = {(r["task_id"], r["state"], r["attempts"]) for r in outcomes(spark, log).collect()}
    return found | {(r["task_id"], "waiting", r["attempts"]) for r in waiting_tasks(spark, log).collect()}


def stored(spark, store):
    tables = load_tables(spark, store, newest=True)
    vectors = {r["document_id"] for r in tables["embeddings"].select("document_id").collect()}
    return {r["document_id"]: (r["status"], r["document_id"] in vectors) for r in tables["documents"].collect()}


def test_call_isolated_halves_until_the_bad_ones_stand_alone():
    calls = []

    def model(inputs):
        calls.append(len(inputs))
        if any(i < 0 for i in inputs):
            raise ValueError(f"{min(inputs)}")
        return [i * 2 for i in inputs]

    got = call_isolated(model, [1, 2, -3, 4, 5, 6, 7, 8], lambda r: "too large" if r == 16 else None)
    assert got == [(2, None), (4, None), (None, "ValueError: -3"), (8, None), (10, None), (12, None), (14, None), (None, "too large")]
    assert len(calls) == 7
    assert call_isolated(model, [], lambda r: None) == []
    assert call_isolated(lambda x: [1], [1, 2], lambda r: None) == [(1, None), (1, None)]


def test_states_and_retries(spark, tmp_path, documents):
    log, store = str(tmp_path / "log"), str(tmp_path / "store")
    arrived = frame(spark, [
        task("a", task_id="ok"), task("a", task_id="ok"), task("b", limit=2, task_id="bad"), task("c", task_id="empty"), task("z", limit=1, task_id="nobody"),
        task("a", type_="parse", task_id="other worker"), task("a", type_=None, task_id="typeless"), task("a", type_="x", task_id="odd type"),
        task("", payload="{broken", task_id="broken"), task("", payload="{}", task_id="nameless"),
    ])
    run_round(spark, log, store, "one", arrived, documents, START, embed_fn=embed)
    first = {("ok", "done", 0), ("bad", "waiting", 1), ("empty", "done", 0), ("nobody", "dead", 1), *((t, "quarantined", 0) for t in ("typeless", "odd type", "broken", "nameless"))}
    assert states(spark, log) == first
    errors = {r["task_id"]: r["error"] for r in outcomes(spark, log).collect()}
    assert errors["nobody"] == "document not found" and errors["broken"] == "payload names no document" == errors["nameless"]
    assert (errors["typeless"], errors["odd type"], errors["ok"]) == ("task type required", "unknown task type", None)
    assert stored(spark, store) == {"a": ("ready", True), "b": ("processing", False), "c": ("ready", False)}
    assert waiting_tasks(spark, log).first()["not_before"] == START + timedelta(seconds=2)
    # Before its time nothing happens; a new document is analysed meanwhile, and the waiting task may be handed over again.
    run_round(spark, log, store, "two", frame(spark, [task("d"), task("b", limit=2, task_id="bad")]), documents, START + timedelta(seconds=1), embed_fn=embed)
    assert waiting_tasks(spark, log).collect() == [("bad", "b", task("b")[0], 1, 2, START + timedelta(seconds=2))]
    run_due(spark, log, store, documents, START + timedelta(seconds=2), embed_fn=embed)
    assert ("bad", "dead", 2) in states(spark, log) and waiting_tasks(spark, log).count() == 0
    assert stored(spark, store) == {"a": ("ready", True), "b": ("failed", False), "c": ("ready", False), "d": ("ready", True)}
    # A later task of the healed document succeeds; one of a good document that fails then keeps its content.
    run_round(spark, log, store, "three", frame(spark, [task("b", task_id="again")]), documents, START, embed_fn=lambda t: [[1.0, 0.0]] * len(t))
    assert stored(spark, store)["b"] == ("ready", True)
    run_round(spark, log, store, "four", frame(spark, [task("b", limit=1, task_id="once more")]), documents, START, embed_fn=embed)
    assert stored(spark, store)["b"] == ("failed", True)


def test_a_round_that_is_run_again(spark, tmp_path, documents, monkeypatch):
    log, store = str(tmp_path / "log"), str(tmp_path / "store")
    arrived = frame(spark, [task("a", task_id="1"), task("b", task_id="2")])
    real = worker.commit

    def lost(*args):
        raise RuntimeError("lost")

    monkeypatch.setattr(worker, "commit", lost)  # the store is committed, the log is not
    with pytest.raises(RuntimeError, match="lost"):
        run_round(spark, log, store, "one", arrived, documents, START, embed_fn=embed)
    assert states(spark, log) == set()
    monkeypatch.setattr(worker, "commit", real)
    for _ in range(2):
        run_round(spark, log, store, "one", arrived, documents, START, embed_fn=embed)
        assert states(spark, log) == {("1", "done", 0), ("2", "waiting", 1)} and outcomes(spark, log).count() == 1
        assert stored(spark, store) == {"a": ("ready", True), "b": ("processing", False)}


def test_summaries_that_fail(spark, tmp_path, documents):
    log, store = str(tmp_path / "log"), str(tmp_path / "store")

    def summarize(texts):
        return ["" if "Alpha" in t else f"About {len(t)}\n- point" for t in texts]

    run_round(spark, log, store, "one", frame(spark, [task(d, task_id=d) for d in "abd"]), documents, START, summarize_fn=summarize, width=8)
    assert states(spark, log) == {("a", "waiting", 1), ("b", "done", 0), ("d", "done", 0)}
    tables = load_tables(spark, store, newest=True)
    assert {r["document_id"]: r["key_points"] for r in tables["summaries"].collect()} == {"b": ["point"], "d": ["point"]}


def test_stream_of_tasks(spark, tmp_path, documents):
    source, log, store = str(tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "store")
    schema = "payload string, task_type string, max_attempts int, task_id string"
    for rows in ([task("a"), task("b")], [task("d")]):
        frame(spark, rows).coalesce(1).write.mode("append").parquet(source)
    times = iter([START, START + timedelta(seconds=5)])
    analyze_tasks_stage(read_file_stream(spark, source, schema, files_per_batch=1), log, store, documents, lambda: next(times), embed_fn=embed)
    assert stored(spark, store) == {"a": ("ready", True), "b": ("processing", False), "d": ("ready", True)}
    assert [(r["document_id"], r["attempts"]) for r in waiting_tasks(spark, log).collect()] == [("b", 2)]  # due in the second round
    analyze_tasks_stage(read_file_stream(spark, source, schema, files_per_batch=1), log, store, documents, embed_fn=embed)  # nothing new
    assert outcomes(spark, log).count() == 2
