"""Commits, merging by commit order, compaction, widths."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from folioquery.operators.embedding import HASH_MODEL
from folioquery.plans.analyze import analyze_documents
from folioquery.sources import store
from folioquery.sources.commits import Commit, CommitConflict, commit, names_in, read_commits
from folioquery.sources.store import (
    WidthMismatch,
    compact,
    delete_documents,
    deletions,
    load_tables,
    register_model,
    remove_superseded,
    save_rows,
    save_tables,
    update_statuses,
    violations,
)

DOCS = "document_id string, filename string, content string"


def analyzed(spark, rows, **options):
    return analyze_documents(spark.createDataFrame([(i, f"{i}.txt", t) for i, t in rows], DOCS), width=8, **options)


def state(spark, path, newest=True):
    """What a reader sees: id -> (status, summary, chunk texts, number of vectors)."""
    t = {n: [r.asDict() for r in f.collect()] for n, f in load_tables(spark, path, newest=newest).items()}
    out = {}
    for d in t["documents"]:
        own = lambda name: [r for r in t[name] if r["document_id"] == d["document_id"]]  # noqa: B023, E731
        chunks = sorted(own("chunks"), key=lambda r: r["ord"])
        summary = [r["summary"] for r in own("summaries")]
        out[d["document_id"]] = (d["status"], summary[0] if len(summary) == 1 else summary, [c["text"] for c in chunks], len(own("embeddings")))
    return out


def test_a_failed_job_leaves_the_old_batch(spark, tmp_path):
    path = str(tmp_path / "s")
    save_tables(analyzed(spark, [("a", "One two."), ("b", "Three.")]), path, "1")
    before = state(spark, path)
    new = analyzed(spark, [("a", "Other words."), ("c", "New.")])
    for broken in ("chunks", "summaries", "embeddings", "documents"):
        failing = new | {broken: new[broken].withColumn("document_id", F.raise_error(F.lit("lost")).cast("string"))}
        with pytest.raises(Exception, match="lost"):
            save_tables(failing, path, "1")
        assert state(spark, path) == before
    save_tables(new, path, "1")
    assert set(state(spark, path)) == {"a", "c"}  # the batch was replaced as a whole
    with pytest.raises(ValueError):
        save_tables({"chunks": new["chunks"]}, path, "2")


def test_every_number_is_claimed_once(spark, tmp_path):
    path = str(tmp_path / "s")
    with ThreadPoolExecutor(4) as jobs:
        found = list(jobs.map(lambda n: commit(spark, path, Commit("batch", str(n))).number, range(8)))
    assert sorted(found) == list(range(1, 9))
    assert [c.number for c in read_commits(spark, path)] == list(range(1, 9))
    assert [c.number for c in read_commits(spark, path, after=6)] == [7, 8]
    with pytest.raises(CommitConflict):
        commit(spark, path, Commit("batch", "x"), lambda known: "no")
    assert not [n for n in names_in(spark, f"{path}/_commits") if not n.endswith(".json") and not n.startswith(".")]


def test_newest_is_the_order_of_commits(spark, tmp_path):
    path = str(tmp_path / "s")
    save_tables(analyzed(spark, [("a", "Old text here."), ("b", "Stays.")]), path, "a longer name")
    save_tables(analyzed(spark, [("a", "one two three four")], max_words=2, overlap=0), path, "b2")
    assert state(spark, path) == {
        "a": ("ready", "one two three four", ["one two", "three four"], 2), "b": ("ready", "Stays", ["Stays."], 1)
    }
    assert load_tables(spark, path)["documents"].count() == 3
    save_tables(analyzed(spark, [("a", "Old text here."), ("b", "Stays.")]), path, "a longer name")  # the last again
    assert state(spark, path)["a"][2] == ["Old text here."]


def test_later_rows_replace_rows_until_the_document_comes_again(spark, tmp_path):
    path = str(tmp_path / "s")
    save_tables(analyzed(spark, [("a", "Alpha."), ("b", "Beta.")]), path, "1")
    rows = [("a", "failed", 1), ("a", "processing", 2), ("b", "odd", 3), ("z", "ready", 4)]
    unknown = update_statuses(spark.createDataFrame(rows, "document_id string, status string, seq int"), path, ["seq"])
    assert {(r["document_id"], r["error"]) for r in unknown.collect()} == {("b", "unknown status"), ("z", "document not found")}
    save_rows({"summaries": spark.createDataFrame([("b", "new", ["p"]), ("z", "x", [])], "document_id string, summary string, key_points array<string>")}, path)
    chunk = load_tables(spark, path)["embeddings"].where("document_id = 'b'").first()
    changed = spark.createDataFrame([(chunk["chunk_id"], "b", [9.0] * 8, HASH_MODEL)], "chunk_id string, document_id string, vector array<float>, model string")
    save_rows({"embeddings": changed}, path)
    now = state(spark, path)
    assert now["a"][:2] == ("processing", "Alpha") and now["b"][:2] == ("ready", "new") and set(now) == {"a", "b"}
    vectors = {r["document_id"]: r["vector"] for r in load_tables(spark, path, newest=True)["embeddings"].collect()}
    assert vectors["b"] == [9.0] * 8 and len(vectors) == 2
    assert compact(spark, path).kind == "compaction"
    assert state(spark, path) == now
    save_tables(analyzed(spark, [("b", "Beta.")]), path, "2")
    assert state(spark, path)["b"] == ("ready", "Beta", ["Beta."], 1)
    assert state(spark, path)["a"][0] == "processing"
    with pytest.raises(ValueError):
        save_rows({"chunks": changed}, path)


def test_deletions_hold_until_the_document_comes_again(spark, tmp_path):
    path = str(tmp_path / "s")
    both = analyzed(spark, [("a", "Alpha."), ("b", "Beta.")])
    save_tables(both, path, "1")
    assert deletions(spark, path) is None
    gone = spark.createDataFrame([("a",), ("a",), ("y",)], "document_id string")
    delete_documents(gone, path)
    assert set(state(spark, path)) == {"b"} == set(state(spark, path, newest=False))
    compact(spark, path)
    assert set(state(spark, path)) == {"b"} and deletions(spark, path).count() == 2  # caches still ask for them
    save_tables(both, path, "1")
    assert set(state(spark, path)) == {"a", "b"}


def test_compaction(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    assert compact(spark, path) is None
    save_tables(analyzed(spark, [("a", "Alpha."), ("b", "Beta.")]), path, "1")
    assert compact(spark, path) is None  # one version already
    save_tables(analyzed(spark, [("b", "Other."), ("c", "Gamma.")]), path, "2")
    update_statuses(spark.createDataFrame([("a", "failed", 1)], "document_id string, status string, seq int"), path, ["seq"])
    before = state(spark, path)
    real = store._write

    def slow(*args, **options):  # another batch is committed while the compaction is written
        monkeypatch.setattr(store, "_write", real)
        save_tables(analyzed(spark, [("d", "Delta.")]), path, "3")
        return real(*args, **options)

    monkeypatch.setattr(store, "_write", slow)
    compact(spark, path)
    assert state(spark, path) == before | {"d": ("ready", "Delta", ["Delta."], 1)}
    # A batch that a compaction holds is still replaced as a whole.
    save_tables(analyzed(spark, [("c", "Gamma two.")]), path, "2")
    after = state(spark, path)
    assert set(after) == {"a", "c", "d"} and after["a"][0] == "failed" and after["c"][2] == ["Gamma two."]

    def meanwhile(*args, **options):
        monkeypatch.setattr(store, "_write", real)
        compact(spark, path)
        return real(*args, **options)

    monkeypatch.setattr(store, "_write", meanwhile)
    with pytest.raises(CommitConflict):
        compact(spark, path)
    assert state(spark, path) == after
    assert remove_superseded(spark, path, 3600) == []
    removed = remove_superseded(spark, path, -1)
    assert removed and state(spark, path) == after
    assert len(names_in(spark, f"{path}/documents")) == 1
    save_tables(analyzed(spark, [("e", "Epsilon.")]), path, "4")
    assert set(state(spark, path)) == {"a", "c", "d", "e"}


def test_widths_of_models(spark, tmp_path):
    path = str(tmp_path / "s")
    register_model(spark, path, HASH_MODEL, 8)
    register_model(spark, path, HASH_MODEL, 8)
    with pytest.raises(WidthMismatch):
        register_model(spark, path, HASH_MODEL, 9)
    tables = analyzed(spark, [("a", "Alpha."), ("b", "Beta.")])
    save_tables(tables, path, "1")
    assert violations(spark, path) is None
    short = tables["embeddings"].withColumn("vector", F.when(F.col("document_id") == "a", F.slice("vector", 1, 3)).otherwise(F.col("vector")))
    save_tables(tables | {"embeddings": short}, path, "2")
    report = [(r["document_id"], r["model"], r["width"]) for r in violations(spark, path).collect()]
    assert report == [("a", HASH_MODEL, 3)]
    assert {k: v[3] for k, v in state(spark, path).items()} == {"a": 0, "b": 1}
    compact(spark, path)
    assert violations(spark, path).count() == 1 and store.stored_models(spark, path) == {HASH_MODEL: 8}


def test_an_empty_store_says_so(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load_tables(spark, str(tmp_path / "none"))
