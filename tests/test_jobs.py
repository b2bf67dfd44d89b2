import json

import pytest
from pyspark.sql import functions as F

from folioquery import jobs
from folioquery.session import settings_for
from folioquery.sources.index import load_index
from folioquery.sources.store import WidthMismatch, load_tables


def test_from_files_to_answers(spark, tmp_path):
    uploads, store = tmp_path / "uploads", str(tmp_path / "store")
    uploads.mkdir()
    (uploads / "birds.txt").write_text("Owls hunt mice at night. Eagles hunt fish by day.")
    (uploads / "notes.txt").write_text("Engines burn fuel.")
    (uploads / "big.txt").write_text("x" * 2000)
    (uploads / "pic.png").write_text("no")
    outcome = {r["filename"]: r for r in jobs.ingest(spark, str(uploads), store, "1", 1000, width=64).collect()}
    assert outcome["big.txt"]["error"] == "file too large (max 1000 bytes)"
    assert outcome["pic.png"]["error"].startswith("unsupported file type")
    assert outcome["birds.txt"]["error"] is None
    # A repeated batch gives the same rows once.
    jobs.ingest(spark, str(uploads), store, "1", 1000, width=64)
    tables = load_tables(spark, store)
    assert {n: t.count() for n, t in tables.items()} == {"documents": 2, "chunks": 2, "summaries": 2, "embeddings": 2}
    jobs.index(spark, store, str(tmp_path / "index"), lists=2)
    assert load_index(spark, store, str(tmp_path / "index")).vectors.count() == 2

    ids = [r["document_id"] for r in tables["documents"].collect()]
    requests = tmp_path / "requests.json"
    asked = {"question_id": "q", "question": "When do owls hunt mice?", "document_ids": ids}
    requests.write_text(json.dumps(asked) + "\n" + json.dumps({"question_id": "bad", "question": ""}) + "\n")
    cache = str(tmp_path / "cache")
    for run, cached in ((1, False), (2, True)):
        answers = str(tmp_path / f"answers{run}")
        jobs.ask(spark, store, str(requests), answers, cache, threshold=0.2, width=64)
        row = spark.read.json(f"{answers}/answers").first()
        answer = json.loads(row["json"])
        assert (row["question_id"], answer["answer"], answer["cached"]) == ("q", "Owls hunt mice at night", cached)
        rejected = spark.read.json(f"{answers}/rejected").first()
        assert rejected["error"] == "Question is required; DocumentIDs is required"
    with_lists = str(tmp_path / "answers3")
    jobs.ask(spark, store, str(requests), with_lists, None, str(tmp_path / "index"), nprobe=2, threshold=0.2, width=64)
    assert json.loads(spark.read.json(f"{with_lists}/answers").first()["json"])["answer"] == "Owls hunt mice at night"
    assert spark.read.parquet(f"{cache}/entries").where(F.col("key").isNotNull()).count() == 1


def test_settings_follow_the_size():
    assert settings_for(1 << 20)["spark.sql.shuffle.partitions"] == "200"
    assert settings_for(100 << 40)["spark.sql.shuffle.partitions"] == str(100 * 4 * 1024)


def test_every_file_and_request_has_an_outcome(spark, tmp_path):
    uploads, store = tmp_path / "uploads", str(tmp_path / "store")
    for folder in ("a", "b"):
        (uploads / folder).mkdir(parents=True)
        (uploads / folder / "same.txt").write_text("Owls hunt mice at night.")
    (uploads / "paper.pdf").write_bytes(b"%PDF-1.4 not text")
    outcome = [r["error"] for r in jobs.ingest(spark, str(uploads), store, "1", width=64).collect() if r["filename"] == "paper.pdf"]
    assert outcome == ["no text can be read from application/pdf"]
    tables = load_tables(spark, store)
    assert {n: t.count() for n, t in tables.items()} == {"documents": 2, "chunks": 2, "summaries": 2, "embeddings": 2}
    assert spark.read.parquet(f"{store}/rejected").count() == 1
    ids = [r["document_id"] for r in tables["documents"].collect()]
    good = {"question_id": "q", "question": "When do owls hunt?", "document_ids": ids}
    lines = [good, good | {"question_id": "t", "top_k": "x"}, good | {"question_id": "b", "question": "\u0001\u0002\u0003\u0004"}]
    requests = tmp_path / "requests.json"
    requests.write_text("\n".join(map(json.dumps, lines)) + "\n{broken\n")
    jobs.ask(spark, store, str(requests), str(tmp_path / "answers"), threshold=0.2, width=64)
    answered = spark.read.json(str(tmp_path / "answers" / "answers")).collect()
    assert [r["question_id"] for r in answered] == ["q"]
    rejected = {r.asDict().get("question_id"): r["error"] for r in spark.read.json(str(tmp_path / "answers" / "rejected")).collect()}
    assert rejected == {"t": "invalid payload", "b": "Question is blank", None: "invalid payload"}


def test_a_document_of_two_batches_is_read_once(spark, tmp_path):
    uploads, store = tmp_path / "uploads", str(tmp_path / "store")
    uploads.mkdir()
    (uploads / "birds.txt").write_text("Owls hunt mice at night.")
    jobs.ingest(spark, str(uploads), store, "01", width=64)
    (uploads / "notes.txt").write_text("Engines burn fuel.")
    jobs.ingest(spark, str(uploads), store, "1", width=64)
    jobs.ingest(spark, str(uploads), store, "02", width=64)
    tables = load_tables(spark, store, newest=True)
    assert {n: t.count() for n, t in tables.items()} == {"documents": 2, "chunks": 2, "summaries": 2, "embeddings": 2}
    assert load_tables(spark, store)["documents"].count() == 5  # one for `01`, two each for `1` and `02`


def test_large_files_are_refused_by_their_listed_size(spark, tmp_path):
    from folioquery.sources.files import read_uploads

    (tmp_path / "small.txt").write_text("x" * 10)
    (tmp_path / "large.txt").write_text("x" * 11)
    files = {r["filename"]: (r["size"], r["content"]) for r in read_uploads(spark, str(tmp_path), max_bytes=10).collect()}
    assert files == {"small.txt": (10, bytearray(b"x" * 10)), "large.txt": (11, None)}


def test_later_batches_join_the_index_and_deleted_documents_leave(spark, tmp_path):
    uploads, store, lists = tmp_path / "uploads", str(tmp_path / "store"), str(tmp_path / "index")
    uploads.mkdir()
    (uploads / "birds.txt").write_text("Owls hunt mice at night.")
    (uploads / "cars.txt").write_text("Engines burn fuel.")
    jobs.ingest(spark, str(uploads), store, "1", width=64)
    jobs.index(spark, store, lists, lists=2)
    (uploads / "notes.txt").write_text("Bees make honey in summer.")
    jobs.ingest(spark, str(uploads), store, "2", width=64)
    for _ in range(2):  # adding again changes nothing
        jobs.index(spark, store, lists, append=True)
        assert load_index(spark, store, lists).vectors.count() == 3
    ids = {r["filename"]: r["document_id"] for r in load_tables(spark, store, newest=True)["documents"].collect()}
    requests = tmp_path / "requests.json"
    requests.write_text(json.dumps({"question_id": "q", "question": "Who makes honey?", "document_ids": list(ids.values())}))

    cache = str(tmp_path / "cache")

    def answer(name):
        jobs.ask(spark, store, str(requests), str(tmp_path / name), cache, lists, str(tmp_path / "vectors"), nprobe=2, threshold=0.1, width=64)
        return json.loads(spark.read.json(str(tmp_path / name / "answers")).first()["json"])

    first = answer("one")
    assert first["answer"] == "Bees make honey in summer" and not first["cached"]
    # It is the nearest of the three chunks, not a lucky one.
    texts = {r["chunk_id"]: r["text"] for r in load_tables(spark, store, newest=True)["chunks"].collect()}
    assert texts[first["sources"][0]["chunk_id"]] == "Bees make honey in summer."
    assert answer("again")["cached"]
    gone = tmp_path / "gone.json"
    gone.write_text(json.dumps({"document_id": ids["notes.txt"]}))
    jobs.delete(spark, store, str(gone))
    left = load_tables(spark, store, newest=True)
    assert {n: t.where(F.col("document_id") == ids["notes.txt"]).count() for n, t in left.items()} == dict.fromkeys(left, 0)
    assert {n: t.count() for n, t in left.items()} == dict.fromkeys(left, 2)
    without = answer("two")
    assert without["answer"] != "Bees make honey in summer" and not without["cached"]
    assert spark.read.parquet(str(tmp_path / "vectors" / "entries")).count() == 1
    # Listed again with other windows, the index has the new chunks only.
    (uploads / "notes.txt").write_text("Bees make honey in summer.")
    jobs.ingest(spark, str(uploads), store, "2", width=64, max_words=2, overlap=0)
    assert load_tables(spark, store, newest=True)["documents"].count() == 3
    jobs.index(spark, store, lists, append=True)
    chunks = {r["chunk_id"] for r in load_tables(spark, store, newest=True)["chunks"].collect()}
    assert {r["chunk_id"] for r in load_index(spark, store, lists).vectors.collect()} == chunks and len(chunks) == 3 + 2 + 3
    jobs.delete(spark, store, str(gone), [cache])  # the links name the answers that used it
    assert spark.read.parquet(f"{cache}/dropped").count() == 1


def test_a_store_keeps_to_the_width_of_its_model(spark, tmp_path):
    uploads, store, cache = tmp_path / "uploads", str(tmp_path / "store"), str(tmp_path / "cache")
    uploads.mkdir()
    (uploads / "birds.txt").write_text("Owls hunt mice at night.")
    jobs.ingest(spark, str(uploads), store, "1", width=64)
    with pytest.raises(WidthMismatch):
        jobs.ingest(spark, str(uploads), store, "2", width=32)
    ids = [r["document_id"] for r in load_tables(spark, store)["documents"].collect()]
    requests = tmp_path / "requests.json"
    requests.write_text(json.dumps({"question_id": "q", "question": "When do owls hunt?", "document_ids": ids}))
    jobs.ask(spark, store, str(requests), str(tmp_path / "answers"), cache, width=32)
    rejected = spark.read.json(str(tmp_path / "answers" / "rejected")).collect()
    assert [(r["question_id"], r["error"]) for r in rejected] == [("q", "the question's vector is 32 wide, no stored vector is")]
    assert not (tmp_path / "cache").exists()
