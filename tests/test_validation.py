from pyspark.sql import functions as F

from folioquery.functions.validation import effective_top_k, parse_document_ids
from folioquery.plans.ask import validated
from folioquery.sources.files import (
    assemble_pages,
    decode_text,
    ingest_documents,
    read_uploads,
    validate_uploads,
)

ID = "0b8f4a1e-3c5d-4e6f-8a9b-0c1d2e3f4a5b"
REQUEST = "question_id string, question string, document_ids array<string>, top_k int"


def errors(spark, question, ids, top_k=None):
    return validated(spark.createDataFrame([("q", question, ids, top_k)], REQUEST)).first()["error"]


def test_valid_request(spark):
    assert errors(spark, "What is this?", [ID]) is None
    assert errors(spark, "What is this?", [ID], 20) is None
    assert errors(spark, "é" * 500, [ID]) is None


def test_rejected_requests(spark):
    assert errors(spark, "", [ID]) == "Question is required"
    assert errors(spark, None, [ID]) == "Question is required"
    assert errors(spark, "Hi", [ID]) == "Question must be at least 3"
    assert errors(spark, "x" * 501, [ID]) == "Question must be at most 500"
    assert errors(spark, "What?", ["not-an-id"]) == "DocumentIDs[0] must be a valid UUID"
    assert errors(spark, "What?", [ID, ID.upper()]) == "DocumentIDs[1] must be a valid UUID"
    assert errors(spark, "What?", [ID.replace("-4e6f", "-1e6f")]) == "DocumentIDs[0] must be a valid UUID"
    assert errors(spark, "What?", []) == "DocumentIDs must be at least 1"
    assert errors(spark, "What?", None) == "DocumentIDs is required"
    assert errors(spark, "What?", [ID], 25) == "TopK must be at most 20"
    assert errors(spark, "What?", [ID], -1) == "TopK must be at least 1"


def test_all_violations_are_reported(spark):
    assert errors(spark, "", ["x", ID, "y"], 21) == (
        "Question is required; DocumentIDs[0] must be a valid UUID; DocumentIDs[2] must be a valid UUID; "
        "TopK must be at most 20"
    )


def test_default_top_k(spark):
    frame = spark.createDataFrame([(None,), (0,), (7,)], "k int")
    assert [r[0] for r in frame.select(effective_top_k(F.col("k"))).collect()] == [5, 5, 7]


def test_id_spellings(spark):
    plain = ID.replace("-", "")
    ids = [ID, ID.upper(), "urn:uuid:" + ID, "{" + ID + "}", plain, "bad", "", ID + "0", plain[:-1] + "g"]
    frame = spark.createDataFrame([(ids,)], "ids array<string>")
    assert frame.select(parse_document_ids(F.col("ids"))).first()[0] == [ID] * 5


def test_uploads(spark):
    rows = [
        (0, "a.txt", "text/plain", b"hello"),
        (1, "b.txt", "text/plain", b"x" * (2 << 20)),
        (2, "c.TXT", "", b"hello"),
        (3, "d.docx", "", b"hello"),
        (4, "e.doc", "application/msword", b"hello"),
        (5, "f.pdf", None, b"hello"),
        (6, "dir.txt/name", "", b"hello"),
        (7, "g.txt", "text/plain", b"x" * (1 << 20)),
    ]
    uploads = spark.createDataFrame(rows, "i int, filename string, content_type string, content binary")
    found = validate_uploads(uploads, 1 << 20).orderBy("i").collect()
    unsupported = "unsupported file type (only PDF and TXT allowed)"
    assert [r["error"] for r in found] == [
        None, "file too large (max 1048576 bytes)", None, unsupported, unsupported, None, unsupported, None,
    ]
    assert [r["resolved_type"] for r in found][2] == "text/plain"
    assert [r["resolved_type"] for r in found][5] == "application/pdf"


def test_files_become_documents(spark, tmp_path):
    (tmp_path / "one.txt").write_bytes("größe\n".encode())
    (tmp_path / "two.txt").write_bytes(b"bad \xff byte")
    uploads = validate_uploads(read_uploads(spark, str(tmp_path)))
    assert uploads.where("error IS NOT NULL").count() == 0
    docs = ingest_documents(uploads, F.sha2("filename", 256), F.col("modified_at"))
    found = {r["filename"]: r for r in docs.collect()}
    assert found["one.txt"]["content"] == "größe\n"
    assert found["two.txt"]["content"] == "bad � byte"
    assert {r["status"] for r in found.values()} == {"processing"}


def test_decode_keeps_valid_text(spark):
    frame = spark.createDataFrame([(bytearray("añ\n".encode()),)], "b binary")
    assert frame.select(decode_text(F.col("b"))).first()[0] == "añ\n"


def test_pages_in_order_without_the_missing_ones(spark):
    rows = [("d", 2, "two"), ("d", 10, "ten"), ("d", 1, "one"), ("d", 3, None), ("e", 1, None), ("f", 1, "")]
    pages = spark.createDataFrame(rows, "document_id string, page_no int, text string")
    found = {r["document_id"]: r["content"] for r in assemble_pages(pages).collect()}
    assert found == {"d": "one\ntwo\nten\n", "e": "", "f": "\n"}
