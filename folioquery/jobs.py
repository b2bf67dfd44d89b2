"""Jobs for spark-submit: ingest a corpus, build the list index, answer a batch of questions.

    python -m folioquery.jobs ingest --uploads FOLDER --store FOLDER --batch 2024-05-01
    python -m folioquery.jobs index  --store FOLDER --index FOLDER --lists 100
    python -m folioquery.jobs index  --store FOLDER --index FOLDER --append      (after a later ingest)
    python -m folioquery.jobs ask    --store FOLDER --requests FILE.json --answers FOLDER
    python -m folioquery.jobs delete --store FOLDER --documents FILE.json
"""

from __future__ import annotations

import argparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioquery.functions.validation import MAX_UPLOAD_BYTES
from folioquery.operators.answering import answer_json
from folioquery.operators.cache import DEFAULT_TTL_SECONDS
from folioquery.operators.chunking import DEFAULT_MAX_WORDS, DEFAULT_OVERLAP
from folioquery.operators.embedding import DEFAULT_WIDTH, HASH_MODEL
from folioquery.operators.ivf import DEFAULT_LISTS
from folioquery.operators.similarity import MIN_SIMILARITY
from folioquery.plans.analyze import analyze_documents
from folioquery.plans.ask import answer_questions
from folioquery.schemas import REQUESTS
from folioquery.session import build_session, materialize
from folioquery.sources.files import ingest_documents, read_uploads, validate_uploads
from folioquery.sources.cache_store import ANSWERS, VECTORS, add_entries, drop_answers, entries_of, without_deleted
from folioquery.sources.index import build_index, extend_index, open_index
from folioquery.sources.store import delete_documents, deletions, load_tables, register_model, save_json, save_tables, stored_models


def derived_id(*parts: str | Column) -> Column:
    """A version-4 shaped id derived from its parts, the same on every run."""
    h = F.sha2(F.concat_ws("\n", *parts), 256)
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)),
        F.concat(F.lit("a"), F.substring(h, 18, 3)), F.substring(h, 21, 12),
    )


def ingest(spark: SparkSession, uploads: str, store: str, batch: str, max_bytes: int = MAX_UPLOAD_BYTES,
           **options) -> DataFrame:
    """Store the accepted text files of a folder as a batch; returns (filename, document_id, error).

    The id comes from the path below the folder and the content, so equal files in two places are two
    documents. Files that are refused, or whose type has no text here, are stored as `rejected`.
    """
    checked = validate_uploads(read_uploads(spark, uploads, max_bytes=max_bytes), max_bytes)
    root = uploads.rstrip("/").rsplit("/", 1)[-1]
    below = F.regexp_replace("path", f"^.*?/\\Q{root}\\E/", "")
    no_text = F.when(F.col("resolved_type") != "text/plain", F.concat(F.lit("no text can be read from "), "resolved_type"))
    identified = checked.withColumn("document_id", derived_id(below, F.sha2("content", 256))).withColumn(
        "error", F.coalesce("error", no_text)
    )
    accepted = ingest_documents(identified.where("error IS NULL"), F.col("document_id"), F.col("modified_at"))
    accepted = materialize(accepted, "accepted")  # the files are read once for all four tables
    register_model(spark, store, options.get("model", HASH_MODEL), options.get("width", DEFAULT_WIDTH))
    save_tables(analyze_documents(accepted, **options), store, batch)
    outcome = identified.select("filename", F.when(F.col("error").isNull(), F.col("document_id")).alias("document_id"), "error")
    outcome = materialize(outcome, "outcome")
    outcome.where("error IS NOT NULL").write.mode("overwrite").parquet(f"{store.rstrip('/')}/rejected/batch={batch}")
    return outcome


def index(spark: SparkSession, store: str, target: str, lists: int = DEFAULT_LISTS, train_fraction: float = 1.0,
          append: bool = False) -> None:
    """Build the index of a store, or with `append` list what was stored since. Questions do that by themselves."""
    if append:
        extend_index(spark, store, target)
    else:
        build_index(spark, store, target, lists, train_fraction)


def delete(spark: SparkSession, store: str, documents: str, caches: list[str] | None = None) -> None:
    """Delete the documents that JSON lines (document_id) name, with all that belongs to them.

    Answers that used them are not served any more; from `caches` they are dropped as well.
    """
    gone = spark.read.schema("document_id string").json(documents).where("document_id IS NOT NULL")
    delete_documents(gone, store)
    for cache in caches or []:
        drop_answers(gone, cache)


def ask(spark: SparkSession, store: str, requests: str, answers: str, cache: str | None = None,
        index_path: str | None = None, embedding_cache: str | None = None, **options) -> None:
    """Answer JSON-lines requests (question_id, question, document_ids, top_k) into a folder.

    `cache` and `embedding_cache` name folders of earlier answers and question vectors; of these only the entries of the
    asked keys are read, and new ones are added. With `index_path` the search is restricted to the nearest lists, else it is exact.
    """
    if index_path:
        options["index"] = open_index(spark, store, index_path)
    now = spark.sql("SELECT current_timestamp() AS now").first()["now"]  # one clock for the whole job
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in REQUESTS), T.StructField("_line", T.StringType())])
    read = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_line").json(requests)
    read = materialize(read.withColumn("asked_at", F.lit(now)), "asked")
    # Lines that are no request, or have a field of another type.
    malformed = read.where("_line IS NOT NULL").select(
        F.coalesce("question_id", F.get_json_object("_line", "$.question_id")).alias("question_id"), F.lit("invalid payload").alias("error")
    )
    asked = read.where("_line IS NULL").drop("_line")
    gone = deletions(spark, store)
    result = answer_questions(
        asked, load_tables(spark, store, newest=True), widths=sorted({*stored_models(spark, store).values()}) or None,
        cache=None if cache is None else lambda keys: without_deleted(entries_of(keys, cache, ANSWERS), gone),
        embedding_cache=None if embedding_cache is None else lambda keys: entries_of(keys, embedding_cache, VECTORS), **options,
    )
    save_json(answer_json(result.answers), f"{answers.rstrip('/')}/answers")
    save_json(result.rejected.unionByName(malformed), f"{answers.rstrip('/')}/rejected")
    if cache:
        add_entries(result.cache_entries, cache)
    if embedding_cache:
        add_entries(result.embedding_entries, embedding_cache)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="folioquery")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("ingest")
    for name in ("--uploads", "--store", "--batch"):
        one.add_argument(name, required=True)
    one.add_argument("--max-bytes", type=int, default=MAX_UPLOAD_BYTES)
    one.add_argument("--max-words", type=int, default=DEFAULT_MAX_WORDS)
    one.add_argument("--overlap", type=int, default=DEFAULT_OVERLAP)
    one.add_argument("--width", type=int, default=DEFAULT_WIDTH)
    one = commands.add_parser("index")
    for name in ("--store", "--index"):
        one.add_argument(name, required=True)
    one.add_argument("--lists", type=int, default=DEFAULT_LISTS)
    one.add_argument("--train-fraction", type=float, default=1.0)
    one.add_argument("--append", action="store_true")
    one = commands.add_parser("delete")
    one.add_argument("--store", required=True)
    one.add_argument("--documents", required=True)
    one.add_argument("--cache", action="append")
    one = commands.add_parser("ask")
    for name in ("--store", "--requests", "--answers"):
        one.add_argument(name, required=True)
    one.add_argument("--cache")
    one.add_argument("--embedding-cache")
    one.add_argument("--index")
    one.add_argument("--nprobe", type=int, help="lists to search, instead of the number that was measured for the index")
    one.add_argument("--threshold", type=float, default=MIN_SIMILARITY)
    one.add_argument("--ttl-seconds", type=int, default=DEFAULT_TTL_SECONDS)
    one.add_argument("--width", type=int, default=DEFAULT_WIDTH)
    given = parser.parse_args(arguments)
    spark = build_session()
    if given.command == "ingest":
        outcome = ingest(spark, given.uploads, given.store, given.batch, given.max_bytes,
                         max_words=given.max_words, overlap=given.overlap, width=given.width)
        print(f"{outcome.where('error IS NOT NULL').count()} files rejected, see {given.store}/rejected")
    elif given.command == "index":
        index(spark, given.store, given.index, given.lists, given.train_fraction, given.append)
    elif given.command == "delete":
        delete(spark, given.store, given.documents, given.cache)
    else:
        ask(spark, given.store, given.requests, given.answers, given.cache, given.index, given.embedding_cache, nprobe=given.nprobe,
            threshold=given.threshold, ttl_seconds=given.ttl_seconds, width=given.width)


if __name__ == "__main__":
    main()
