"""The analyse stage as a worker of tasks: what the parse stage hands over is analysed, retried or given up.

A round takes in the tasks of a micro-batch, adds those that waited and are due now, and ends each in one of these states:

* done: the document's chunks, summary and embeddings are in the store, its status is ready;
* waiting: the analysis failed; the task is due again after its delay, the document is processing;
* dead: it failed as often as it may; the document is failed;
* quarantined: it has no type, an unknown type, or a payload that names no document.

A document that fails takes no other with it. The store is committed first, as a batch named by the round, and then the log
with the new waiting list and the outcomes as one commit: a round that is run again replaces its batch, a round whose
log is committed is not run again.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from folioquery.operators.tasks import decode_payloads, due_tasks, retry_state, task_route
from folioquery.plans.analyze import analyze_isolated
from folioquery.schemas import ANALYZE_PAYLOAD, STATUS_FAILED, STATUS_PROCESSING, STATUS_READY
from folioquery.session import materialize, spread
from folioquery.sources.commits import Commit, commit, new_version, read_commits
from folioquery.sources.store import load_tables, save_rows, save_tables
from folioquery.streaming.stages import run_to_end

TASK_TYPES = ["parse", "analyze"]  # of all workers; this one takes the second
WAITING = "task_id string, document_id string, payload string, attempts int, max_attempts int, not_before timestamp"
OUTCOMES = "task_id string, document_id string, state string, attempts int, error string, finished_at timestamp"
NO_DOCUMENT = "payload names no document"


def take_in(tasks: DataFrame) -> DataFrame:
    """tasks(payload, task_type[, task_id, attempts, max_attempts, not_before]) as WAITING with `error`.

    A task without an id is named by its type and payload, so one that is handed over twice is one task. Tasks
    of other workers are left out.
    """
    decoded = decode_payloads(tasks, "payload", ANALYZE_PAYLOAD)
    route = task_route(TASK_TYPES)
    document = F.col("decoded.document_id")
    error = F.when(~F.startswith(route, F.lit("tasks.")), route).when(F.col("malformed") | document.isNull(), F.lit(NO_DOCUMENT))

    def given(name: str, kind: str):
        return (F.col(name) if name in tasks.columns else F.lit(None)).cast(kind)

    named = F.sha2(F.concat_ws("\n", F.coalesce("task_type", F.lit("")), F.coalesce("payload", F.lit(""))), 256)
    return decoded.where(F.coalesce(route != f"tasks.{TASK_TYPES[0]}", F.lit(True))).select(
        F.coalesce(given("task_id", "string"), named).alias("task_id"),
        document.alias("document_id"),
        "payload",
        F.coalesce(given("attempts", "int"), F.lit(0)).alias("attempts"),
        given("max_attempts", "int").alias("max_attempts"),
        given("not_before", "timestamp").alias("not_before"),
        error.alias("error"),
    )


def _log_commits(spark: SparkSession, log: str) -> list[Commit]:
    return [c for c in read_commits(spark, log) if c.kind == "round"]


def _table(spark: SparkSession, log: str, name: str, commits: list[Commit], schema: str) -> DataFrame:
    paths = [f"{log}/{name}/version={c.version}" for c in commits]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def waiting_tasks(spark: SparkSession, log: str) -> DataFrame:
    """The tasks that wait for their time: those of the last round."""
    return _table(spark, log.rstrip("/"), "waiting", _log_commits(spark, log.rstrip("/"))[-1:], WAITING)


def outcomes(spark: SparkSession, log: str) -> DataFrame:
    """What became of the tasks that are not waiting; a task that was handed over again has a row for each time."""
    return _table(spark, log.rstrip("/"), "outcomes", _log_commits(spark, log.rstrip("/")), OUTCOMES)


def run_round(
    spark: SparkSession, log: str, store: str, name: str, arrived: DataFrame | None, documents: DataFrame, now: datetime, **options: Any
) -> None:
    """One round under a name that is its own: the same name is not run twice.

    documents(document_id, filename, content, ...) are looked up by the ids of the due tasks; `options` are those of the
    analysis (models, windows, width).
    """
    log, store = log.rstrip("/"), store.rstrip("/")
    rounds = _log_commits(spark, log)
    if any(c.name == name for c in rounds):
        return
    at = F.lit(now).cast("timestamp")
    held = _table(spark, log, "waiting", rounds[-1:], WAITING)
    new = spark.createDataFrame([], f"{WAITING}, error string") if arrived is None else take_in(arrived)
    new = materialize(new, "tasks-arrived")
    open_ = held.unionByName(new.where("error IS NULL").drop("error"))
    # A task that is handed over again while it waits keeps its state.
    first = F.max_by(F.struct("document_id", "payload", "attempts", "max_attempts", "not_before"), "attempts")
    tasks = materialize(open_.groupBy("task_id").agg(first.alias("t")).select("task_id", "t.*"), "tasks-open")
    due = due_tasks(tasks, at)
    wanted = due.select("document_id").distinct()
    known = documents.withColumn("_id", F.col("document_id").cast("string"))
    found = known.join(wanted.withColumnRenamed("document_id", "_id"), "_id", "left_semi")
    found = materialize(found, "tasks-documents")
    tables, failures = analyze_isolated(spread(found.drop("_id")), **options)
    failures = materialize(failures.select(F.col("document_id").cast("string").alias("document_id"), "error"), "tasks-failures")
    missing = wanted.join(found.select(F.col("_id").alias("document_id")), "document_id", "left_anti")
    wrong = failures.unionByName(missing.withColumn("error", F.lit("document not found")))

    tried = materialize(due.join(wrong, "document_id", "left"), "tasks-tried")
    state = retry_state(tried.where("error IS NOT NULL").withColumn("failed_at", at))
    state = materialize(state.drop("failed_at", "delay_ms"), "tasks-failed")
    # One status per document: failed if a task of it is dead, else processing.
    status = F.when(F.max("dead"), STATUS_FAILED).otherwise(STATUS_PROCESSING)
    unfinished = materialize(state.groupBy("document_id").agg(status.alias("_status")), "tasks-unfinished")
    _save_documents(spark, store, name, found, tables, failures, unfinished)

    finished = [
        tried.where("error IS NULL").select("task_id", "document_id", F.lit("done").alias("state"), "attempts", "error"),
        state.where("dead").select("task_id", "document_id", F.lit("dead").alias("state"), "attempts", "error"),
        new.where("error IS NOT NULL").select("task_id", "document_id", F.lit("quarantined").alias("state"), "attempts", "error"),
    ]
    later = tasks.join(due.select("task_id"), "task_id", "left_anti")
    waiting = later.unionByName(state.where("NOT dead").drop("dead", "error"))
    version = new_version()
    _as(waiting, WAITING).write.parquet(f"{log}/waiting/version={version}")
    done = reduce(DataFrame.unionByName, finished).withColumn("finished_at", at)
    _as(done, OUTCOMES).write.parquet(f"{log}/outcomes/version={version}")

    def repeated(commits: list[Commit]) -> str | None:
        return f"round {name} was committed by another worker" if any(c.kind == "round" and c.name == name for c in commits) else None

    commit(spark, log, Commit("round", name, version), repeated)


def _as(table: DataFrame, schema: str) -> DataFrame:
    fields = T.StructType.fromDDL(schema).fields
    return table.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in fields))


def _save_documents(
    spark: SparkSession, store: str, name: str, found: DataFrame, tables: dict[str, DataFrame], failures: DataFrame, unfinished: DataFrame
) -> None:
    """Commit the analysed documents as ready, the others with their status.

    A document that the store has from an earlier task keeps its content if a later task of it fails; only its status changes.
    """
    bad = failures.select(F.col("document_id").alias("_id"))
    good = {
        n: t.withColumn("_id", F.col("document_id").cast("string")).join(bad, "_id", "left_anti").drop("_id") for n, t in tables.items()
    }
    new = found.join(unfinished.withColumnRenamed("document_id", "_id"), "_id")
    try:
        # What this round committed when it was run before is no earlier content.
        held = load_tables(spark, store, newest=True, without=f"tasks-{name}")["documents"]
        stored = held.select(F.col("document_id").cast("string").alias("_id"))
    except FileNotFoundError:
        stored = None
    if stored is not None:
        changed = materialize(new.join(stored, "_id", "left_semi").select("document_id", F.col("_status").alias("status")), "tasks-statuses")
        new = new.join(stored, "_id", "left_anti")
    unready = new.withColumn("status", F.col("_status")).select(tables["documents"].columns)
    ready = good["documents"].withColumn("status", F.lit(STATUS_READY))
    save_tables(good | {"documents": ready.unionByName(unready)}, store, f"tasks-{name}")
    if stored is not None:
        failed = changed.where(F.col("status") == STATUS_FAILED)
        if not failed.isEmpty():
            save_rows({"statuses": failed}, store, f"tasks-{name}")


def run_due(spark: SparkSession, log: str, store: str, documents: DataFrame, now: datetime, **options: Any) -> None:
    """A round without new tasks, for those whose time has come."""
    run_round(spark, log, store, f"due-{now.isoformat()}", None, documents, now, **options)


def analyze_tasks_stage(
    tasks: DataFrame, log: str, store: str, documents: DataFrame, clock: Callable[[], datetime] = datetime.now, **options: Any
) -> StreamingQuery:
    """A round for each micro-batch of a stream of tasks."""

    def work(batch: DataFrame, batch_id: int) -> None:
        run_round(batch.sparkSession, log, store, f"stream-{batch_id}", batch, documents, clock(), **options)

    return run_to_end(tasks.writeStream.foreachBatch(work), log)
