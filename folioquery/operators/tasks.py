"""Task tables: decoding, routing, due times and retry state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquery.functions.retry import TASK_BASE_MS, TASK_MAX_ATTEMPTS, backoff_ms


def decode_payloads(tasks: DataFrame, payload: str, schema: str) -> DataFrame:
    """Append `decoded` (a struct) and `malformed`.

    A payload that is no valid JSON, or whose fields have other types, is malformed;
    it is set aside and does not fail the job.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = F.from_json(payload, f"{schema}, _corrupt string", options)
    read = tasks.withColumn("decoded", parsed)
    return read.withColumn(
        "malformed", F.col("decoded").isNull() | F.col("decoded._corrupt").isNotNull()
    ).withColumn("decoded", F.when(~F.col("malformed"), F.col("decoded").dropFields("_corrupt")))


def route_tasks(tasks: DataFrame, types: list[str]) -> dict[str, DataFrame]:
    """One table per task type; tasks of no known type go to `quarantine`."""
    known = F.coalesce(F.col("task_type").isin(types), F.lit(False))
    routed = {name: tasks.where(F.col("task_type") == name) for name in types}
    routed["quarantine"] = tasks.where(~known)
    return routed


def task_route(types: list[str]):
    """The route of each task as a column."""
    task_type = F.coalesce(F.col("task_type"), F.lit(""))
    return F.when(task_type == "", F.lit("task type required")).when(
        task_type.isin(types), F.concat(F.lit("tasks."), task_type)
    ).otherwise(F.lit("unknown task type"))


def due_tasks(tasks: DataFrame, as_of) -> DataFrame:
    """Tasks whose start time has come; a task without one is due."""
    return tasks.where(F.col("not_before").isNull() | (F.col("not_before") <= as_of))


def retry_state(failed: DataFrame, max_attempts: str = "max_attempts") -> DataFrame:
    """State of tasks after one more failure.

    The attempt is counted first; below the limit (0 or absent stands for the
    default) the task is due again after a doubled delay, else it is a dead letter.
    """
    limit = F.coalesce(F.nullif(F.col(max_attempts), F.lit(0)), F.lit(TASK_MAX_ATTEMPTS))
    attempts = (F.coalesce("attempts", F.lit(0)) + 1).cast("int")
    counted = failed.withColumn("attempts", attempts).withColumn("dead", F.col("attempts") >= limit)
    delay = F.when(~F.col("dead"), backoff_ms(F.col("attempts"), TASK_BASE_MS))
    return counted.withColumn("delay_ms", delay).withColumn(
        "not_before", F.when(~F.col("dead"), F.col("failed_at") + F.make_dt_interval(secs=delay / 1000))
    )
