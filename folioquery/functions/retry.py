"""Retry arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
TASK_MAX_ATTEMPTS = 5
TASK_BASE_MS = 1000
# -----------------------------------------------------------------------------


def backoff_ms(attempt: Column, base_ms: int | Column) -> Column:
    """Delay before the next try: the base doubles with each attempt."""
    base = base_ms if isinstance(base_ms, Column) else F.lit(base_ms)
    doubled = F.call_function("shiftleft", F.lit(1).cast("bigint"), attempt.cast("int"))
    return base.cast("bigint") * doubled

