"""Derived identifiers and cache keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
QUERY_KEY_FORMAT = "q:%s|docs:%s|k:%d"
# -----------------------------------------------------------------------------


def chunk_id(document_id: Column, ord_: Column) -> Column:
    """Deterministic chunk identifier, so that a retried job writes the same rows."""
    return F.sha2(F.concat_ws(":", document_id.cast("string"), ord_.cast("string")), 256)


def query_key(question: Column, document_ids: Column, top_k: Column) -> Column:
    """Key of a cached answer: question, ids in byte order (kept with repeats), k."""
    ids = F.array_join(F.array_sort(document_ids), ",")
    return F.sha2(F.format_string(QUERY_KEY_FORMAT, question, ids, top_k.cast("int")), 256)


def embedding_key(text: Column) -> Column:
    return F.sha2(text, 256)
