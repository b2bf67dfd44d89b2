"""Validation of uploads and of question requests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
MAX_UPLOAD_BYTES = 10 * 1024 * 1024
TYPE_OF_EXTENSION = {".txt": "text/plain", ".pdf": "application/pdf"}
ALLOWED_TYPES = ["text/plain", "application/pdf"]
TOO_LARGE = "file too large (max %d bytes)"
UNSUPPORTED = "unsupported file type (only PDF and TXT allowed)"
QUESTION_MIN, QUESTION_MAX = 3, 500
TOP_K_DEFAULT, TOP_K_MIN, TOP_K_MAX = 5, 1, 20
UUID4 = "^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
HEX_UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
# Accepted spellings of an id: plain, urn, enclosed by one character, 32 digits.
ID_SPELLINGS = f"^(?:(?:[uU][rR][nN]:[uU][uU][iI][dD]:)?{HEX_UUID}|.{HEX_UUID}.|[0-9a-fA-F]{{32}})$"
# -----------------------------------------------------------------------------


def file_extension(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, "\\.[^./]*$", 0))


def resolved_type(filename: Column, content_type: Column) -> Column:
    """The declared type, else the one the file extension stands for, else NULL."""
    declared = F.nullif(F.coalesce(content_type, F.lit("")), F.lit(""))
    by_extension = F.lit(None).cast("string")
    for extension, media_type in TYPE_OF_EXTENSION.items():
        by_extension = F.when(file_extension(filename) == extension, F.lit(media_type)).otherwise(by_extension)
    return F.coalesce(declared, by_extension)


def upload_error(
    filename: Column, content_type: Column, n_bytes: Column, max_bytes: int = MAX_UPLOAD_BYTES
) -> Column:
    """Reason for a rejection; NULL for an accepted upload."""
    media_type = resolved_type(filename, content_type)
    return F.when(n_bytes > max_bytes, F.lit(TOO_LARGE % max_bytes)).when(
        media_type.isNull() | ~media_type.isin(ALLOWED_TYPES), F.lit(UNSUPPORTED)
    )


def request_errors(question: Column, document_ids: Column, top_k: Column) -> Column:
    """All violations of one request: first failing rule per field, every bad id."""
    length = F.char_length(question)
    question_error = (
        F.when(F.coalesce(question, F.lit("")) == "", F.lit("Question is required"))
        .when(length < QUESTION_MIN, F.lit(f"Question must be at least {QUESTION_MIN}"))
        .when(length > QUESTION_MAX, F.lit(f"Question must be at most {QUESTION_MAX}"))
    )
    ids_error = F.when(document_ids.isNull(), F.lit("DocumentIDs is required")).when(
        F.size(document_ids) < 1, F.lit("DocumentIDs must be at least 1")
    )
    id_errors = F.transform(
        F.coalesce(document_ids, F.array().cast("array<string>")),
        lambda value, i: F.when(
            ~F.coalesce(value.rlike(UUID4), F.lit(False)),
            F.concat(F.lit("DocumentIDs["), i.cast("string"), F.lit("] must be a valid UUID")),
        ),
    )
    top_k_error = F.when(F.coalesce(top_k, F.lit(0)) == 0, F.lit(None).cast("string")).when(
        top_k < TOP_K_MIN, F.lit(f"TopK must be at least {TOP_K_MIN}")
    ).when(top_k > TOP_K_MAX, F.lit(f"TopK must be at most {TOP_K_MAX}"))
    return F.array_compact(F.concat(F.array(question_error, ids_error), id_errors, F.array(top_k_error)))


def effective_top_k(top_k: Column) -> Column:
    return F.when(F.coalesce(top_k, F.lit(0)) == 0, F.lit(TOP_K_DEFAULT)).otherwise(top_k).cast("int")


def parse_document_ids(document_ids: Column) -> Column:
    """Well-formed ids in canonical spelling; malformed ones are dropped."""
    return F.transform(
        F.filter(document_ids, lambda value: value.rlike(ID_SPELLINGS)),
        lambda value: F.regexp_replace(
            F.regexp_replace(
                F.lower(F.when(F.length(value) == 32, value).otherwise(F.regexp_extract(value, HEX_UUID, 0))), "-", ""
            ),
            "^(.{8})(.{4})(.{4})(.{4})(.{12})$",
            "$1-$2-$3-$4-$5",
        ),
    )
