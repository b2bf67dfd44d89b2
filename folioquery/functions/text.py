"""Text expressions. All of them are built-in Spark functions on Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Unicode white space, as a Java regular-expression class.
WHITE_SPACE = "[\\t-\\r \\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
# Control characters removed before embedding (tab, LF and CR stay).
CONTROL_CHARACTERS = "[\\x00-\\x08\\x0B-\\x0C\\x0E-\\x1F\\x7F]"
# Characters that open a bullet line, and those stripped from its start.
BULLET_LINE = "^[-*]"
BULLET_LEAD = "^[-* ]+"
# Sentence delimiters of the extractive summary and answer.
SENTENCE_END = "[.!?\\n]+"
# What lies between the terms that an embedder and an answerer compare.
NO_TERM = "[^\\p{L}\\p{M}\\p{N}]+"
PREVIEW_BYTES = 150
ELLIPSIS = "..."
ENRICHMENT_FORMAT = "Document: %s\n\n%s"
# -----------------------------------------------------------------------------


def words(text: Column) -> Column:
    """White-space separated words; empty or blank text gives an empty array."""
    return F.array_remove(F.split(text, WHITE_SPACE + "+"), "")


def terms_text(text: Column) -> Column:
    """Lower-cased runs of letters, marks and digits, with one blank between them."""
    return F.lower(F.regexp_replace(text, NO_TERM, " "))


def trim_space(text: Column) -> Column:
    """Strip Unicode white space at both ends."""
    return F.regexp_replace(text, f"^{WHITE_SPACE}+|{WHITE_SPACE}+\\z", "")


def clean_text(text: Column) -> Column:
    """Text as it is handed to an embedder: no control characters, single blanks."""
    printable = F.regexp_replace(text, CONTROL_CHARACTERS, "")
    return F.regexp_replace(trim_space(printable), "\\s+", " ")


def preview(text: Column, limit: int = PREVIEW_BYTES) -> Column:
    """At most `limit` bytes, cut at the last blank when there is one after the start.

    A cut inside a multi-byte character shows as the replacement character.
    """
    head = F.make_valid_utf8(F.substring(text.cast("binary"), 1, limit).cast("string"))
    last_blank = F.length(head) - F.length(F.substring_index(head, " ", -1))
    cut = F.when(last_blank > 1, F.left(head, last_blank - 1)).otherwise(head)
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(cut, F.lit(ELLIPSIS)))


def trim_blanks(text: Column) -> Column:
    """Strip ASCII white space at both ends."""
    return F.regexp_replace(text, "^\\s+|\\s+\\z", "")


def sentences(text: Column) -> Column:
    """Array of (pos, sentence): split at sentence ends, blanks stripped, empties dropped.

    `pos` is the index in the raw split, so it is stable when empties are dropped.
    """
    parts = F.transform(
        F.split(text, SENTENCE_END),
        lambda s, i: F.struct(i.alias("pos"), trim_blanks(s).alias("sentence")),
    )
    return F.filter(parts, lambda p: p["sentence"] != "")


def response_lines(response: Column) -> Column:
    """Trimmed, non-blank lines of a model response."""
    return F.filter(F.transform(F.split(response, "\n"), trim_space), lambda line: line != "")


def response_summary(response: Column) -> Column:
    """Lines that are no bullets, joined by a blank."""
    return F.array_join(F.filter(response_lines(response), lambda line: ~line.rlike(BULLET_LINE)), " ")


def response_key_points(response: Column) -> Column:
    """Bullet lines without their leading marks."""
    bullets = F.filter(response_lines(response), lambda line: line.rlike(BULLET_LINE))
    return F.transform(bullets, lambda line: F.regexp_replace(line, BULLET_LEAD, ""))


def enriched_text(filename: Column, text: Column) -> Column:
    """Chunk text prefixed with the name of its document."""
    return F.format_string(ENRICHMENT_FORMAT, filename, text)
