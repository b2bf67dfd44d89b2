"""Inputs derived from the given tables, and the same derivations as SQL fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.sources.files import read_table

WIDTH = 256
TEXT_THRESHOLD = 0.3

# White space, control characters: the classes of functions/text.py in RE2 spelling.
WS = "[\\t-\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
CONTROL = "[\\x00-\\x08\\x0B-\\x0C\\x0E-\\x1F\\x7F]"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents").select(
        F.col("doc_id").alias("document_id"),
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
        F.col("text").alias("content"),
        F.col("source").alias("collection"),
    )


DOCUMENTS = (
    "d AS (SELECT doc_id AS document_id, concat(source, '/', doc_id, '.txt') AS filename, "
    "text AS content, source AS collection FROM documents)"
)


def uuid_of(number: Column) -> Column:
    """A version-4 shaped id derived from a number."""
    h = F.md5(number.cast("string"))
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)),
        F.concat(F.lit("a"), F.substring(h, 18, 3)), F.substring(h, 21, 12),
    )


def uuid_sql(number: str) -> str:
    h = f"md5(CAST({number} AS VARCHAR))"
    return (
        f"concat(substr({h}, 1, 8), '-', substr({h}, 9, 4), '-4', substr({h}, 14, 3), "
        f"'-a', substr({h}, 18, 3), '-', substr({h}, 21, 12))"
    )


def words_sql(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{WS}+'), lambda x: x <> '')"


def terms_sql(text: str) -> str:
    """Runs of letters, marks and digits, lower-cased; control characters part nothing."""
    return f"regexp_extract_all(lower(regexp_replace({text}, '{CONTROL}', '', 'g')), '[\\p{{L}}\\p{{M}}\\p{{N}}]+')"


def trim_sql(text: str) -> str:
    return f"regexp_replace({text}, '^{WS}+|{WS}+$', '', 'g')"


def clean_sql(text: str) -> str:
    printable = f"regexp_replace({text}, '{CONTROL}', '', 'g')"
    return f"regexp_replace({trim_sql(printable)}, '\\s+', ' ', 'g')"


def chunks_sql(max_words: int = 400, overlap: int = 80, name: str = "c") -> str:
    """CTEs from `d` to chunks (chunk_id, document_id, filename, collection, ord, text, token_count)."""
    # The rule of the windows in SQL of its own.
    size = f"(CASE WHEN {max_words} > 0 THEN {max_words} ELSE 400 END)"
    step = f"(CASE WHEN {size} > greatest({overlap}, 0) THEN {size} - greatest({overlap}, 0) ELSE {size} END)"
    return f"""
{name}_words AS (SELECT document_id, filename, collection, {words_sql('content')} AS ws FROM d),
{name}_cuts AS (
  SELECT *, unnest(range(0, 1 + CAST(ceil(greatest(len(ws) - {size}, 0) / {step}) AS BIGINT))) AS ord
  FROM {name}_words WHERE len(ws) > 0),
{name} AS (
  SELECT sha256(concat(document_id, ':', ord)) AS chunk_id, document_id, filename, collection,
         CAST(ord AS INTEGER) AS ord,
         array_to_string(ws[ord * {step} + 1 : ord * {step} + {size}], ' ') AS text,
         CAST(least({size}, len(ws) - ord * {step}) AS INTEGER) AS token_count
  FROM {name}_cuts)"""


def hashed_sql(source: str, keys: str, text: str, name: str) -> str:
    """CTE of signed feature hashing in long form: (keys, bucket, value)."""
    return f"""
{name}_words AS (SELECT {keys}, unnest({terms_sql(text)}) AS word FROM {source}),
{name} AS (
  SELECT {keys}, CAST(CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) % {WIDTH} AS INTEGER) AS bucket,
         CAST(sum(CASE WHEN substr(md5(word), 9, 1) < '8' THEN 1 ELSE -1 END) AS BIGINT) AS value
  FROM {name}_words GROUP BY ALL HAVING sum(CASE WHEN substr(md5(word), 9, 1) < '8' THEN 1 ELSE -1 END) <> 0)"""


def unit_sql(source: str, key: str, name: str) -> str:
    """CTE of the FLOAT unit vectors of `hashed_sql`, and their exact lengths."""
    return f"""
{name}_len AS (SELECT {key}, sqrt(sum(value * value)) AS len FROM {source} GROUP BY ALL),
{name}_unit AS (
  SELECT {key}, bucket, CAST(CAST(CAST(value AS DOUBLE) / len AS FLOAT) AS DOUBLE) AS x
  FROM {source} JOIN {name}_len USING ({key})),
{name}_norm AS (SELECT {key}, sqrt(sum(x * x)) AS norm FROM {name}_unit GROUP BY ALL)"""


def preview_sql(text: str) -> str:
    """At most 150 bytes, cut at the last blank after the start, else at the byte."""
    fits = f"list_max(list_filter(range(0, 151), lambda n: octet_length(encode(left({text}, n))) <= 150))"
    head = f"left({text}, {fits})"
    blank = f"(length({head}) - length(regexp_extract({head}, '[^ ]*$')))"
    return (
        f"CASE WHEN octet_length(encode({text})) <= 150 THEN {text} "
        f"WHEN {blank} > 1 THEN left({head}, {blank} - 1) || '...' "
        f"ELSE {head} || CASE WHEN octet_length(encode({head})) < 150 THEN chr(65533) ELSE '' END || '...' END"
    )


def sentences_sql(text: str) -> str:
    """List of sentences by split position, blanks stripped (empties kept for their position)."""
    return f"list_transform(string_split_regex({text}, '[.!?\\n]+'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g'))"


def timestamp_text(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def timestamp_sql(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"
