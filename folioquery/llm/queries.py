"""Registered queries of the corpus operators, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from folioquery.llm import quality_rules
from folioquery.llm.alignment import align_documents
from folioquery.llm.bpe import encode_and_decode
from folioquery.llm.common import documents, read
from folioquery.llm.conversation_repair import repair
from folioquery.llm.exact_dedup import exact_duplicates
from folioquery.llm.fingerprints import fingerprints
from folioquery.llm.line_dedup import deduplicate_lines
from folioquery.llm.packing import pack_sequences
from folioquery.llm.quality import judge
from folioquery.llm.sharding import shard_by_bytes
from folioquery.llm.simhash import near_duplicates
from folioquery.llm.token_counts import token_counts
from folioquery.llm.toxicity import score_documents

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    return judge(documents(spark, folder), read(spark, folder, "labels"))


def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(documents(spark, folder), TOKENIZER, PATTERN)


def op3_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shard_by_bytes(documents(spark, folder))


def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(documents(spark, folder))


EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op5_bpe_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    return encode_and_decode(documents(spark, folder), RANKS, PATTERN)


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return score_documents(documents(spark, folder), read(spark, folder, "labels"))


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return deduplicate_lines(documents(spark, folder))


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_sequences(documents(spark, folder), TOKENIZER, RANKS, PATTERN)


def op9_lz_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints(documents(spark, folder))


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(documents(spark, folder))


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair(read(spark, folder, "conversations"))


def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return align_documents(documents(spark, folder), TOKENIZER, RANKS, PATTERN, PIECES)


def op13_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.rate(read(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_token_counts": op2_token_counts,
    "op3_sharding": op3_sharding,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_bpe_roundtrip": op5_bpe_roundtrip,
    "op6_toxicity": op6_toxicity,
    "op7_line_dedup": op7_line_dedup,
    "op8_packing": op8_packing,
    "op9_lz_fingerprints": op9_lz_fingerprints,
    "op10_simhash": op10_simhash,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_alignment": op12_alignment,
    "op13_quality_rules": op13_quality_rules,
}

SQL: dict[str, str] = {"op4_exact_dedup": EXACT_SQL, "op13_quality_rules": quality_rules.oracle_sql()}
