"""Exact deduplication by composable polynomial fingerprints, confirmed chunk by chunk.

The fingerprint of bytes b0..bn is sum(bi * B**(n-i)) modulo two primes, together with the length.
Chunks are hashed on their own and combine by H(xy) = H(x) * B**len(y) + H(y), which as a
sum over chunks needs no order: a huge text is cut into chunk rows that many tasks hash. Texts
of equal fingerprint are then compared with the row that would stay, chunk row by chunk row; texts
that only share the fingerprint go to another round, so collisions change nothing but the time.

Null counts as the empty text and empty texts are equal. Of equal texts the row with the largest
doc_id stays; rows without doc_id come last, and of rows that also share the doc_id one stays.
An empty table gives no rows. Only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioquery.llm.common import whole_text
from folioquery.session import materialize

BASE = 1_000_003
PRIMES = (2**31 - 1, 2**31 - 19)
CHUNK_BYTES = 1 << 20
HUGE_BYTES = 8 << 20  # longer texts are hashed by several tasks
NO_ID = -(2**63)


def powers(prime: int, size: int) -> np.ndarray:
    """BASE**0 .. BASE**(size-1) modulo the prime, by doubling."""
    table = np.ones(1, np.int64)
    while len(table) < size:
        table = np.concatenate([table, table * pow(BASE, len(table), prime) % prime])
    return table[:size]


def chunk_hashes(chunks: list[bytes], prime: int) -> list[int]:
    """Polynomial hash of each chunk; all chunks of a batch in one pass."""
    sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
    filled = np.flatnonzero(sizes)
    if not len(filled):
        return [0] * len(chunks)
    table = powers(prime, 1 << int(sizes.max()).bit_length())
    data = np.frombuffer(b"".join(chunks), np.uint8)
    ends = np.cumsum(sizes)
    # Products stay below 2**39, so 2**24 of them can be added before the remainder.
    terms = data * table[np.repeat(ends, sizes) - 1 - np.arange(len(data))]
    hashes = np.zeros(len(chunks), np.int64)
    hashes[filled] = np.add.reduceat(terms, (ends - sizes)[filled]) % prime
    return hashes.tolist()


def combine(prime: int, hash_: int, after: int) -> int:
    """The share of a chunk in the hash of its text: `after` bytes follow it."""
    return hash_ * pow(BASE, after, prime) % prime


def chunk_terms(chunks: DataFrame, primes: tuple[int, int], extra: str) -> DataFrame:
    """chunks(chunk BINARY, after long, <extra>) with the two hash shares h1, h2 of each chunk."""
    names = [f.name for f in chunks.schema if f.name not in ("chunk", "after")]

    def hash_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [c or b"" for c in batch.column("chunk").to_pylist()]
            after = batch.column("after").to_pylist()
            shares = [[] for _ in primes]
            start = 0
            while start < len(data):  # bounded memory: a few MB of chunks at a time
                end, held = start, 0
                while end < len(data) and (end == start or held + len(data[end]) <= 4 * CHUNK_BYTES):
                    held += len(data[end])
                    end += 1
                for share, prime in zip(shares, primes, strict=True):
                    hashes = chunk_hashes(data[start:end], prime)
                    share += [combine(prime, h, a) if a else h for h, a in zip(hashes, after[start:end], strict=True)]
                start = end
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [pa.array(s, pa.int64()) for s in shares], [*names, "h1", "h2"]
            )

    return chunks.mapInArrow(hash_batch, f"{extra}, h1 long, h2 long")


def pieces(data: Column, size: Column, chunk: int = CHUNK_BYTES) -> Column:
    """array of (number, bytes) that cover a binary value, at least one."""
    last = F.greatest(F.floor((size - 1) / chunk), F.lit(0)).cast("int")
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(i.alias("number"), F.substring(data, i * chunk + 1, F.lit(chunk)).alias("chunk")),
    )


def fingerprints(docs: DataFrame, primes: tuple[int, int] = PRIMES, huge: int = HUGE_BYTES) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, text_sha256, h1, h2."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(
        "doc_id",
        F.octet_length(whole_text()).cast("long").alias("n_bytes"),
        F.sha2(whole_text(), 256).alias("text_sha256"),
        F.encode(whole_text(), "utf-8").alias("data"),
    )
    columns = f"doc_id {id_type}, n_bytes long, text_sha256 string"
    usual = rows.where(F.col("n_bytes") <= huge).select(
        "doc_id", "n_bytes", "text_sha256", F.lit(0).cast("long").alias("after"), F.col("data").alias("chunk")
    )
    # Each row of a huge text gets a number of its own, so that repeated rows stay apart.
    cut = (
        rows.where(F.col("n_bytes") > huge)
        .withColumn("row", F.monotonically_increasing_id())
        .select("doc_id", "n_bytes", "text_sha256", "row", F.explode(pieces(F.col("data"), F.col("n_bytes"))).alias("p"))
        .select(
            "doc_id",
            "n_bytes",
            "text_sha256",
            "row",
            F.greatest(F.col("n_bytes") - (F.col("p.number") + 1) * CHUNK_BYTES, F.lit(0)).cast("long").alias("after"),
            "p.chunk",
        )
        .repartition(F.col("text_sha256"), F.col("after"))
    )
    whole = chunk_terms(usual, primes, columns)
    joined = (
        chunk_terms(cut, primes, f"{columns}, row long")
        .groupBy("row", "doc_id", "n_bytes", "text_sha256")
        .agg(*((F.sum(h) % p).alias(h) for h, p in zip(("h1", "h2"), primes, strict=True)))
        .drop("row")
    )
    return whole.unionByName(joined)


KEY = ["n_bytes", "h1", "h2"]


def compare_round(docs: DataFrame, rows: DataFrame, chunk: int) -> DataFrame:
    """rows(doc_id, text_sha256, key) with `leader`, the row to stay by key, and `same`: equal to it.

    Only texts that share a fingerprint are cut; they meet their leader as chunk rows, so no task
    holds a group or a whole huge text twice.
    """
    me = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.col("text_sha256").alias("sha"))
    leaders = rows.groupBy(*KEY).agg(F.max(me).alias("leader"))
    members = rows.select(me.alias("me"), *KEY).distinct().join(leaders, KEY)
    texts = docs.select("doc_id", F.sha2(whole_text(), 256).alias("text_sha256"), "text").select(
        me.alias("me"), F.encode(whole_text(), "utf-8").alias("data"), F.octet_length(whole_text()).alias("size")
    )
    found = texts.join(members, "me").dropDuplicates(["me"])
    cut = found.select("me", *KEY, "leader", F.explode(pieces(F.col("data"), F.col("size"), chunk)).alias("p"))
    cut = materialize(cut.select("me", *KEY, "leader", "p.number", "p.chunk"), "exact-dedup-chunks")
    theirs = cut.where(F.col("me") == F.col("leader")).select("leader", *KEY, "number", F.col("chunk").alias("other"))
    compared = cut.join(theirs, ["leader", *KEY, "number"])
    return compared.groupBy("me", *KEY, "leader").agg(F.bool_and(F.col("chunk") == F.col("other")).alias("same")).select(
        F.col("me.id").alias("id"), F.col("me.sha").alias("text_sha256"), *KEY, F.col("leader.id").alias("leader"), "same"
    )


def exact_duplicates(
    docs: DataFrame, primes: tuple[int, int] = PRIMES, huge: int = HUGE_BYTES, chunk: int = CHUNK_BYTES
) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, keep_id, group_size, kept, text_sha256; a row per document."""
    rows = materialize(fingerprints(docs, primes, huge), "exact-dedup")
    sizes = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    alone = rows.join(sizes.where("n = 1"), KEY, "left_semi").select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "text_sha256", *KEY, F.col("doc_id").alias("leader")
    )
    decided = None
    open_ = rows.join(sizes.where("n > 1"), KEY, "left_semi")
    while True:
        # Every round decides the members equal to the leader of their fingerprint, usually all.
        compared = materialize(compare_round(docs, open_, chunk), "exact-dedup-compared")
        equal = compared.where("same").drop("same")
        decided = equal if decided is None else decided.unionByName(equal)
        rest = compared.where("not same")
        if rest.isEmpty():
            break
        open_ = rest.select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), "text_sha256", *KEY)
    decided = decided.unionByName(alone.withColumn("leader", F.coalesce("leader", F.lit(NO_ID))))
    groups = decided.dropDuplicates(["id", "text_sha256", *KEY])
    placed = rows.withColumn("id", F.coalesce("doc_id", F.lit(NO_ID))).join(groups, ["id", "text_sha256", *KEY])
    counts = placed.groupBy(*KEY, "leader", "text_sha256").agg(F.count(F.lit(1)).alias("group_size"))
    # Rows that share id and text are told apart by a number; there are many only if the input repeats rows.
    number = F.row_number().over(Window.partitionBy("id", "text_sha256").orderBy("h1"))
    return (
        placed.withColumn("number", number)
        .join(counts, [*KEY, "leader", "text_sha256"])
        .select(
            "doc_id",
            F.nullif("leader", F.lit(NO_ID)).alias("keep_id"),
            "group_size",
            ((F.col("id") == F.col("leader")) & (F.col("number") == 1)).alias("kept"),
            "text_sha256",
        )
    )


def keep_first_of_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; one row of each id and text."""
    stay = exact_duplicates(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    named = docs.dropDuplicates(["doc_id", "text"])
    return named.join(
        stay, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.sha2(whole_text(), 256) == F.col("_sha")), "left_semi"
    )
