"""Contiguous shards of near-equal bytes by global prefix sums.

Rows are laid in the order of their text's digest, so equal texts lie side by side and stay
together in one shard. The order is cut into partitions by digest; each partition's byte and row
totals are added up before it, sums inside the partition continue from there, and a text goes to
the shard in which the middle of its rows lies, with cuts at equal byte targets. Copies of one text
are numbered by a salt of the doc_id, so that no group is ordered in one task.

A null text has no bytes and, like an empty one, size 1. Repeated rows each get a slot of their own
and share the shard. A text whose copies exceed a shard's target makes that shard larger, since
copies are not parted. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioquery.llm.common import whole_text
from folioquery.session import materialize

SHARDS = 16
PARTITIONS = 4096  # of the order, a power of 16; each holds its share of the distinct texts
SALTS = 1024


def running(total: str, order: list[str], parts: list[str] | None = None) -> F.Column:
    """Sum of `total` over the rows before this one."""
    window = Window.partitionBy(*parts) if parts else Window.partitionBy()
    before = window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(total).over(before), F.lit(0)).cast("long")


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(whole_text()).alias("text_crc32"),
        F.md5(whole_text()).alias("digest"),
        F.pmod(F.coalesce(F.hash("doc_id"), F.lit(0)), F.lit(SALTS)).alias("salt"),
    )
    rows = materialize(rows, "sharding")
    # One row per distinct text and size (null and empty texts differ from no other text in size).
    texts = rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    texts = texts.withColumn("part", F.conv(F.substring("digest", 1, 3), 16, 10).cast("int"))
    totals = texts.groupBy("part").agg(F.sum("bytes").alias("part_bytes"), F.sum("n").alias("part_n"))
    # PARTITIONS rows at most, whatever the input.
    before = totals.select(
        "part",
        running("part_bytes", ["part"]).alias("bytes_before"),
        running("part_n", ["part"]).alias("n_before"),
        F.sum("part_bytes").over(Window.partitionBy()).alias("all_bytes"),
    )
    placed = texts.join(F.broadcast(before), "part").select(
        "digest",
        (F.col("bytes_before") + running("bytes", ["digest"], ["part"])).alias("first_byte"),
        (F.col("n_before") + running("n", ["digest"], ["part"])).alias("first_row"),
        "bytes",
        "all_bytes",
    )
    middle = (F.col("first_byte") + F.col("bytes") / 2) * shards / F.col("all_bytes")
    placed = placed.select("digest", "first_row", F.least(F.floor(middle), F.lit(shards - 1)).cast("int").alias("shard"))
    starts = placed.groupBy("shard").agg(F.min("first_row").alias("shard_row"))  # a row per shard
    placed = placed.join(F.broadcast(starts), "shard").select(
        "digest", "shard", (F.col("first_row") - F.col("shard_row")).alias("text_slot")
    )
    # Copies of a text: salts in order, rows of a salt in order.
    salts = rows.groupBy("digest", "salt").agg(F.count(F.lit(1)).alias("n"))
    salts = salts.select("digest", "salt", running("n", ["salt"], ["digest"]).alias("salt_slot"))
    salts = salts.join(placed, "digest")
    inside = F.row_number().over(Window.partitionBy("digest", "salt").orderBy("doc_id")) - 1
    return (
        rows.withColumn("inside", inside)
        .join(salts, ["digest", "salt"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("text_slot") + F.col("salt_slot") + F.col("inside")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
