"""Cache folders: entries by hash of their key, and for answers the documents that each key used.

Every addition is one commit (`sources/commits.py`) of entries and of their document links, so the links never miss
an entry. A lookup reads only the buckets of the asked keys, and in them, as files are sorted by key, the pages that may hold
them. Drops are keys with a time; a compaction writes what is still live as one version and ends the history.
"""

from __future__ import annotations

import json
import time
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioquery.operators.maintenance import latest_per_key
from folioquery.schemas import SOURCES
from folioquery.session import materialize
from folioquery.sources.commits import FOLDER, Commit, commit, mark_compaction, names_in, new_version, read_commits, remove_version

BUCKETS = 64
PUSHED_KEYS = 500  # asked keys that become a literal filter on the scan
COMPACT_AFTER = 40  # additions after which a folder is compacted

TIMES = "written_at timestamp, expires_at timestamp"
ANSWERS = f"key string, answer string, confidence double, sources {SOURCES}, document_ids array<string>, {TIMES}"
VECTORS = f"key string, vector array<float>, {TIMES}"


def _bucket(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int")


def _save(table: DataFrame, root: str, name: str, version: str, key: str) -> str:
    placed = table.withColumn("bucket", _bucket(key))
    placed.repartition("bucket").sortWithinPartitions("bucket", key).write.partitionBy("bucket").parquet(f"{root}/{name}/version={version}")
    return placed.schema.json()


def _links(entries: DataFrame) -> DataFrame:
    """(document_id, key): the reverse index of entries(key, document_ids)."""
    return entries.select(F.explode("document_ids").alias("document_id"), "key").distinct()


def _commit_entries(entries: DataFrame, root: str, kind: str, **facts) -> Commit:
    version = new_version()
    schemas = {"entries": _save(entries, root, "entries", version, "key")}
    if "document_ids" in entries.columns:
        schemas["links"] = _save(_links(entries), root, "links", version, "document_id")
    return commit(entries.sparkSession, root, Commit(kind, "", version, schemas, facts))


def add_entries(entries: DataFrame, folder: str, compact_after: int = COMPACT_AFTER) -> None:
    """Add entries(key, ..., written_at, expires_at); after many additions the folder is compacted."""
    spark, root = entries.sparkSession, folder.rstrip("/")
    entries = materialize(entries, "cache-entries")
    if entries.isEmpty():
        return
    _commit_entries(entries, root, "entries")
    if sum(c.kind != "compaction" for c in _live(spark, root)) > compact_after:
        compact_cache(spark, root)


def _live(spark: SparkSession, root: str) -> list[Commit]:
    """The last compaction and what it does not contain."""
    commits = read_commits(spark, root)
    last = max((c for c in commits if c.kind == "compaction"), key=lambda c: c.number, default=None)
    return [c for c in commits if c is last or c.kind != "compaction" and c.number > (last.facts["upto"] if last else 0)]


def _read(spark: SparkSession, root: str, name: str, commits: list[Commit], buckets: list[int] | None = None) -> DataFrame | None:
    found: dict[str, list[str]] = {}
    for c in commits:
        if name in c.schemas:
            found.setdefault(c.schemas[name], []).append(f"{root}/{name}/version={c.version}")
    parts = []
    for schema, paths in found.items():
        fields = [*T.StructType.fromJson(json.loads(schema)).fields, T.StructField("version", T.StringType())]
        rows = spark.read.schema(T.StructType(fields)).option("basePath", f"{root}/{name}").parquet(*paths).drop("version")
        parts.append(rows if buckets is None else rows.where(F.col("bucket").isin(buckets)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None


def _of_keys(spark: SparkSession, root: str, name: str, commits: list[Commit], keys: DataFrame, key: str) -> DataFrame | None:
    """Rows of the given keys: partitions by bucket, pages by key where the keys are few."""
    asked = keys.select(F.col(key), _bucket(key).alias("b"))
    buckets = [r["b"] for r in asked.select("b").distinct().collect()]  # BUCKETS at most
    rows = _read(spark, root, name, commits, buckets)
    if rows is None:
        return None
    few = [r[key] for r in asked.select(key).limit(PUSHED_KEYS + 1).collect()]
    if len(few) <= PUSHED_KEYS:
        return rows.where(F.col(key).isin(few))
    return rows.join(keys.select(key), key, "left_semi")


def _not_dropped(entries: DataFrame, dropped: DataFrame | None) -> DataFrame:
    if dropped is None:
        return entries
    last = dropped.groupBy("key").agg(F.max("dropped_at").alias("dropped_at"))
    kept = entries.join(last, "key", "left").where(F.col("dropped_at").isNull() | (F.col("written_at") > F.col("dropped_at")))
    return kept.drop("dropped_at")


def entries_of(keys: DataFrame, folder: str, schema: str) -> DataFrame:
    """The newest entry of each of keys(key), unless it was dropped; `schema` is that of an empty cache."""
    spark, root = keys.sparkSession, folder.rstrip("/")
    commits = _live(spark, root)
    keys = materialize(keys.select("key").where("key IS NOT NULL").distinct(), "asked-keys")
    entries = _of_keys(spark, root, "entries", commits, keys, "key")
    if entries is None:
        return spark.createDataFrame([], schema)
    entries = _not_dropped(entries.drop("bucket"), _of_keys(spark, root, "dropped", commits, keys, "key"))
    return latest_per_key(entries, ["key"], ["written_at"])


def without_deleted(entries: DataFrame, deleted: DataFrame | None) -> DataFrame:
    """Entries whose documents were not deleted since they were written; deleted(document_id, deleted_at)."""
    if deleted is None:
        return entries
    used = entries.select("key", "written_at", F.explode("document_ids").alias("document_id"))
    gone = used.join(deleted, "document_id").where("deleted_at >= written_at").select("key").distinct()
    return entries.join(gone, "key", "left_anti")


def drop_answers(documents: DataFrame, folder: str) -> int:
    """Drop the answers that used one of documents(document_id), found by the links; the number of their keys."""
    spark, root = documents.sparkSession, folder.rstrip("/")
    now = time.time()
    wanted = documents.select(F.col("document_id").cast("string").alias("document_id")).where("document_id IS NOT NULL").distinct()
    links = _of_keys(spark, root, "links", _live(spark, root), materialize(wanted, "dropped-documents"), "document_id")
    if links is None:
        return 0
    keys = materialize(links.select("key").distinct().withColumn("dropped_at", F.lit(now).cast("timestamp")), "dropped-keys")
    if n := keys.count():
        version = new_version()
        commit(spark, root, Commit("drop", "", version, {"dropped": _save(keys, root, "dropped", version, "key")}))
    return n


def compact_cache(spark: SparkSession, folder: str, now: float | None = None) -> int:
    """Write the live entries as one version: no expired, replaced or dropped ones. Their number.

    Versions of the history before are removed one compaction later, when nobody reads them any more.
    """
    root = folder.rstrip("/")
    commits = _live(spark, root)
    entries = _read(spark, root, "entries", commits)
    if entries is None:
        return 0
    at = F.lit(time.time() if now is None else now).cast("timestamp")
    newest = latest_per_key(_not_dropped(entries.drop("bucket"), _read(spark, root, "dropped", commits)), ["key"], ["written_at"])
    live = materialize(newest.where(F.col("expires_at") > at), "live-entries")
    upto = max(c.number for c in commits)
    done = _commit_entries(live, root, "compaction", upto=upto)
    before = [c for c in commits if c.kind == "compaction"]
    if before:
        old = {c.version for c in read_commits(spark, root) if c.number < before[-1].number}
        for name in ("entries", "links", "dropped"):
            for folder_name in names_in(spark, f"{root}/{name}"):
                if folder_name.removeprefix("version=") in old:
                    remove_version(spark, f"{root}/{name}/{folder_name}")
        mark_compaction(spark, root, before[-1].number)
        for record in names_in(spark, f"{root}/{FOLDER}"):
            if record.endswith(".json") and int(record[:-5]) < before[-1].number:
                remove_version(spark, f"{root}/{FOLDER}/{record}")
    return live.count()

