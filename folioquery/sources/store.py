"""The stored tables: documents, chunks, summaries, embeddings.

A store is a sequence of commits (`sources/commits.py`). Each wrote its tables into folders of an own version:

* a batch brings documents with all that belongs to them; a batch of the same name replaces it as a whole;
* rows are later values of single rows: summaries, embeddings, statuses;
* a deletion names documents;
* a compaction holds what the commits before it add up to, in one version.

Tables are merged when they are read, by the number of the commit: a document is what the last batch that
brought it says, unless a later deletion names it; later rows replace rows by their key.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioquery.operators.maintenance import latest_per_key
from folioquery.schemas import STATUSES
from folioquery.session import materialize
from folioquery.sources.commits import (
    FOLDER,
    Commit,
    commit,
    mark_compaction,
    modified_at,
    names_in,
    new_version,
    read_commits,
    remove_version,
)

TABLES = ("documents", "chunks", "summaries", "embeddings")
KEYS = {"summaries": "document_id", "embeddings": "chunk_id"}  # by which later rows replace earlier ones


class WidthMismatch(ValueError):
    """A model is stored with vectors of another width."""


@dataclass(frozen=True)
class Layer:
    """What a commit still contributes: its rows count as of `order`; batches in `replaced` came again later."""

    commit: Commit
    order: int
    replaced: tuple[str, ...] = ()


def live_layers(commits: list[Commit]) -> list[Layer]:
    """Commits that no later one supersedes, by order."""
    start = max((c.number for c in commits if c.kind == "compaction"), default=0)
    layers = []
    for c in commits:
        upto = c.facts.get("upto", 0) if c.number == start else 0
        if c.number == start:
            layers = [x for x in layers if x.order > upto]  # commits that came while it was written
            layers.append(Layer(c, upto))
        elif c.kind != "compaction":
            layers.append(Layer(c, c.number))
    layers.sort(key=lambda x: x.order)
    last = {x.commit.name: x.order for x in layers if x.commit.kind == "batch"}
    out = []
    for x in layers:
        if x.commit.kind == "batch" and last[x.commit.name] > x.order:
            continue
        if x.commit.kind == "compaction":
            x = Layer(x.commit, x.order, tuple(n for n in x.commit.facts.get("batches", ()) if n in last))
        out.append(x)
    return out


def _write(tables: dict[str, DataFrame], root: str, version: str, widths: dict[str, int] | None = None) -> tuple[dict, dict]:
    """Write tables side by side into folders of a version; their schemas, and facts for the commit.

    Files are sorted by document_id, so that a filter on a few documents skips most pages. Vectors of
    another width than registered are counted while they are written.
    """
    wrong = Observation(f"widths-{version}") if widths and "embeddings" in tables else None

    def save(name: str) -> None:
        table = tables[name]
        if "document_id" in table.columns:
            table = table.sortWithinPartitions("document_id")
        if name == "embeddings" and wrong is not None:
            table = table.observe(wrong, F.count(F.when(~has_width(widths), 1)).alias("n"))
        writer = table.write.mode("overwrite")
        if name == "embeddings":
            writer = writer.partitionBy("model")
        writer.parquet(f"{root}/{name}/version={version}")

    with ThreadPoolExecutor(max(len(tables), 1)) as jobs:
        list(jobs.map(save, tables))
    facts = {"violations": wrong.get["n"]} if wrong is not None and wrong.get["n"] else {}
    return {name: table.schema.json() for name, table in tables.items()}, facts


def models(commits: list[Commit]) -> dict[str, int]:
    """Registered models and the width of their vectors."""
    return {c.name: c.facts["width"] for c in commits if c.kind == "model"} | {
        name: width for c in commits if c.kind == "compaction" for name, width in c.facts.get("models", {}).items()
    }


def stored_models(spark: SparkSession, path: str) -> dict[str, int]:
    return models(read_commits(spark, path.rstrip("/")))


def register_model(spark: SparkSession, path: str, model: str, width: int) -> None:
    """Fix the width of a model's vectors; the first registration holds, another width is an error."""

    def other(commits: list[Commit]) -> str | None:
        known = models(commits).get(model, width)
        return None if known == width else f"vectors of {model} are {known} wide, not {width}"

    root = path.rstrip("/")
    known = read_commits(spark, root)
    if reason := other(known):
        raise WidthMismatch(reason)
    if model not in models(known):
        commit(spark, root, Commit("model", model, facts={"width": width}), other)


def has_width(widths: dict[str, int]) -> Column:
    """Whether a vector is as wide as its model is registered; any width for other models."""
    # A short list: one entry per model.
    wanted = reduce(lambda rest, m: F.when(F.col("model") == m, widths[m]).otherwise(rest), widths, F.size("vector"))
    return F.coalesce(F.size("vector") == wanted, F.lit(False))


def save_tables(tables: dict[str, DataFrame], path: str, batch: str) -> Commit:
    """Commit a batch of documents, all tables or none; a batch of the same name is replaced.

    A job that ends before its commit leaves the store as it was, whatever it wrote until then. Vectors
    that do not have the registered width of their model are not read back; `violations` reports them.
    """
    if "documents" not in tables:
        raise ValueError("a batch needs its documents")
    spark, root, version = tables["documents"].sparkSession, path.rstrip("/"), new_version()
    schemas, facts = _write(tables, root, version, stored_models(spark, root))
    return commit(spark, root, Commit("batch", batch, version, schemas, facts))


def save_rows(tables: dict[str, DataFrame], path: str, name: str = "") -> Commit:
    """Commit later values of single rows: `summaries` by document_id, `embeddings` by chunk_id (with their
    document_id), `statuses`(document_id, status). They hold until a later batch brings the document again."""
    if unknown := set(tables) - {"summaries", "embeddings", "statuses"}:
        raise ValueError(f"no rows of {sorted(unknown)} can be replaced")
    spark, root, version = next(iter(tables.values())).sparkSession, path.rstrip("/"), new_version()
    schemas, facts = _write(tables, root, version, stored_models(spark, root))
    return commit(spark, root, Commit("rows", name, version, schemas, facts))


def update_statuses(updates: DataFrame, path: str, order: list[str]) -> DataFrame:
    """Commit the last status given to each document in updates(document_id, status, <order>).

    Returns what could not be applied, with `error`: unknown documents and unknown statuses.
    """
    held = load_tables(updates.sparkSession, path, newest=True)["documents"].select("document_id", F.lit(True).alias("_held"))
    valid = F.coalesce(F.col("status").isin(STATUSES), F.lit(False))
    error = F.when(~valid, F.lit("unknown status")).when(F.col("_held").isNull(), F.lit("document not found"))
    checked = materialize(updates.join(held, "document_id", "left").withColumn("error", error).drop("_held"), "status-updates")
    good = checked.where("error IS NULL").select("document_id", *order, "status")
    save_rows({"statuses": latest_per_key(good, ["document_id"], order).select("document_id", "status")}, path)
    return checked.where("error IS NOT NULL")


def delete_documents(documents: DataFrame, path: str) -> Commit:
    """Delete documents(document_id) with their chunks, summaries and embeddings.

    The deletion is a small table that readers apply to what earlier commits brought; no stored file is
    rewritten. A document that a later batch brings again is there again.
    """
    spark, root, version = documents.sparkSession, path.rstrip("/"), new_version()
    now = time.time()
    gone = documents.select("document_id").distinct().withColumn("deleted_at", F.lit(now).cast("timestamp"))
    schemas, _ = _write({"deleted": gone}, root, version)
    return commit(spark, root, Commit("deletion", "", version, schemas, at=now))


def _read(spark: SparkSession, root: str, table: str, layers: list[Layer]) -> DataFrame | None:
    """The rows of a table in the given layers, with `_order` and `_batch`; None if no layer has the table."""
    found: dict[str, list[Layer]] = {}
    for layer in layers:
        if table in layer.commit.schemas:
            found.setdefault(layer.commit.schemas[table], []).append(layer)
    parts = []
    for schema, own in found.items():
        fields = [*T.StructType.fromJson(json.loads(schema)).fields, T.StructField("version", T.StringType())]
        paths = [f"{root}/{table}/version={x.commit.version}" for x in own]
        rows = spark.read.schema(T.StructType(fields)).option("basePath", f"{root}/{table}").parquet(*paths)
        # As many entries as there are commits since the last compaction.
        order = F.create_map(*(F.lit(v) for x in own for v in (x.commit.version, x.order)))
        batch = F.create_map(*(F.lit(v) for x in own for v in (x.commit.version, x.commit.name)))
        if "_batch" in rows.columns:
            gone = sorted({n for x in own for n in x.replaced})
            rows = rows.where(~F.col("_batch").isin(gone)) if gone else rows
        else:
            rows = rows.withColumn("_batch", F.element_at(batch, F.col("version")))
        if table == "embeddings" and any(x.commit.facts.get("violations") for x in own):
            rows = rows.where(has_width(stored_models(spark, root)))
        parts.append(rows.withColumn("_order", F.element_at(order, F.col("version")).cast("long")).drop("version"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None


def deletions(spark: SparkSession, path: str) -> DataFrame | None:
    """(document_id, deleted_at) of all deletions, a row for each; None without any."""
    root = path.rstrip("/")
    own = [x for x in live_layers(read_commits(spark, root)) if x.commit.kind in ("deletion", "compaction")]
    gone = _read(spark, root, "deleted", own)
    return None if gone is None else gone.select("document_id", "deleted_at")


def deleted_documents(spark: SparkSession, path: str) -> DataFrame | None:
    """(document_id) of the deleted documents that no batch holds; None if nothing was deleted."""
    if (gone := deletions(spark, path)) is None:
        return None
    held = load_tables(spark, path)["documents"].select("document_id")
    return gone.select("document_id").distinct().join(held, "document_id", "left_anti")


def load_tables(spark: SparkSession, path: str, newest: bool = False, without: str | None = None) -> dict[str, DataFrame]:
    """Read a snapshot of the store: the commits there are now.

    With `newest` every document is read from the last batch that brought it, and later rows replace
    rows; without it all batches are read as they were written. Deleted documents are left out of every
    table in both cases. Where no document was deleted, brought twice or changed, nothing is joined.
    The batch named by `without` counts as not committed.
    """
    layers = live_layers(read_commits(spark, path.rstrip("/")))
    if without is not None:
        layers = [x for x in layers if (x.commit.kind, x.commit.name) != ("batch", without)]
        layers = [replace(x, replaced=(*x.replaced, without)) if x.commit.kind == "compaction" else x for x in layers]
    return _load(spark, path.rstrip("/"), layers, newest)


Reader = Callable[[list[Layer]], DataFrame | None]


def merged_embeddings(spark: SparkSession, path: str, read: Reader) -> DataFrame:
    """The embeddings that hold now, from a copy that `read` gives for layers (with `_order` and `_batch`)."""
    root = path.rstrip("/")
    layers = live_layers(read_commits(spark, root))
    return _load(spark, root, layers, True, names=("documents", "embeddings"), copies={"embeddings": read})["embeddings"]


def embedding_layers(spark: SparkSession, path: str) -> list[Layer]:
    """The layers that brought embeddings."""
    return [x for x in live_layers(read_commits(spark, path.rstrip("/"))) if "embeddings" in x.commit.schemas]


def layer_embeddings(spark: SparkSession, path: str, layer: Layer) -> DataFrame:
    """The embeddings of one layer as they were written, with `_batch`."""
    return _read(spark, path.rstrip("/"), "embeddings", [replace(layer, replaced=())]).drop("_order")


def _load(
    spark: SparkSession, root: str, layers: list[Layer], newest: bool, keep: tuple[str, ...] = (), names: tuple[str, ...] = TABLES,
    copies: dict[str, Reader] | None = None,
) -> dict[str, DataFrame]:
    base = [x for x in layers if x.commit.kind in ("batch", "compaction")]
    if not base:
        raise FileNotFoundError(f"no batch was committed in {root}")
    reader = {name: (lambda own, name=name: _read(spark, root, name, own)) for name in (*names, "statuses")} | (copies or {})
    tables = {name: reader[name](base) for name in names}
    missing = [n for n, t in tables.items() if t is None]
    documents = tables["documents"]
    stale = []
    deleting = [x for x in layers if x.commit.kind == "deletion"]
    gone = _read(spark, root, "deleted", deleting)
    if gone is not None:
        last = gone.groupBy("document_id").agg(F.max("_order").alias("_deleted"))
        stale.append(documents.join(last, "document_id").where("_order < _deleted").select("document_id", "_order"))
    if newest and len(base) > 1:
        held = documents.groupBy("document_id").agg(F.max("_order").alias("_last"), F.count(F.lit(1)).alias("n")).where("n > 1")
        stale.append(documents.join(held, "document_id").where("_order < _last").select("document_id", "_order"))
    if stale:
        old = materialize(reduce(DataFrame.union, stale).distinct(), "store-stale")
        if not old.isEmpty():
            tables = {n: t if t is None else t.join(old, ["document_id", "_order"], "left_anti") for n, t in tables.items()}
    changing = [x for x in layers if x.commit.kind == "rows"]
    if newest and changing:
        tables |= _with_rows(tables, changing, reader)
    return {n: t.drop(*({"_order", "_batch"} - {*keep})) for n, t in tables.items() if n not in missing}


def _with_rows(tables: dict[str, DataFrame], changing: list[Layer], reader: dict[str, Reader]) -> dict[str, DataFrame]:
    """Tables in which later rows have replaced rows of documents that were brought before them."""
    documents = tables["documents"]
    out = {}
    since = documents.select("document_id", F.col("_order").alias("_since"), F.col("_batch").alias("_own"))

    def last(name: str, key: str) -> DataFrame | None:
        own = [x for x in changing if name in x.commit.schemas]
        if not own or name not in (*tables, "statuses"):
            return None
        rows = reader[name](own)
        fresh = rows.drop("_batch").join(since, "document_id").where("_order > _since").withColumnRenamed("_own", "_batch")
        return materialize(latest_per_key(fresh.drop("_since"), [key], ["_order"]), f"store-{name}")

    for name, key in KEYS.items():
        if (rows := last(name, key)) is not None:
            kept = tables[name].join(rows.select(key), key, "left_anti")
            out[name] = kept.unionByName(rows, allowMissingColumns=True)
    if (rows := last("statuses", "document_id")) is not None:
        new = rows.select("document_id", F.col("status").alias("_status"))
        status = F.coalesce("_status", "status").alias("status")
        merged = documents.join(new, "document_id", "left")
        out["documents"] = merged.select(*(status if c == "status" else F.col(c) for c in documents.columns))
    return out


def compact(spark: SparkSession, path: str) -> Commit | None:
    """Write what all commits add up to as one version. Commits that come meanwhile stay on top of it.

    Of two compactions at a time the second one gives up (`CommitConflict`). None where there is nothing to do.
    """
    root = path.rstrip("/")
    commits = read_commits(spark, root)
    layers = live_layers(commits)
    upto = max((c.number for c in commits), default=0)
    if sum(x.commit.kind != "model" for x in layers) < 2:
        return None
    version = new_version()
    merged = _load(spark, root, layers, True, keep=("_batch",))
    # Deletions are kept for caches, and the report of vectors of a wrong width.
    rest = {"deleted": deletions(spark, root), "violations": violations(spark, root)}
    schemas, _ = _write(merged | {n: t for n, t in rest.items() if t is not None}, root, version)
    batches = {x.commit.name for x in layers if x.commit.kind == "batch"}
    for x in layers:
        batches |= {*x.commit.facts.get("batches", ())}
    facts = {"upto": upto, "batches": sorted(batches), "models": models(commits)}

    def other(known: list[Commit]) -> str | None:
        later = [c.number for c in known if c.kind == "compaction" and c.number > upto]
        return f"compaction {later[-1]} came first" if later else None

    return commit(spark, root, Commit("compaction", "", version, schemas, facts), other)


def remove_superseded(spark: SparkSession, path: str, older_than_seconds: float) -> list[str]:
    """Remove versions that no commit needs any more, if they are that old: readers that began before are done.

    Versions without a commit, left by jobs that failed, are removed as well. Returns what was removed.
    """
    root = path.rstrip("/")
    commits = read_commits(spark, root)
    needed = {x.commit.version for x in live_layers(commits)}
    limit = time.time() - older_than_seconds
    removed = []
    for table in (*TABLES, "statuses", "deleted", "violations"):
        for name in names_in(spark, f"{root}/{table}"):
            folder = f"{root}/{table}/{name}"
            if name.startswith("version=") and name[8:] not in needed and modified_at(spark, folder) < limit:
                remove_version(spark, folder)
                removed.append(f"{table}/{name}")
    compactions = [c for c in commits if c.kind == "compaction"]
    if compactions and compactions[-1].at < limit:
        last = compactions[-1]
        between = any(x.order < last.number for x in live_layers(commits) if x.commit is not last)
        if not between:  # else commits made while it was written are still read from their records
            mark_compaction(spark, root, last.number)
            for name in names_in(spark, f"{root}/{FOLDER}"):
                if name.endswith(".json") and int(name[:-5]) < last.number:
                    remove_version(spark, f"{root}/{FOLDER}/{name}")
    return removed


def violations(spark: SparkSession, path: str) -> DataFrame | None:
    """(chunk_id, document_id, model, width) of stored vectors of another width than registered; None without any."""
    root = path.rstrip("/")
    commits = read_commits(spark, root)
    layers = live_layers(commits)
    parts = []
    for x in layers:
        if x.commit.facts.get("violations"):
            plain = replace(x, commit=replace(x.commit, facts={}))
            wrong = _read(spark, root, "embeddings", [plain]).where(~has_width(models(commits)))
            parts.append(wrong.select("chunk_id", "document_id", "model", F.size("vector").alias("width")))
    older = _read(spark, root, "violations", [x for x in layers if x.commit.kind == "compaction"])
    if older is not None:
        parts.append(older.select("chunk_id", "document_id", "model", "width"))
    return reduce(DataFrame.unionByName, parts) if parts else None


def save_json(df: DataFrame, path: str) -> None:
    """Results as JSON lines."""
    df.write.mode("overwrite").json(path)
