"""A stored list index that follows its store.

The index holds a copy of the embeddings by list, a part for each version that the store wrote. It is read by the
store's commits: what is replaced, deleted or changed there is so here, without a rewrite. Writes to the store need
only the new versions to be listed (`extend_index`), each once. A list that has grown too large is split
by its own vectors; only these are assigned anew.
"""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioquery.operators.ivf import DEFAULT_LISTS, FILES_PER_LIST, InvertedFile, build_inverted_file, inverted_file_of, list_reach, measured_nprobe
from folioquery.sources.commits import Commit, commit, new_version, read_commits
from folioquery.sources.store import Layer, embedding_layers, layer_embeddings, load_tables, merged_embeddings

class IndexBehind(RuntimeError):
    """The store was written after the index was extended."""


GROWTH = 4  # a list is split when it has so many times the mean number of vectors


def _parts(commits: list[Commit]) -> tuple[Commit | None, dict[str, dict]]:
    """The centroids in force and, by version of the store, the parts listed under them."""
    centroids, parts = None, {}
    for c in commits:
        if c.kind == "centroids":
            centroids, parts = c, dict(c.facts["parts"])
        elif c.kind == "part" and centroids is not None and c.facts["centroids"] == centroids.number:
            parts[c.name] = c.facts["part"]
    return centroids, parts


def _centroids(spark: SparkSession, index: str, record: Commit) -> np.ndarray:
    rows = spark.read.parquet(f"{index}/centroids/version={record.version}").orderBy("list_id").collect()
    return np.array([r["centroid"] for r in rows])


def _commit_centroids(spark: SparkSession, index: str, centroids: np.ndarray, parts: dict[str, dict], after: Commit | None) -> Commit:
    """Commit centroids with the parts that are listed under them, all at once."""
    version = new_version()
    rows = [(number, centroid.tolist()) for number, centroid in enumerate(centroids)]
    frame = spark.createDataFrame(rows, "list_id int, centroid array<double>")
    frame.coalesce(1).write.parquet(f"{index}/centroids/version={version}")

    def changed(known: list[Commit]) -> str | None:
        current, own = _parts(known)
        if after is not None and (current is None or current.number != after.number or set(own) != set(parts)):
            return "the index changed meanwhile"
        return None

    return commit(spark, index, Commit("centroids", "", version, facts={"lists": len(centroids), "parts": parts}), changed)


def _write_part(listed: DataFrame, index: str, centroids: np.ndarray) -> dict:
    """Write listed vectors by list, so that a scan reads only the probed lists; what readers need to know of them.

    A list is spread over several files, whatever its share of the vectors is.
    """
    version = new_version()
    placed = listed.repartition("list_id", F.pmod(F.xxhash64("chunk_id"), F.lit(FILES_PER_LIST)))
    placed.write.partitionBy("list_id").parquet(f"{index}/vectors/version={version}")
    stored = listed.sparkSession.read.schema(listed.schema).parquet(f"{index}/vectors/version={version}")
    reach = {str(i): float(a) for i, a in enumerate(list_reach(stored, centroids)) if a >= 0}
    return {"version": version, "schema": listed.schema.json(), "reach": reach}


def _rows(spark: SparkSession, index: str, part: dict) -> DataFrame:
    return spark.read.schema(T.StructType.fromJson(json.loads(part["schema"]))).parquet(f"{index}/vectors/version={part['version']}")


def build_index(
    spark: SparkSession, store: str, index: str, lists: int = DEFAULT_LISTS, train_fraction: float = 1.0, target: float = 0.9
) -> None:
    """Train centroids on the vectors of a store, list all of its versions and measure how many lists a search needs."""
    vectors = load_tables(spark, store, newest=True)["embeddings"].select("chunk_id", "document_id", "vector", "model")
    trained = build_inverted_file(vectors, lists, train_fraction=train_fraction).centroids
    _commit_centroids(spark, index.rstrip("/"), trained, {}, None)
    extend_index(spark, store, index, split=False)
    measure_index(spark, store, index, target)


def measure_index(spark: SparkSession, store: str, index: str, target: float = 0.9) -> tuple[int, float]:
    """Commit the number of lists that finds the share `target` of the true neighbours, measured on a sample."""
    nprobe, share = measured_nprobe(load_index(spark, store, index), target=target)
    commit(spark, index.rstrip("/"), Commit("probes", facts={"nprobe": nprobe, "recall": share}))
    return nprobe, share


def extend_index(spark: SparkSession, store: str, index: str, split: bool = True) -> list[str]:
    """List the versions of the store that the index lacks; what is listed already is not read. Returns these versions."""
    root = index.rstrip("/")
    record, parts = _parts(read_commits(spark, root))
    if record is None:
        raise FileNotFoundError(f"no index was built in {root}")
    centroids = None
    new = [x for x in embedding_layers(spark, store) if x.commit.version not in parts]
    for layer in new:
        centroids = _centroids(spark, root, record) if centroids is None else centroids
        listed = inverted_file_of(layer_embeddings(spark, store, layer), centroids).vectors
        listed = listed.select("chunk_id", "document_id", "vector", "model", "_batch", "list_id")
        part = _write_part(listed, root, centroids)
        commit(spark, root, Commit("part", layer.commit.version, facts={"centroids": record.number, "part": part}))
    if new and split:
        split_large_lists(spark, store, index)
    return [x.commit.version for x in new]


def _reader(spark: SparkSession, root: str, parts: dict[str, dict]):
    def read(layers: list[Layer]) -> DataFrame | None:
        found = []
        for layer in layers:
            if "embeddings" not in layer.commit.schemas:
                continue
            if layer.commit.version not in parts:
                raise IndexBehind(f"version {layer.commit.version} of the store is not listed yet")
            rows = _rows(spark, root, parts[layer.commit.version])
            if layer.replaced:
                rows = rows.where(~F.col("_batch").isin(list(layer.replaced)))
            found.append(rows.withColumn("_order", F.lit(layer.order).cast("long")))
        return reduce(DataFrame.unionByName, found) if found else None

    return read


def load_index(spark: SparkSession, store: str, index: str) -> InvertedFile:
    """The index as the store stands now; `IndexBehind` if a version of the store is not listed."""
    root = index.rstrip("/")
    commits = read_commits(spark, root)
    record, parts = _parts(commits)
    if record is None:
        raise FileNotFoundError(f"no index was built in {root}")
    centroids = _centroids(spark, root, record)
    reach = np.full(len(centroids), -1.0)
    for part in parts.values():
        for number, angle in part["reach"].items():
            reach[int(number)] = max(reach[int(number)], angle)
    probes = [c.facts["nprobe"] for c in commits if c.kind == "probes"]
    vectors = merged_embeddings(spark, store, _reader(spark, root, parts))
    return InvertedFile(centroids, vectors, reach, min(probes[-1], len(centroids)) if probes else 1)


def open_index(spark: SparkSession, store: str, index: str, attempts: int = 5) -> InvertedFile:
    """The index after everything that the store has was listed."""
    for _ in range(attempts - 1):
        extend_index(spark, store, index)
        try:
            return load_index(spark, store, index)
        except IndexBehind:
            continue
    extend_index(spark, store, index)
    return load_index(spark, store, index)


def split_large_lists(spark: SparkSession, store: str, index: str, growth: float = GROWTH) -> list[int]:
    """Split the lists that have more than `growth` times the mean number of vectors; their numbers.

    Two-means over the vectors of the list gives two centroids, of which one takes its number and one a new number. Only
    its vectors are assigned anew, between the two. The parts are written again and committed together with the new
    centroids, so readers see the lists before the split or after it.
    """
    root = index.rstrip("/")
    commits = read_commits(spark, root)
    record, parts = _parts(commits)
    held = load_index(spark, store, index)
    sizes = {r["list_id"]: r["count"] for r in held.vectors.groupBy("list_id").count().collect()}  # a row per list
    large = sorted(n for n, size in sizes.items() if size > growth * sum(sizes.values()) / len(held.centroids))
    centroids = held.centroids
    pairs: dict[int, tuple[int, int]] = {}
    for number in large:
        own = held.vectors.where(F.col("list_id") == number)
        model = KMeans(k=2, distanceMeasure="cosine", maxIter=10, seed=7, featuresCol="features").fit(
            own.select(array_to_vector("vector").alias("features"))
        )
        found = np.array(model.clusterCenters())
        if len(found) == 2 and not np.allclose(found[0], found[1]):  # equal vectors cannot be told apart
            pairs[number] = (number, len(centroids))
            centroids = np.vstack([centroids, found[1:]])
            centroids[number] = found[0]
    if not pairs:
        return []
    written = {}
    for name, part in parts.items():
        rows = _rows(spark, root, part)
        moved = rows.where(~F.col("list_id").isin(sorted(pairs)))
        for number, both in pairs.items():
            local = inverted_file_of(rows.where(F.col("list_id") == number).drop("list_id"), centroids[list(both)]).vectors
            local = local.withColumn("list_id", F.when(F.col("list_id") == 0, both[0]).otherwise(both[1]).cast("int"))
            moved = moved.unionByName(local)
        written[name] = _write_part(moved.select(rows.columns), root, centroids)
    _commit_centroids(spark, root, centroids, written, record)
    return sorted(pairs)
