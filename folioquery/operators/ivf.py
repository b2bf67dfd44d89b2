"""Inverted-file search: vectors are kept in lists around k-means centroids."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioquery.operators.similarity import MIN_SIMILARITY, matrix_of, rank_hits, top_k, unit_rows
from folioquery.session import materialize

# --- fixed values -----------------------------------------------------------
DEFAULT_LISTS = 100
# -----------------------------------------------------------------------------
FILES_PER_LIST = 64


@dataclass(frozen=True)
class InvertedFile:
    """Centroids (lists x width, a small array) and the vectors with their list.

    `reach` is the largest angle between a list's centroid and its vectors (-1 for an empty list); it makes
    the exact search possible. `nprobe` is how many lists a search reads unless it is told otherwise.
    """

    centroids: np.ndarray
    vectors: DataFrame
    reach: np.ndarray | None = None
    nprobe: int = 1


def ranked_lists(vectors: np.ndarray, units: np.ndarray, n: int) -> np.ndarray:
    """The n nearest lists of every vector, nearest first, equally near ones by number."""
    sims = unit_rows(vectors) @ units.T
    if n < sims.shape[1]:
        # All lists at least as near as the n-th, in order; ties beyond n fall off at the end.
        limit = -np.partition(-sims, n - 1, axis=1)[:, n - 1 : n]
        sims = np.where(sims >= limit, sims, -np.inf)
    if n == 1:
        return sims.argmax(axis=1)[:, None].astype(np.int32)
    return np.argsort(-sims, axis=1, kind="stable")[:, :n].astype(np.int32)


def _nearest(df: DataFrame, centroids: np.ndarray, n: int, column: str) -> DataFrame:
    """Append the n nearest lists of every row as an array column."""
    units = unit_rows(centroids)
    schema = T.StructType([*df.schema.fields, T.StructField(column, T.ArrayType(T.IntegerType()))])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = ranked_lists(matrix_of(batch.column("vector"), units.shape[1]), units, n)
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * lists.shape[1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(lists.ravel()))], names=schema.names
            )

    return df.mapInArrow(assign, schema)


def list_reach(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Largest angle of the vectors of each list to its centroid, -1 for empty lists; one row per list is collected."""
    units = unit_rows(centroids)

    def widest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.full(len(units), -1.0)
        for batch in batches:
            lists = batch.column("list_id").to_numpy(zero_copy_only=False)
            sims = (unit_rows(matrix_of(batch.column("vector"), units.shape[1])) * units[lists]).sum(axis=1)
            np.maximum.at(found, lists, np.arccos(np.clip(sims, -1, 1)))
        own = np.flatnonzero(found >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(found[own])], ["list_id", "angle"])

    rows = vectors.select("list_id", "vector").mapInArrow(widest, "list_id int, angle double").groupBy("list_id").agg(F.max("angle").alias("angle"))
    out = np.full(len(units), -1.0)
    for row in rows.collect():
        out[row["list_id"]] = row["angle"]
    return out


def build_inverted_file(
    vectors: DataFrame, lists: int = DEFAULT_LISTS, max_iter: int = 10, seed: int = 7, train_fraction: float = 1.0
) -> InvertedFile:
    """Train the centroids and assign every vector to its list.

    `train_fraction` lets a very large table train on a part of its rows; all rows
    are assigned in any case. Zero vectors have no direction and are not indexed.
    """
    usable = vectors.where(F.exists("vector", lambda x: x != 0))
    training = usable if train_fraction >= 1 else usable.sample(train_fraction, seed)
    model = KMeans(
        k=lists, distanceMeasure="cosine", maxIter=max_iter, seed=seed, featuresCol="features"
    ).fit(training.select(array_to_vector("vector").alias("features")))
    return inverted_file_of(usable, np.array(model.clusterCenters()))


def inverted_file_of(vectors: DataFrame, centroids: np.ndarray) -> InvertedFile:
    """Every vector but the zero ones with the `list_id` of its nearest centroid; narrow."""
    usable = vectors.where(F.exists("vector", lambda x: x != 0))
    assigned = _nearest(usable, centroids, 1, "_lists").withColumn("list_id", F.element_at("_lists", 1))
    return InvertedFile(centroids, assigned.drop("_lists"))


def save_inverted_file(index: InvertedFile, path: str) -> None:
    """Write the vectors by list, so that a scan reads only the probed lists.

    A list is spread over several files, whatever its share of the vectors is.
    """
    spark = index.vectors.sparkSession
    placed = index.vectors.repartition("list_id", F.pmod(F.xxhash64("chunk_id"), F.lit(FILES_PER_LIST)))
    placed.write.partitionBy("list_id").mode("overwrite").parquet(f"{path}/vectors")
    rows = [(number, centroid.tolist()) for number, centroid in enumerate(index.centroids)]
    spark.createDataFrame(rows, "list_id int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(
        f"{path}/centroids"
    )


def load_inverted_file(spark: SparkSession, path: str) -> InvertedFile:
    centroids = spark.read.parquet(f"{path}/centroids").orderBy("list_id").collect()
    return InvertedFile(np.array([r["centroid"] for r in centroids]), spark.read.parquet(f"{path}/vectors"))


def top_k_ivf(
    questions: DataFrame, index: InvertedFile, nprobe: int | None = None, within: str | None = None, **options
) -> DataFrame:
    """Top-k among the vectors of the nprobe nearest lists; exact inside these lists.

    Without `nprobe` the number that was measured for the index holds. With `within` (a column such as
    document_id), a question also keeps to the values in its `scopes`.
    """
    probes = min(nprobe or index.nprobe, len(index.centroids))
    probing = _nearest(questions if within else questions.drop("scopes"), index.centroids, probes, "lists")
    if within is None:
        return top_k(probing.withColumnRenamed("lists", "scopes"), index.vectors, scope="list_id", **options)
    vectors = index.vectors
    if probes < len(index.centroids):  # at most as many values as there are lists
        probed = probing.select(F.explode("lists").alias("list_id")).distinct().collect()
        vectors = vectors.where(F.col("list_id").isin([r["list_id"] for r in probed]))
    cell = F.concat_ws("|", F.col("list_id").cast("string"), F.col(within).cast("string"))
    cells = F.flatten(
        F.transform(
            "lists",
            lambda n: F.transform("scopes", lambda v: F.concat_ws("|", n.cast("string"), v.cast("string"))),
        )
    )
    return top_k(probing.withColumn("scopes", cells), vectors.withColumn("cell", cell), scope="cell", **options)


def lists_within_reach(
    questions: DataFrame, index: InvertedFile, floors: DataFrame, first: int, threshold: float
) -> DataFrame:
    """questions with `scopes`: the lists beyond the `first` nearest that may hold a hit, and `lists_read`.

    floors(question_id, floor) has the k-th best similarity found so far. No vector of a list is nearer to a question than
    the angle to its centroid less the list's reach, so lists whose bound is below the floor are left out.
    """
    units, reach, probes = unit_rows(index.centroids), index.reach, min(first, len(index.centroids))
    asked = questions.drop("scopes").join(floors, "question_id", "left").withColumn("floor", F.coalesce("floor", F.lit(threshold)))
    schema = T.StructType(
        [*asked.schema.fields, T.StructField("scopes", T.ArrayType(T.IntegerType())), T.StructField("lists_read", T.IntegerType())]
    )

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = matrix_of(batch.column("vector"), units.shape[1])
            near = ranked_lists(vectors, units, probes)
            angle = np.arccos(np.clip(unit_rows(vectors) @ units.T, -1, 1)) - reach[None, :]
            bound = np.where(reach >= 0, np.cos(np.maximum(angle, 0)), -np.inf)
            floor = batch.column("floor").to_numpy(zero_copy_only=False)
            # Similarities are compared after rounding; the slack covers that and the angles' own rounding.
            may = bound >= floor[:, None] - 1e-6
            np.put_along_axis(may, near, False, axis=1)
            lists = [np.flatnonzero(row).astype(np.int32) for row in may]
            read = pa.array([len(x) + probes for x in lists], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int32())), read], names=schema.names)

    return asked.mapInArrow(choose, schema).drop("floor")


def top_k_ivf_exact(
    questions: DataFrame, index: InvertedFile, k: int = 5, threshold: float = MIN_SIMILARITY, first: int = 1, **options
) -> tuple[DataFrame, DataFrame]:
    """Exact top-k through the lists: (hits, questions with `lists_read`).

    The nearest lists are searched first. Their k-th best similarity of a question, or the threshold where they
    give fewer, bounds what else can be a hit; only lists that reach that far are read in a second step.
    Equal to `top_k` over all vectors but the zero ones, which have no similarity anyway.
    """
    options |= {"threshold": threshold, "k": k}
    found = materialize(top_k_ivf(questions, index, first, **options), "first-lists")
    wanted = F.col("top_k") if "top_k" in questions.columns else F.lit(k)
    ranked = found.join(questions.select("question_id", wanted.alias("top_k")), "question_id")
    floors = ranked.where("rank = top_k").select("question_id", F.col("similarity").alias("floor"))
    rest = materialize(lists_within_reach(questions, index, floors, first, threshold), "lists-within-reach")
    more = top_k(rest.drop("lists_read"), index.vectors, scope="list_id", **options)
    both = found.drop("rank").unionByName(more.drop("rank")).join(
        questions.select("question_id", wanted.cast("int").alias("top_k")), "question_id"
    )
    bound = questions.agg(F.max("top_k")).first()[0] if "top_k" in questions.columns else k
    return rank_hits(both, max(bound or 1, 1)).select(found.columns), rest.select("question_id", "lists_read")


def measured_nprobe(index: InvertedFile, sample_rows: int = 1000, target: float = 0.9, k: int = 5) -> tuple[int, float]:
    """The fewest lists that find the share `target` of the exact k nearest neighbours, and the share they find.

    Measured on at most `sample_rows` stored vectors as questions (those of the least hashes), against all vectors. For each true
    neighbour it counts how near its list is to the question: that is how many lists must be read to find it.
    """
    sample = index.vectors.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample_rows)
    questions = materialize(sample.select(F.col("chunk_id").alias("question_id"), "vector"), "sampled-questions")
    near = top_k(questions, index.vectors.select("chunk_id", "vector", "list_id"), threshold=-1.0, k=k + 1, carry=("list_id",))
    exact = near.where("chunk_id <> question_id")  # itself is no neighbour
    ordered = _nearest(questions, index.centroids, len(index.centroids), "lists").select("question_id", "lists")
    place = F.array_position("lists", F.col("list_id"))
    counts = exact.join(ordered, "question_id").groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n")).collect()
    hits = {r["place"]: r["n"] for r in counts}  # a row per list at most
    total, found = sum(hits.values()), 0
    for n in range(1, len(index.centroids) + 1):
        found += hits.get(n, 0)
        if found >= target * total:
            return n, found / max(total, 1)
    return len(index.centroids), 1.0


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits that were found: (exact_hits, found_hits, recall)."""
    both = exact.select("question_id", "chunk_id").join(
        found.select("question_id", "chunk_id", F.lit(1).alias("found")), ["question_id", "chunk_id"], "left"
    )
    return both.agg(F.count("*").alias("exact_hits"), F.count("found").alias("found_hits")).withColumn(
        "recall", F.when(F.col("exact_hits") > 0, F.col("found_hits") / F.col("exact_hits"))
    )
