"""Threshold join of many questions with many vectors that skips what cannot match.

The vectors are laid in cells around pivots, each vector in the cell of its nearest pivot. For every cell the least and
the largest angle to its pivot are known. A question goes only to cells that may hold a match:

* ring: no vector of a cell is nearer to a question than the distance of the question's own angle to the pivot from
  the cell's range of angles (triangle inequality of angles);
* bisector: vectors of another cell lie beyond the plane between its pivot and the pivot nearest to the question.

Both bounds hold for every vector, so the result equals that of all pairs. Cells of usual size are matrix products inside
a task, and a cell with very many rows is cut into blocks on either side (`similarity.similar_pairs`). Vectors without
structure prune little; when the measured share of pairs that are left is above `most_share`, the plain blocks are
cheaper and are used instead, with equal rows.

Null and zero vectors have no similarity and match nothing. A question meets vectors of its own width. Repeated rows of
either side give repeated pairs; an empty side gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioquery.operators.similarity import BLOCK_BYTES, MIN_SIMILARITY, matrix_of, measure_questions, similar_pairs, unit_rows
from folioquery.session import materialize

SAMPLE_BYTES = 32 * 1024 * 1024  # of vectors from which the pivots are chosen
SAMPLE_ROWS = 20_000
PIVOT_BYTES = 16 * 1024 * 1024  # sent to every task
LEAST_CELLS, CELLS_PER_BLOCK = 16, 4
MOST_SHARE = 0.5
SLACK = 1e-6  # covers the rounding of similarities and angles


@dataclass(frozen=True)
class Cells:
    """Pivots (cells x width, of length one) with the least and largest angle and the number of their vectors."""

    pivots: np.ndarray
    inner: np.ndarray
    outer: np.ndarray
    rows: np.ndarray


@dataclass(frozen=True)
class ThresholdJoin:
    """`pairs` as of `similar_pairs`; `reads`: question_id, cells_read, candidates (pairs that are multiplied when the cells are used).

    `pruned` tells for each width whether the cells were used.
    """

    pairs: DataFrame
    reads: DataFrame
    pruned: dict[int, bool]


def _directed(df: DataFrame, width: int) -> DataFrame:
    return df.where((F.size("vector") == width) & F.exists("vector", lambda x: x != 0))


def choose_pivots(vectors: DataFrame, n: int, width: int, id_column: str = "chunk_id") -> np.ndarray:
    """At most n directions from a bounded sample, each the farthest from those before it.

    The sample is the rows of the least hashes, at most SAMPLE_ROWS and SAMPLE_BYTES of them.
    """
    rows = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * width)))
    sample = vectors.orderBy(F.xxhash64(id_column), id_column).limit(rows).select("vector").toArrow()
    units = unit_rows(matrix_of(sample.column("vector"), width))
    if not len(units):
        return units
    chosen, nearest = [0], units @ units[0]
    while len(chosen) < min(n, len(units)):
        farthest = int(nearest.argmin())
        if nearest[farthest] > 1 - SLACK:  # all directions of the sample are pivots
            break
        chosen.append(farthest)
        np.maximum(nearest, units @ units[farthest], out=nearest)
    return units[chosen]


def lay_in_cells(vectors: DataFrame, pivots: np.ndarray) -> tuple[DataFrame, Cells]:
    """vectors with `cell`, written once, and the measures of the cells (a row per cell is collected)."""
    units = unit_rows(pivots)
    schema = T.StructType([*vectors.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("_angle", T.DoubleType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sims = unit_rows(matrix_of(batch.column("vector"), units.shape[1])) @ units.T
            cell = sims.argmax(axis=1)
            angle = np.arccos(np.clip(sims[np.arange(len(sims)), cell], -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angle)], names=schema.names)

    usable = _directed(vectors, units.shape[1])
    # Written, so that the measures hold for the very rows that are joined, whatever is computed again.
    placed = materialize(usable.mapInArrow(assign, schema), "vector-cells")
    inner, outer, rows = np.full(len(units), np.inf), np.full(len(units), -np.inf), np.zeros(len(units), np.int64)
    measures = placed.groupBy("cell").agg(F.min("_angle").alias("a"), F.max("_angle").alias("b"), F.count(F.lit(1)).alias("n"))
    for row in measures.collect():
        inner[row["cell"]], outer[row["cell"]], rows[row["cell"]] = row["a"], row["b"], row["n"]
    return placed.drop("_angle"), Cells(units, inner, outer, rows)


def cells_in_reach(units: np.ndarray, cells: Cells, threshold: float) -> np.ndarray:
    """For each question and cell, whether the cell may hold a vector at least this similar."""
    sims = np.clip(units @ cells.pivots.T, -1, 1)
    angle = np.arccos(sims)
    with np.errstate(invalid="ignore"):
        ring = np.maximum(angle - cells.outer, cells.inner - angle)
    best = sims.argmax(axis=1)
    gaps = np.sqrt(np.maximum(2 - 2 * (cells.pivots @ cells.pivots.T), 0))[best]
    ahead = sims[np.arange(len(sims)), best][:, None] - sims
    beyond = np.arcsin(np.clip(np.divide(ahead, gaps, out=np.zeros_like(ahead), where=gaps > SLACK), 0, 1))
    least = np.maximum(np.maximum(ring, beyond), 0)
    return (cells.rows > 0) & (np.cos(np.minimum(least, np.pi)) >= threshold - SLACK)


def route_questions(questions: DataFrame, cells: Cells, threshold: float) -> DataFrame:
    """questions with `scopes` (the cells to read), `cells_read` and `candidates`."""
    asked = _directed(questions.drop("scopes", "cells_read", "candidates"), cells.pivots.shape[1])
    added = [T.StructField("scopes", T.ArrayType(T.IntegerType())), T.StructField("cells_read", T.IntegerType()), T.StructField("candidates", T.LongType())]
    schema = T.StructType([*asked.schema.fields, *added])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            may = cells_in_reach(unit_rows(matrix_of(batch.column("vector"), cells.pivots.shape[1])), cells, threshold)
            scopes = pa.array([np.flatnonzero(row).astype(np.int32) for row in may], pa.list_(pa.int32()))
            counts = [pa.array(may.sum(axis=1).astype(np.int32)), pa.array((may @ cells.rows).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*batch.columns, scopes, *counts], names=schema.names)

    return asked.mapInArrow(route, schema)


def threshold_join(
    questions: DataFrame,
    vectors: DataFrame,
    *,
    threshold: float = MIN_SIMILARITY,
    carry: tuple[str, ...] = (),
    pivots: np.ndarray | None = None,
    most_share: float = MOST_SHARE,
    block_bytes: int = BLOCK_BYTES,
    **options,
) -> ThresholdJoin:
    """All pairs at or above the threshold: questions(question_id, vector[, top_k]), vectors(chunk_id, vector, *carry).

    The number of cells is a few for each block of vectors, but grows at most with the root of their number, so that the
    lists of cells stay short. The cells share tiles, so that a question that reads many is sent out no oftener than in the plain form. `pivots` overrides the choice, for vectors of that width only.
    """
    questions = questions.drop("scopes")
    size = measure_questions(questions)
    pairs, reads, pruned = None, None, {}
    for width in size.widths:
        asked = _directed(questions, width)
        stored = _directed(vectors.select("chunk_id", *carry, "vector"), width)
        if pivots is not None and pivots.shape[1] == width:
            chosen = pivots
        else:
            n_vectors = vectors.where(F.size("vector") == width).count()
            blocks = -(-n_vectors * 8 * width // block_bytes)
            # A question may read all cells: no more of them than twice the root of the vectors.
            most = min(PIVOT_BYTES // (8 * width), 2 * isqrt(n_vectors))
            wanted = max(LEAST_CELLS, min(CELLS_PER_BLOCK * blocks, most))
            chosen = choose_pivots(stored, wanted, width)
        if not len(chosen):  # no vector has a direction
            continue
        placed, cells = lay_in_cells(stored, chosen)
        routed = materialize(route_questions(asked, cells, threshold), "routed-questions")
        measured = routed.agg(F.sum("candidates").alias("candidates"), F.count(F.lit(1)).alias("n")).first()
        every = measured["n"] * int(cells.rows.sum())
        pruned[width] = (measured["candidates"] or 0) <= most_share * every
        own = {"threshold": threshold, "carry": carry, "block_bytes": block_bytes, **options}
        if pruned[width]:
            found = similar_pairs(routed.drop("cells_read", "candidates"), placed, scope="cell", **own)
        else:
            found = similar_pairs(routed.drop("scopes", "cells_read", "candidates"), placed.drop("cell"), **own)
        read = routed.select("question_id", "cells_read", "candidates")
        pairs = found if pairs is None else pairs.unionByName(found)
        reads = read if reads is None else reads.unionByName(read)
    if pairs is None:
        none = questions.where("false")
        pairs = similar_pairs(none, vectors, threshold=threshold, carry=carry)
        reads = none.select("question_id", F.lit(0).alias("cells_read"), F.lit(0).cast("long").alias("candidates"))
    return ThresholdJoin(pairs, reads, pruned)
