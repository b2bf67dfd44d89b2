"""Exact cosine search of many questions over many vectors.

Both sides meet in blocks that are multiplied as matrices inside a task. A block
gives back at most k pairs per question (or the pairs above the threshold), so the
pairs themselves are never laid out as rows. Two placements of the same work:

* few questions (their measured size is below a bound): the questions are sent to
  every task and the vectors are only scanned, not moved;
* many questions: questions and vectors are laid in tiles, each a block of either side.
  The vectors of small scopes (document, list) share a block, a scope that holds a large
  share of them is cut into several. Blocks grow with the number of pairs up to a bound,
  so that a row is copied to few tiles; a task streams the vectors past its questions.

Products are taken in single precision, and pairs within its error of what counts are
computed again in double precision, so the result is that of double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import partial
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window


# --- fixed values -----------------------------------------------------------
MIN_SIMILARITY = 0.7
# -----------------------------------------------------------------------------
SCORE_DIGITS = 9  # similarities are compared after rounding, so that ties are ties
BROADCAST_BYTES = 64 * 1024 * 1024
BLOCK_BYTES = 64 * 1024 * 1024
TILE_BYTES = 64 * 1024 * 1024  # of the doubles of one side of a tile
TILE_ROWS = 1024  # smaller tiles only where `block_bytes` allows less
TILES_PER_CORE = 4
TILE_PARTITIONS = 10_000  # more tiles than these share partitions
UNCOUNTED_BYTES = 4 * 1024 * 1024  # questions of this size are sent without counting the vectors
SENT_PAIRS = 250_000_000  # products for each core, up to which the questions are sent
KEPT_PAIRS = 1_000_000  # best pairs that one task holds between cuts
QUESTIONS_PER_PRODUCT, VECTORS_PER_PRODUCT = 512, 1024  # a product stays in a core's cache
EXACT_PAIRS = 16_384  # computed again at a time
COLLECTED_SCOPES = 50_000  # scope entries of all questions that are looked through for a literal filter
PUSHED_SCOPES = 500  # distinct scopes that become a literal filter on the scan


@dataclass(frozen=True)
class QuestionSize:
    """Measured size of the question side."""

    rows: int
    width: int  # the widest
    scopes: int
    widths: tuple[int, ...] = ()  # all that occur
    top_k: int = 0  # the largest that a question brings

    @property
    def n_bytes(self) -> int:
        return self.rows * (self.width * 8 + 64) + self.scopes * 32


def measure_questions(questions: DataFrame) -> QuestionSize:
    scopes = F.sum(F.size("scopes")) if "scopes" in questions.columns else F.lit(0)
    largest = F.max("top_k") if "top_k" in questions.columns else F.lit(0)
    row = questions.agg(
        F.count("*").alias("n"), F.collect_set(F.size("vector")).alias("widths"), scopes.alias("scopes"),
        largest.alias("top_k"),
    ).first()
    widths = tuple(sorted(w for w in row["widths"] if w > 0))
    return QuestionSize(row["n"], max(widths, default=0), row["scopes"] or 0, widths, row["top_k"] or 0)


def matrix_of(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    lengths = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, lengths, out=np.full_like(matrix, np.nan), where=lengths > 0)


def candidates(
    questions: np.ndarray, vectors: np.ndarray, near: tuple[np.ndarray, np.ndarray], floor: np.ndarray, k: int | None, id_rank
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, column numbers and similarities of the pairs worth keeping.

    Keeps similarities >= the floor of their question; `near` are both sides in single
    precision. With k, a product with many such pairs is cut to the k best per question,
    where equal similarities are ordered by id. Zero vectors have no similarity and never match.
    """
    error = (questions.shape[1] + 8) * 2.0**-22  # of a single product of unit vectors, and of the floors
    sims = near[0] @ near[1].T
    keep = sims >= (floor - error).astype(np.float32)[:, None]
    n = sims.shape[1]
    many = k is not None and n > k and np.count_nonzero(keep) > 4 * k * len(questions)
    if many:
        sims[np.isnan(sims)] = -np.inf
        keep &= sims >= (np.partition(sims, n - k, axis=1)[:, n - k] - np.float32(2 * error))[:, None]
    rows, cols = np.divmod(_true_places(keep), n)
    if len(rows) * 16 > keep.size:
        exact = (questions @ vectors.T)[rows, cols]
    else:
        exact = np.empty(len(rows))
        for at in range(0, len(rows), EXACT_PAIRS):
            part = slice(at, at + EXACT_PAIRS)
            exact[part] = np.einsum("ij,ij->i", questions[rows[part]], vectors[cols[part]])
    values = np.round(exact, SCORE_DIGITS)
    right = values >= floor[rows]
    rows, cols, values = rows[right], cols[right], values[right]
    if many:
        best = _k_best(rows, values, id_rank()[cols], k)
        rows, cols, values = rows[best], cols[best], values[best]
    return rows, cols, values


def _true_places(keep: np.ndarray) -> np.ndarray:
    """np.flatnonzero, looking at eight values at once where few are true."""
    flat = np.ascontiguousarray(keep).ravel()
    whole = len(flat) // 8 * 8
    words = np.flatnonzero(flat[:whole].view(np.uint64) != 0)
    if len(words) * 32 > whole:
        return np.flatnonzero(flat)
    near = (words[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([near[flat[near]], whole + np.flatnonzero(flat[whole:])])


def _k_best(rows: np.ndarray, values: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best values per row, ordered by row, value and id."""
    order = np.lexsort((ids, -values, rows))
    ordered = rows[order]
    return order[np.arange(len(order)) - np.searchsorted(ordered, ordered, side="left") < k]


def _id_rank(ids: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.asarray(pc.rank(ids, sort_keys="ascending", tiebreaker="first"))


class _Search:
    """One task's search: multiplies batches of vectors with the questions.

    With k, the best pairs are kept across the batches of the task, and the k-th best
    similarity found so far becomes the floor of its question, so that later batches
    give few new candidates. The task holds at most a few times k pairs per question.
    """

    def __init__(self, questions: pa.Table, cells: str | None, width: int, k: int | None, threshold: float,
                 schema: pa.Schema):
        self.ids = questions.column("question_id").combine_chunks()
        self.top_k = questions.column("top_k").combine_chunks()
        self.units = unit_rows(matrix_of(questions.column("vector"), width))
        self.near = self.units.astype(np.float32)
        self.cells = _rows_by_cell(questions.column(cells)) if cells else None
        self.width, self.k, self.schema = width, k, schema
        self.floor = np.full(len(self.units), threshold)
        self.kept: list[pa.Table] = []
        self.n_kept = 0
        self.n_room = max(200_000, 2 * (k or 0) * len(self.units))

    def add(self, batch: pa.RecordBatch, cell: str | None) -> Iterator[pa.RecordBatch]:
        vectors = unit_rows(matrix_of(batch.column("vector"), self.width))
        near = vectors.astype(np.float32)
        ranks: list[np.ndarray] = []  # of the ids of this batch, once they are needed

        def id_rank() -> np.ndarray:
            if not ranks:
                ranks.append(_id_rank(batch.column("chunk_id")))
            return ranks[0]

        payload = batch.select([name for name in self.schema.names if name in batch.schema.names])
        for question_rows, all_rows in self._meetings(batch, cell):
            for vector_rows in _cut_up(all_rows, VECTORS_PER_PRODUCT):
                own, own_near = vectors[vector_rows], near[vector_rows]
                # Few vectors meet more questions at once, so that products are of similar size.
                step = QUESTIONS_PER_PRODUCT * max(1, VECTORS_PER_PRODUCT // len(vector_rows))
                for part in _cut_up(question_rows, step):
                    # Neighbouring rows are read in place.
                    at = slice(part[0], part[-1] + 1) if part[-1] - part[0] == len(part) - 1 else part
                    rows, cols, values = candidates(
                        self.units[at], own, (self.near[at], own_near), self.floor[at], self.k,
                        lambda: id_rank()[vector_rows],
                    )
                    if not len(rows):
                        continue
                    found = pa.Table.from_batches([payload.take(pa.array(vector_rows[cols]))])
                    found = found.append_column("row", pa.array(part[rows])).append_column("similarity", pa.array(values))
                    if self.k is None:
                        yield from self._output(found)
                    else:
                        self.kept.append(found)
                        self.n_kept += len(rows)
                        if self.n_kept > self.n_room:
                            self._cut()

    def finish(self) -> Iterator[pa.RecordBatch]:
        if self.kept:
            self._cut()
            yield from self._output(self.kept[0])

    def _meetings(self, batch, cell) -> list[tuple[np.ndarray, np.ndarray]]:
        """Question rows and vector rows that share a cell."""
        if self.cells is None:
            return [(np.arange(len(self.units)), np.arange(batch.num_rows))]
        encoded = batch.column(cell).dictionary_encode()
        codes = encoded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        bounds = np.searchsorted(codes[order], np.arange(len(encoded.dictionary) + 1))
        return [
            (self.cells[value], order[bounds[i] : bounds[i + 1]])
            for i, value in enumerate(encoded.dictionary.to_pylist())
            if value in self.cells
        ]

    def _cut(self) -> None:
        """Keep the k best pairs per question and raise the floors."""
        table = pa.concat_tables(self.kept).combine_chunks()
        rows = table.column("row").to_numpy()
        values = table.column("similarity").to_numpy()
        best = _k_best(rows, values, _id_rank(table.column("chunk_id")), self.k)
        rows, values = rows[best], values[best]
        last = np.flatnonzero(np.r_[rows[1:] != rows[:-1], True])
        full = last[np.bincount(rows, minlength=len(self.floor))[rows[last]] >= self.k]
        self.floor[rows[full]] = values[full]
        self.kept, self.n_kept = [table.take(pa.array(best))], len(best)

    def _output(self, found: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = found.column("row")
        columns = {"question_id": self.ids.take(rows), "top_k": self.top_k.take(rows)}
        arrays = [columns[n] if n in columns else found.column(n) for n in self.schema.names]
        yield from pa.Table.from_arrays(arrays, names=self.schema.names).cast(self.schema).to_batches()


def _cut_up(rows: np.ndarray, size: int) -> Iterator[np.ndarray]:
    for start in range(0, len(rows), size):
        yield rows[start : start + size]


def _rows_by_cell(cells: pa.ChunkedArray) -> dict:
    """The rows whose lists (without repeats) hold a value, by value."""
    lists = cells.combine_chunks()
    encoded = pc.list_flatten(lists).dictionary_encode()
    codes = pc.fill_null(encoded.indices, -1).to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)[order].astype(np.int32)
    bounds = np.searchsorted(codes[order], np.arange(len(encoded.dictionary) + 1))
    return {value: rows[bounds[i] : bounds[i + 1]] for i, value in enumerate(encoded.dictionary.to_pylist())}


def similar_pairs(
    questions: DataFrame,
    vectors: DataFrame,
    *,
    threshold: float = MIN_SIMILARITY,
    k: int | None = None,
    scope: str | None = None,
    carry: tuple[str, ...] = (),
    size: QuestionSize | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Pairs (question_id, top_k, chunk_id, *carry, similarity) at or above the threshold.

    questions(question_id, vector[, top_k][, scopes ARRAY]); vectors(chunk_id, vector, *carry[, scope]).
    With `scope`, a question meets only vectors whose scope value is in its `scopes`;
    an empty list meets none. With `k`, a task drops pairs that cannot be among the k
    best of a question; `rank_hits` ranks what the tasks give back. Vectors of different
    width have no similarity: a question meets the stored vectors of its own width,
    whatever else is in the batch; `width_mismatches` reports those that meet none.

    Questions above `broadcast_bytes`, or with more products than the tasks of one scan should do,
    are laid in tiles with the vectors. `block_bytes` lets a tile be smaller than TILE_ROWS.
    """
    size = size or measure_questions(questions)
    if len(size.widths) > 1:
        options = {"threshold": threshold, "k": k, "scope": scope, "carry": carry,
                   "broadcast_bytes": broadcast_bytes, "block_bytes": block_bytes}
        found = None
        for width in size.widths:
            part = similar_pairs(
                questions.where(F.size("vector") == width), vectors, size=replace(size, width=width, widths=(width,)), **options
            )
            found = part if found is None else found.unionByName(part)
        return found
    top_k = F.col("top_k") if "top_k" in questions.columns else F.lit(k)
    wanted = questions.select(
        "question_id", top_k.cast("int").alias("top_k"), "vector", *([F.array_distinct("scopes").alias("scopes")] if scope else [])
    ).where(F.size("vector") == size.width)
    stored = vectors.select(
        "chunk_id", *carry, "vector", *([F.col(scope).alias("scope")] if scope else [])
    ).where(F.size("vector") == size.width)
    schema = T.StructType(
        [
            T.StructField("question_id", questions.schema["question_id"].dataType),
            T.StructField("top_k", T.IntegerType()),
            *[T.StructField(c, vectors.schema[c].dataType) for c in ("chunk_id", *carry)],
            T.StructField("similarity", T.DoubleType()),
        ]
    )
    if size.rows == 0 or size.width == 0:
        return questions.sparkSession.createDataFrame([], schema)
    search = partial(_Search, width=size.width, k=k, threshold=threshold, schema=to_arrow_schema(schema))
    if size.n_bytes <= min(broadcast_bytes, UNCOUNTED_BYTES):
        return _with_sent_questions(wanted, stored, scope, size, search, schema)
    # Rows are counted without touching the vectors; the few of another width do not matter here.
    counted = vectors.select(F.col(scope).alias("scope") if scope else F.col("chunk_id"))
    n_vectors = counted.count()
    cores = questions.sparkSession.sparkContext.defaultParallelism
    few = size.rows * n_vectors <= SENT_PAIRS * cores and size.rows * (k or 1) <= KEPT_PAIRS
    if few and size.n_bytes <= broadcast_bytes:
        return _with_sent_questions(wanted, stored, scope, size, search, schema)
    if n_vectors == 0:
        return questions.sparkSession.createDataFrame([], schema)
    # As many tiles as keep the cores busy, of equal sides, within the bounds of a tile.
    block_rows, most = max(1, block_bytes // (8 * size.width)), max(1, TILE_BYTES // (8 * size.width))
    least = min(TILE_ROWS, block_rows, most)
    rows = min(max(isqrt(size.rows * n_vectors // (TILES_PER_CORE * cores)), least), most)
    question_rows = min(rows, max(KEPT_PAIRS // k, 1)) if k else rows
    return _with_tiles(wanted, stored, counted, scope, n_vectors, rows, question_rows, search, schema)


def _with_sent_questions(wanted, stored, scope, size: QuestionSize, search, schema) -> DataFrame:
    sent = wanted.sparkSession.sparkContext.broadcast(wanted.toArrow().combine_chunks())
    if scope:
        stored = _only_asked(wanted, stored, size)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = search(sent.value, "scopes" if scope else None)
        for batch in batches:
            if batch.num_rows:
                yield from task.add(batch, "scope")
        yield from task.finish()

    return stored.mapInArrow(multiply, schema)


def asked_scopes(questions: DataFrame, size: QuestionSize) -> list | None:
    """The distinct scopes of the questions, when they are few enough for a literal filter."""
    if "scopes" not in questions.columns or size.scopes > COLLECTED_SCOPES:
        return None
    rows = questions.select(F.explode("scopes").alias("scope")).where("scope IS NOT NULL").distinct().collect()
    return [r["scope"] for r in rows] if len(rows) <= PUSHED_SCOPES else None


def _only_asked(wanted: DataFrame, stored: DataFrame, size: QuestionSize) -> DataFrame:
    """Drop vectors outside all asked scopes before they leave the JVM.

    A short list of scopes is a literal filter, which reaches the scan and prunes files
    and partitions; a longer one (still within the measured bound) is a broadcast semi join.
    """
    asked = asked_scopes(wanted, size)
    if asked is not None:
        return stored.where(F.col("scope").isin(asked))
    scopes = wanted.select(F.explode("scopes").alias("scope")).distinct()
    return stored.join(F.broadcast(scopes), "scope", "left_semi")


def _comparable(wanted: DataFrame, stored: DataFrame, counted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All three with scopes of one type, so that equal values have equal hashes."""
    asked, own = wanted.schema["scopes"].dataType.elementType, stored.schema["scope"].dataType
    if asked == own:
        return wanted, stored, counted
    kind = "bigint" if isinstance(asked, T.IntegralType) and isinstance(own, T.IntegralType) else "string"
    own_scope = F.col("scope").cast(kind)
    return (
        wanted.withColumn("scopes", F.col("scopes").cast(f"array<{kind}>")),
        stored.withColumn("scope", own_scope),
        counted.withColumn("scope", own_scope),
    )


def _with_tiles(
    wanted, stored, counted, scope, n_vectors: int, rows: int, question_rows: int, search, schema
) -> DataFrame:
    """Tiles of about `question_rows` questions and `rows` vectors, each in a partition of its own."""
    spark, n_bins = wanted.sparkSession, -(-n_vectors // rows)
    if scope:
        wanted, stored, counted = _comparable(wanted, stored, counted)
        # Scopes with many vectors have blocks of their own, the others share blocks by hash.
        # As many large ones are collected as there are blocks, a few times over.
        sizes = counted.where("scope IS NOT NULL").groupBy("scope").agg(F.count("*").alias("n"))
        large = [(r["scope"], -(-r["n"] // rows)) for r in sizes.where(F.col("n") * 4 > rows).collect()]
        kind, shared = stored.schema["scope"].dataType, n_bins
        firsts = []
        for _, pieces in large:
            firsts.append(n_bins)
            n_bins += pieces
        own = [(value, first, pieces) for (value, pieces), first in zip(large, firsts)]
        places = spark.createDataFrame(own, T.StructType([
            T.StructField("scope", kind), T.StructField("first", T.IntegerType()), T.StructField("pieces", T.IntegerType())]))
        by_hash = F.pmod(F.xxhash64("scope"), F.lit(shared)).cast("int")
        piece = F.pmod(F.xxhash64("chunk_id"), F.col("pieces")).cast("int")
        stored = stored.where("scope IS NOT NULL").join(F.broadcast(places), "scope", "left").withColumn(
            "bin", F.coalesce(F.col("first") + piece, by_hash)
        )
        blocks = {value: list(range(first, first + pieces)) for value, first, pieces in own}
        of_large = F.map_from_arrays(
            F.array(*[F.lit(v).cast(kind) for v in blocks]), F.array(*[F.lit(b) for b in blocks.values()])
        ) if blocks else None

        def bins_of(value):
            hashed = F.array(F.pmod(F.xxhash64(value), F.lit(shared)).cast("int"))
            return hashed if of_large is None else F.coalesce(F.try_element_at(of_large, value), hashed)

        known = F.filter("scopes", lambda value: value.isNotNull())
        asked = wanted.withColumn("bin", F.explode(F.array_distinct(F.flatten(F.transform(known, bins_of)))))
    else:
        stored = stored.withColumn("bin", F.pmod(F.xxhash64("chunk_id"), F.lit(n_bins)).cast("int"))
        asked = wanted.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
    tiles, n_tiles = [], 0
    for row in asked.groupBy("bin").agg(F.count("*").alias("n")).orderBy("bin").collect():
        tiles.append((row["bin"], n_tiles, -(-row["n"] // question_rows)))
        n_tiles += tiles[-1][2]
    if not tiles:
        return spark.createDataFrame([], schema)
    tiles = F.broadcast(spark.createDataFrame(tiles, "bin int, first_tile int, tiles int"))
    own_tile = F.col("first_tile") + F.pmod(F.xxhash64("question_id"), F.col("tiles")).cast("int")
    every_tile = F.explode(F.sequence(F.col("first_tile"), F.col("first_tile") + F.col("tiles") - 1))
    # The names differ on the two sides, because both may come from the same table.
    payload = [name for name in schema.names if name in stored.columns]
    left = asked.join(tiles, "bin").select(
        own_tile.alias("tile"), F.lit(0).alias("side"), "question_id", "top_k", F.col("vector").alias("q_vector"),
        *([F.filter("scopes", lambda value: F.array_contains(bins_of(value), F.col("bin"))).alias("scopes")] if scope else []),
    )
    right = stored.join(tiles, "bin").select(
        every_tile.alias("tile"), F.lit(1).alias("side"), F.col("vector").alias("v_vector"),
        *[F.col(name).alias(f"v_{name}") for name in payload], *(["scope"] if scope else []),
    )
    both = left.unionByName(right, allowMissingColumns=True).repartitionById(min(n_tiles, TILE_PARTITIONS), "tile")
    laid_out = both.sortWithinPartitions("tile", "side", *(["scope"] if scope else []))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, asked, task = None, [], None
        for batch in batches:
            at = batch.column("tile").to_numpy(zero_copy_only=False) * 2 + batch.column("side").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(at)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(at)]):
                if start == end:
                    continue
                part = batch.slice(start, end - start)
                if at[start] // 2 != tile:
                    if task:
                        yield from task.finish()
                    tile, asked, task = at[start] // 2, [], None
                if at[start] % 2 == 0:
                    names = ["question_id", "top_k", "q_vector", *(["scopes"] if scope else [])]
                    asked.append(part.select(names).rename_columns([*names[:2], "vector", *names[3:]]))
                    continue
                if asked:
                    task, asked = search(pa.Table.from_batches(asked), "scopes" if scope else None), []
                if task:
                    names = ["v_vector", *[f"v_{name}" for name in payload], *(["scope"] if scope else [])]
                    yield from task.add(part.select(names).rename_columns(["vector", *payload, *names[1 + len(payload) :]]), "scope")
        if task:
            yield from task.finish()

    return laid_out.mapInArrow(multiply, schema)


def width_mismatches(questions: DataFrame, vectors: DataFrame) -> DataFrame:
    """(question_id, width): questions whose width no stored vector has; they cannot have hits."""
    stored = vectors.select(F.size("vector").alias("width")).distinct()
    return questions.select("question_id", F.size("vector").alias("width")).join(stored, "width", "left_anti").select("question_id", "width")


def rank_hits(pairs: DataFrame, limit: int) -> DataFrame:
    """Rank pairs per question and keep the `top_k` best.

    The literal bound lets Spark cut each group before the exchange; the smaller
    per-question bound applies afterwards.
    """
    order = Window.partitionBy("question_id").orderBy(F.desc("similarity"), "chunk_id")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return ranked.where(F.col("rank") <= F.col("top_k")).drop("top_k")


def top_k(
    questions: DataFrame, vectors: DataFrame, *, k: int = 5, size: QuestionSize | None = None, **options
) -> DataFrame:
    """Exact top-k: (question_id, chunk_id, *carry, similarity, rank).

    k applies where the questions bring no own top_k; else the largest of them bounds the search.
    """
    size = size or measure_questions(questions)
    bound = max(size.top_k, 1) if "top_k" in questions.columns else k
    return rank_hits(similar_pairs(questions, vectors, k=bound, size=size, **options), bound)
