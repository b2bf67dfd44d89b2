"""Best-fit packing by patterns: non-negative least squares on the histogram of piece lengths.

Documents become token ids and are cut into pieces of at most `capacity` tokens; only longer ones
are cut, and then the first piece takes the rest, so that all others are full. What is planned is the
histogram of lengths, which has `capacity` bars for any input: patterns of up to three length
classes that fill a sequence are enumerated, non-negative least squares fits how often each is
used, the counts are rounded down, and what is left is packed best fit on the histogram. Each
piece then finds its place from its rank among the pieces of its length.

A null text is empty and packs as the closing id alone. Ties are broken by task and row order, so
sequence numbers may differ between runs; the number of sequences doesn't. Repeated rows are packed
one by one. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from folioquery.session import materialize

CAPACITY = 2048
END_ID = 0  # closes every document
WIDTH = 8  # lengths per class of the fit
FIT_ROUNDS = 600
OTHER_SCRIPT = regex.compile(r"[^\x00-ɏ]")


def encoders(tokenizer: str, ranks: str, pattern: str) -> tuple[Tokenizer, tiktoken.Encoding, tuple[str, ...]]:
    library = Tokenizer.from_file(tokenizer)
    specials = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
    with open(ranks, "rb") as file:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
    return library, tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=table, special_tokens={}), tuple(specials)


def token_ids(texts: list[str], loaded: tuple[Tokenizer, tiktoken.Encoding, tuple[str, ...]]) -> Iterator[list[int]]:
    """Ids of the tokenizer without added tokens; `loaded` are its `encoders`.

    Latin texts without its special strings go through the rank file of the same vocabulary,
    which gives the same ids in a quarter of the time; all others through the tokenizer itself.
    """
    library, quick, specials = loaded
    for text in texts:
        if OTHER_SCRIPT.search(text) or any(s in text for s in specials):
            yield library.encode(text, add_special_tokens=False).ids
        else:
            yield quick.encode_ordinary(text)


def cut_documents(docs: DataFrame, tokenizer: str, ranks: str, pattern: str, capacity: int) -> DataFrame:
    """A row per piece, with its rank among the pieces of its length in the same task."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, task int, rank long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        loaded = encoders(tokenizer, ranks, pattern)
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            index: list[int] = []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for row, ids in enumerate(token_ids(texts, loaded)):
                flat = np.array([*ids, END_ID], "<u4")
                head = len(flat) % capacity or capacity
                for piece, end in enumerate(range(head, len(flat) + 1, capacity)):
                    start = max(0, end - capacity) if piece else 0
                    length = end - start
                    values = (piece, start, length, crc32(flat[start:end].tobytes()), task, seen[length])
                    seen[length] += 1
                    index.append(row)
                    for column, value in zip(out[1:], values, strict=True):
                        column.append(value)
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(index, pa.int64()))]
                + [pa.array(c, t) for c, t in zip(out[1:], types, strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"],
            )

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def patterns(classes: int) -> np.ndarray:
    """All (a, b, c) with a >= b >= c >= 0 and a + b + c = classes: full sequences of up to three pieces."""
    a, b = np.meshgrid(np.arange(classes + 1), np.arange(classes + 1), indexing="ij")
    c = classes - a - b
    keep = (a >= b) & (b >= c) & (c >= 0)
    return np.stack([a[keep], b[keep], c[keep]], 1)


def fit_counts(shapes: np.ndarray, wanted: np.ndarray, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Non-negative x with least squares |A x - wanted|, A the pieces of each class in each shape.

    Accelerated projected gradient; A is only applied through the three columns of the shapes.
    """
    n = len(wanted)
    scale = 1 / np.maximum(wanted.max(initial=0), 1)
    target = wanted * scale
    target[0] = 0
    members = shapes.T

    def forward(x: np.ndarray) -> np.ndarray:
        out = sum(np.bincount(m, x, n) for m in members)
        out[0] = 0
        return out

    def backward(r: np.ndarray) -> np.ndarray:
        return sum(r[m] for m in members)

    probe = np.ones(len(shapes))
    for _ in range(30):  # the largest eigenvalue bounds the step
        probe = backward(forward(probe))
        top = np.linalg.norm(probe)
        probe /= top
    x = y = np.zeros(len(shapes))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(y - backward(forward(y) - target) / top, 0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / after * (new - x)
        x, t = new, after
    return x / scale


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: (lengths of a sequence, how many such sequences).

    Sequences with equal content are one entry, so the work depends on lengths, not on pieces.
    """
    gaps: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    roomy = np.zeros(capacity + 1, bool)  # room that some open sequence has
    for length in range(capacity, 0, -1):
        todo = int(left[length])
        while todo:
            room = length + int(np.argmax(roomy[length:]))
            if not roomy[room]:
                # None has room: new sequences, each with as many copies as the next rounds will fill.
                gaps[capacity - length][(length,)] += todo if capacity - length < length else max(1, todo // (capacity // length))
                used = todo if capacity - length < length else max(1, todo // (capacity // length))
                roomy[capacity - length] = True
                todo -= used
                continue
            content, count = next(iter(gaps[room].items()))
            used = min(todo, count)
            if used == count:
                del gaps[room][content]
                roomy[room] = bool(gaps[room])
            else:
                gaps[room][content] = count - used
            gaps[room - length][(*content, length)] += used
            roomy[room - length] = True
            todo -= used
    return [(content, count) for by in gaps.values() for content, count in by.items()]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, width: int = WIDTH) -> list[tuple[tuple[int, ...], int]]:
    """Runs of equal sequences: (lengths of the pieces, how many sequences).

    Classes of the fit hold lengths rounded up; the pieces of a
    class are taken longest first.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, count in histogram.items():
        left[length] = count
    runs: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        runs.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    classes = capacity // width
    class_of = -(-np.arange(capacity + 1) // width)
    wanted = np.bincount(class_of, left, classes + 1)
    shapes = patterns(classes)
    counts = np.floor(fit_counts(shapes, wanted) + 1e-6).astype(np.int64)
    open_ = wanted.astype(np.int64)
    for i in np.argsort(-counts, kind="stable"):
        if not counts[i]:
            break
        parts = [int(c) for c in shapes[i] if c]
        most = min(open_[c] // parts.count(c) for c in parts)
        repeat = int(min(counts[i], most))
        for c in parts:
            open_[c] -= repeat
        while repeat:  # sequences of the pattern, by runs of equal exact lengths
            exact: list[int] = []
            taken: dict[int, int] = defaultdict(int)
            for c in parts:
                low, high = (c - 1) * width + 1, min(c * width, capacity)
                length = next(n for n in range(high, low - 1, -1) if left[n] > taken.get(n, 0))
                taken[length] += 1
                exact.append(length)
            run = min([repeat, *(int(left[n]) // k for n, k in taken.items())])
            for n, k in taken.items():
                left[n] -= run * k
            runs.append((tuple(exact), run))
            repeat -= run
    return fill_gaps(runs, left, capacity)


def fill_gaps(runs: list[tuple[tuple[int, ...], int]], left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit of what is left: first into the gaps that rounding has left, then into sequences of its own."""
    smallest = int(np.argmax(left > 0)) if left.any() else capacity + 1
    out = []
    for content, count in sorted(runs, key=lambda r: capacity - sum(r[0])):
        while count and (gap := capacity - sum(content)) >= smallest:
            fits = np.flatnonzero(left[: gap + 1])
            if not len(fits):
                break
            length = int(fits[-1])
            used = min(count, int(left[length]))
            left[length] -= used
            if used < count:
                out.append((content, count - used))
            content, count = (*content, length), used
        out.append((content, count))
    return out + best_fit(left, capacity)


def place_arrays(runs: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length, by run: first rank, sequence of that rank, place of the piece in its sequence.

    Runs number their sequences one after the other; the arrays depend on lengths, not on the input's size.
    """
    rows: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for content, count in runs:
        for place, length in enumerate(content):
            rows[length].append((used[length], sequence, place))
            used[length] += count
        sequence += count
    return {length: tuple(np.array(c, np.int64) for c in zip(*found, strict=True)) for length, found in rows.items()}


def pack_sequences(
    docs: DataFrame, tokenizer: str, ranks: str, pattern: str, capacity: int = CAPACITY
) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, piece, start, length, ids_crc32, sequence_id, offset; a row per piece."""
    spark = docs.sparkSession
    pieces = materialize(cut_documents(docs, tokenizer, ranks, pattern, capacity), "packing")
    # Rank among all pieces of a length: pieces of earlier tasks come first.
    counts = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows
    if not histogram:
        schema = T.StructType([*pieces.schema.fields[:5], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
        return spark.createDataFrame([], schema)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    ranked = pieces.join(firsts, ["length", "task"]).withColumn("rank", F.col("rank") + F.col("earlier"))
    # A rank finds its run by binary search inside the task.
    shared = spark.sparkContext.broadcast(place_arrays(plan(histogram, capacity)))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, at = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int32)
            for length in np.unique(lengths).tolist():
                here = np.flatnonzero(lengths == length)
                first, start, places = shared.value[length]
                run = np.searchsorted(first, rank[here], side="right") - 1
                sequence[here] = start[run] + rank[here] - first[run]
                at[here] = places[run].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [pa.array(sequence), pa.array(at)], [*names, "sequence_id", "place"]
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    placed = ranked.select(*names, "rank").mapInArrow(
        place, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, place int"
    )
    # A sequence holds at most `capacity` pieces.
    earlier = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(
        *names, "sequence_id", F.coalesce(F.sum("length").over(earlier), F.lit(0)).cast("long").alias("offset")
    )
