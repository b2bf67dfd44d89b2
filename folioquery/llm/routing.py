"""Packed requests from blocks of documents to shares of a key space and back, in rounds of bounded fan-out.

Every block asks nearly every share. One row for each pair of them would make rows grow with the square of the
corpus, each with fewer keys. So a round deals requests `each` ways only: a task takes about `each` rows of one way, from
as many blocks, and splits them `each` ways further. After `levels` rounds the rows are dealt by share. Answers go the
same way home: those of one trip meet and are split by where the rows came from. A round writes about as many rows as
it read, so rows for each GB grow with the number of rounds, the logarithm of the corpus.

A row is (way, origin, crate): the key modulo each**level, the block or trip it comes from, and the packed
value, a list of keys on the first level and a list of (origin, value) after a round. Rows are sorted before they are
put together, and trips are named by their content, so a task that runs again makes the same trips.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquery.llm.common import squeeze, unsqueeze

FAN = 4096  # ways of one round at most: one round up to 32 GB of words, two up to 134 TB
TRIP_BYTES = 16 << 20  # packed requests of one trip, beyond one row
REQUEST = "way long, origin long, crate binary"
ANSWER = "origin long, crate binary"


def ways(shares: int, fan: int = 0) -> tuple[int, int]:
    """(each, levels): as few rounds as possible, and as few ways in each, for at least so many shares."""
    fan = fan or FAN
    levels = 1
    while fan**levels < shares:
        levels += 1
    each = 1
    while each**levels < shares:
        each += 1
    return each, levels


def request_row(way: int, origin: int, value: object) -> pa.RecordBatch:
    columns = [pa.array([way], pa.int64()), pa.array([origin], pa.int64()), pa.array([squeeze(value)], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["way", "origin", "crate"])


def answer_row(origin: int, value: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([origin], pa.int64()), pa.array([squeeze(value)], pa.binary())], ["origin", "crate"])


def outward(requests: DataFrame, each: int, levels: int, split: Callable[[object, int], dict[int, object]]) -> DataFrame:
    """requests by key modulo `each` -> by key modulo each**levels, the share.

    `split(value, n)` cuts the keys of a value by the key modulo n.
    """
    for level in range(2, levels + 1):
        requests = _deal(requests, each, level, levels, split)
    return requests


def _deal(requests: DataFrame, each: int, level: int, levels: int, split: Callable) -> DataFrame:
    target = each**level

    def parts(value: object, depth: int) -> dict[int, object]:
        if not depth:
            return split(value, target)
        out: dict[int, list] = {}
        for origin, inner in value:
            for way, piece in parts(inner, depth - 1).items():
                out.setdefault(way, []).append((origin, piece))
        return out

    def trip(way: int, held: list) -> Iterator[pa.RecordBatch]:
        name = xxhash.xxh64_intdigest(repr((way, [origin for origin, _ in held])).encode()) - 2**63
        for to, value in sorted(parts(held, level - 1).items()):
            yield request_row(to, name, value)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, size = None, [], 0
        for batch in batches:
            rows = zip(*(batch.column(n).to_pylist() for n in ("way", "band", "origin", "crate")), strict=True)
            for way, band, origin, crate in rows:
                if held and ((way, band) != current or len(held) == each or size + len(crate) > TRIP_BYTES):
                    yield from trip(current[0], held)
                    held, size = [], 0
                current = way, band
                held.append((origin, unsqueeze(crate)))
                size += len(crate)
        if held:
            yield from trip(current[0], held)

    # As many groups of way and band as there are shares, each with about `each` rows.
    banded = requests.withColumn("band", F.pmod(F.xxhash64("origin"), F.lit(each ** (levels - level + 1))))
    dealt = banded.repartition(each**levels, "way", "band").sortWithinPartitions("way", "band", "origin")
    return dealt.mapInArrow(deal, REQUEST)


def answered(value: object, levels: int, answer: Callable[[object], object]) -> list:
    """What a share sends home for the value of one row: the answers in place of the keys."""

    def fill(inner: object, depth: int) -> object:
        return [(origin, fill(v, depth - 1)) for origin, v in inner] if depth else answer(inner)

    return fill(value, levels - 1) if levels > 1 else [answer(value)]


def homeward(answers: DataFrame, each: int, levels: int) -> DataFrame:
    """answers(origin, crate) of the shares -> the same by block, each crate a list of answers; several rows per block."""
    for depth in range(levels - 1, 0, -1):
        answers = _return(answers, each**levels, depth)
    return answers


def _return(answers: DataFrame, partitions: int, depth: int) -> DataFrame:
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, home = None, {}
        for batch in batches:
            for trip, crate in zip(*(batch.column(n).to_pylist() for n in ("origin", "crate")), strict=True):
                if trip != current:
                    yield from (answer_row(o, v) for o, v in home.items())
                    current, home = trip, {}
                for origin, value in unsqueeze(crate):
                    home.setdefault(origin, []).extend(value if depth > 1 else [value])
        yield from (answer_row(o, v) for o, v in home.items())

    return answers.repartition(partitions, "origin").sortWithinPartitions("origin").mapInArrow(gather, ANSWER)
