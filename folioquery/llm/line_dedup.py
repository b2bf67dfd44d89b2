"""Line deduplication by an exact set-similarity join.

A line is the set of its words, which ASCII white space parts. It is removed if an earlier line, in the
same or another document, has Jaccard similarity of at least 4/5 with it; earlier means a smaller
(doc_id, line number), whether or not that line is removed itself. Lines without words stay.

Lines of equal words in equal order are found by two hashes. For the others the words of a line are put in order of rarity and
only its prefix is indexed, long enough that two similar lines share a word of it; words that occur
once are left out, as nobody shares them. Rarity is estimated from a count sketch of fixed size over
all texts: any common order gives exact results, rarity only makes the index lists short. Lines that share
an indexed word are compared by length, by the places of the word in both, and by a parity of all their
words that bounds their difference; each line keeps a few of the nearest candidates of every word.
Those are verified on the words themselves. A line that none of them settles and that had more
candidates is joined with all of them; lists of words with such a line are kept for that.

Null and empty texts have one blank line. Lines of rows that share a doc_id and a number are not earlier
than one another; rows without doc_id come first. An empty table gives no rows. Columns other than
doc_id, text and n_chars are passed on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioquery.llm.common import slices, whole_text
from folioquery.llm.quality import BLOOM, settings
from folioquery.session import materialize

SHARE, OF = 4, 5  # similarity of at least 4/5
SKETCH_BITS = 24
SEGMENT = 1 << 16  # counters per row of the sketch table
TOKEN_BITS = 42
MARK_BITS = 22  # of a token's hash, by which lines without wanted words are passed over
NEAREST = 8  # candidates of a line and word that are verified first
SENT_TOKENS = 200_000  # words of unsettled lines that are sent to the scan; more of them meet in a shuffle
LINES = 1 << 13  # lines sorted at a time
COUNTED = 1 << 20  # words sorted at a time to be counted
PACKED = 1 << 19  # indexed words that a task packs at a time
SHARE_BYTES = 32 << 20  # of indexed words that meet in a task
MOST_SHARES = 4096  # up to about 60 GB of text
LISTED = 50_000  # indexed words compared at a time, whole lists
UNIT = 125_000  # characters split at a time; the arrays of more leave the cache
CACHED = 120_000
FIRST = -(2**63)
LOW_BYTES = np.array([256**n - 1 for n in range(9)], np.uint64)  # masks of the first n of eight bytes
_random = np.random.default_rng(7)
#: Random factors by place of eight letters in their word and of a word in its line, within a page of 4096 places.
LETTERS, WORDS, WORDS_TOO = (_random.integers(0, 2**64, 4096, np.uint64) | np.uint64(1) for _ in range(3))


def mixed(values: np.ndarray) -> np.ndarray:
    values = values ^ values >> np.uint64(32)
    values = values * np.uint64(0xD6E8FEB86659FD93)
    return values ^ values >> np.uint64(32)


def factors(table: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Random factors by place: those of the table, times one of their own for every page but the first."""
    if not len(place) or place.max() <= 4095:
        return table[place]
    return table[place & 4095] * (mixed((place >> 12).astype(np.uint64)) | np.uint64(1))


def places_in(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... in every group; the groups follow each other, first is where each begins. Counted in place."""
    place = np.ones(int(first[-1] + sizes[-1]), np.int32)
    place[0] = 0
    place[first[1:]] = 1 - sizes[:-1]
    return np.cumsum(place, dtype=np.int32, out=place)


@dataclass
class Lines:
    """The lines with words of some texts."""

    text: np.ndarray  # which text
    number: np.ndarray  # line of the text, from 0
    line: np.ndarray  # two hashes of the words in order
    other: np.ndarray
    n: np.ndarray  # words
    word: np.ndarray  # hashes of the words of all lines, one after the other

    def __len__(self) -> int:
        return len(self.line)


def word_hashes(joined: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of every word, eight bytes at a time; at least seven bytes follow the last word."""
    eight = np.ndarray((len(joined) - 7,), np.uint64, joined, 0, (1,))  # the eight bytes from every place
    value = eight[starts] & LOW_BYTES[np.minimum(sizes, 8)]
    long = np.flatnonzero(sizes > 8)
    if len(long):
        n = (sizes[long] + 7) >> 3
        first = np.cumsum(n) - n
        place = places_in(first, n)
        at = np.repeat(starts[long], n) + 8 * place.astype(np.int64)
        left = np.repeat(starts[long] + sizes[long], n) - at
        letters = mixed(eight[at] & LOW_BYTES[np.minimum(left, 8)]) * factors(LETTERS, place)
        value[long] = np.add.reduceat(letters, first)
    return mixed(mixed(value + sizes.astype(np.uint64) * LETTERS[0]))


def split_lines(texts: list[str], two: bool = True) -> Lines:
    """The lines of the texts; without `two` the second hash is the first."""
    joined = "\n".join(texts).encode("utf-8", "surrogatepass") + b"\n" * 8
    data = np.frombuffer(joined, np.uint8)
    blank = (data == 32) | (data - np.uint8(9) < 5)
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edges = np.r_[0, edges]
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Lines(none, none, *(none.astype(np.uint64),) * 2, none, none.astype(np.uint64))
    word = word_hashes(joined, starts, sizes)
    before = np.searchsorted(starts, np.flatnonzero(data == 10))  # words before the end of every line
    words = np.diff(before, prepend=0)
    at = np.flatnonzero(words)
    n = words[at]
    begin = before[at] - n
    place = places_in(begin, n)
    line = mixed(np.add.reduceat(word * factors(WORDS, place), begin))
    other = mixed(np.add.reduceat(word * factors(WORDS_TOO, place), begin)) if two else line
    before = np.cumsum([0] + [t.count("\n") + 1 for t in texts[:-1]])
    text = np.searchsorted(before, at, side="right") - 1
    return Lines(text, at - before[text], line, other, n, word)


def lines_of(texts: list[str], unit: int = UNIT, two: bool = True) -> Iterator[Lines]:
    """The lines of all texts in parts of bounded length; very long texts are parted between lines."""
    for start, end in slices(texts, unit):
        if end - start > 1 or len(texts[start]) <= 4 * unit:
            part = split_lines(texts[start:end], two)
            part.text = part.text + start
            yield part
            continue
        text, at, number = texts[start], 0, 0
        while at < len(text):
            stop = text.find("\n", at + unit)
            stop = len(text) if stop < 0 else stop
            part = split_lines([text[at:stop]], two)
            yield Lines(part.text + start, part.number + number, part.line, part.other, part.n, part.word)
            number += text.count("\n", at, stop) + 1
            at = stop + 1


def line_hashes(lines: list[str]) -> list[int | None]:
    """The hash of each line, None for one without words."""
    found: list[int | None] = [None] * len(lines)
    for start, end in slices(lines, UNIT):
        part = split_lines(lines[start:end], two=False)
        for i, line in zip(part.text.tolist(), signed(part.line).tolist(), strict=True):
            found[start + i] = line
    return found


def some_lines(part: Lines, which: np.ndarray) -> Lines:
    if which.all():
        return part
    return Lines(*(c[which] for c in (part.text, part.number, part.line, part.other, part.n)), part.word[np.repeat(which, part.n)])


def signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


def first_pass(docs: DataFrame) -> DataFrame:
    """(line, other, doc, number, segment, counts), written once: the hashes of every line, and counts of words by hash bucket
    of each task, 2**SKETCH_BITS at most, in segments (only these have `segment`; there `line` is the sum of the counts)."""
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    names = ["line", "other", "doc", "number", "segment", "counts"]

    def rows(*columns: pa.Array | None) -> pa.RecordBatch:
        n = next(len(c) for c in columns if c is not None)
        return pa.RecordBatch.from_arrays([pa.nulls(n, t) if c is None else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << SKETCH_BITS, np.uint32)
        seen: set[int] = set()
        held: list[np.ndarray] = []

        def count() -> None:
            bucket = np.sort(np.concatenate(held))
            at = np.r_[0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1]
            counters[bucket[at]] += np.diff(at, append=len(bucket)).astype(np.uint32)
            held.clear()

        for batch in batches:
            ids = batch.column(0).to_numpy()
            found: list[list[np.ndarray]] = [[], [], [], []]
            for part in lines_of([t or "" for t in batch.column(1).to_pylist()]):
                # Equal lines of a task count once, as they are indexed once.
                fresh = np.fromiter((not (h in seen or seen.add(h)) for h in part.line.tolist()), bool, len(part))
                word = part.word if fresh.all() else part.word[np.repeat(fresh, part.n)]
                held.append((word >> np.uint64(64 - SKETCH_BITS)).astype(np.uint32))
                if sum(map(len, held)) > COUNTED:
                    count()
                for column, values in zip(found, (signed(part.line), signed(part.other), ids[part.text], part.number.astype(np.int32)), strict=True):
                    column.append(values)
            if found[0]:
                yield rows(*map(np.concatenate, found), None, None)
            if len(seen) > CACHED:
                seen.clear()
        if held:
            count()
        pack = zstandard.ZstdCompressor(level=1).compress
        for segment, part in enumerate(counters.reshape(-1, SEGMENT)):
            if part.any():
                yield rows([int(part.sum(dtype=np.int64))], None, None, None, [segment], [pack(part.tobytes())])

    named = docs.select(F.coalesce("doc_id", F.lit(FIRST)).cast("long").alias("doc"), "text")
    passed = named.mapInArrow(split, "line long, other long, doc long, number int, segment int, counts binary")
    return materialize(passed, "line-hashes")


def word_sketch(passed: DataFrame) -> np.ndarray:
    """Rarity level by hash bucket: 0 none, 1 one occurrence, then four levels per doubling.

    2**SKETCH_BITS bytes for any input; counts of buckets are sums over all lines.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(unpack(packed), np.uint32)
                sums[segment] = sums[segment] + part if segment in sums else part.astype(np.uint64)
        for segment, total in sums.items():
            level = np.where(total > 0, 1 + np.ceil(4 * np.log2(np.maximum(total, 1))), 0).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [pa.array([segment], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["segment", "levels"]
            )

    parts = passed.where("segment IS NOT NULL").select("segment", "counts")
    rows = parts.repartition("segment").mapInArrow(add, "segment int, levels binary").collect()  # 16 MB at most
    levels = np.zeros((1 << SKETCH_BITS) // SEGMENT * SEGMENT, np.uint8).reshape(-1, SEGMENT)
    for row in rows:
        levels[row["segment"]] = np.frombuffer(row["levels"], np.uint8)
    return levels.ravel()


def index_shares(passed: DataFrame) -> int:
    """How many shares of about SHARE_BYTES the indexed words have, a fifth of all words and one of every line at most."""
    counted = F.col("segment").isNotNull()
    row = passed.agg(F.sum(F.when(counted, F.col("line"))).alias("words"), F.count(F.when(~counted, 1)).alias("lines")).first()
    return -(-((row["words"] or 0) // OF + row["lines"]) * ROW.itemsize // SHARE_BYTES)


def prefix_rows(docs: DataFrame, levels: np.ndarray, only: np.ndarray | None = None, shares: int = 0) -> DataFrame:
    """(token, line, n, place, p0, p1, doc, number): the indexed words of every distinct line of a task.

    With `only`, a sorted array of tokens, just these words, so lines without them are left out before anything is sorted.
    With `shares`, the same rows packed by share of the tokens: (share, n, crate).
    """
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    wanted = None if only is None else docs.sparkSession.sparkContext.broadcast(only)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts: dict[int, tuple[int, int]] = {}
        rarity = shared.value
        if wanted is not None:
            tokens, may = wanted.value, np.zeros(1 << MARK_BITS, bool)
            may[tokens & (1 << MARK_BITS) - 1] = True

        def rows(part: Lines, doc: np.ndarray) -> pa.RecordBatch:
            level = rarity[(part.word >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
            line = np.repeat(np.arange(len(part), dtype=np.uint64), part.n)
            short = part.word & np.uint64((1 << TOKEN_BITS) - 1)
            key = np.sort(line << np.uint64(50) | level << np.uint64(TOKEN_BITS) | short)
            fresh = np.r_[True, key[1:] != key[:-1]]  # numpy's unique takes twenty times as long as the sort
            n = part.n
            if not fresh.all():
                n, key = np.add.reduceat(fresh, np.cumsum(n) - n, dtype=np.int64), key[fresh]
            begin = np.cumsum(n) - n
            bit = np.uint64(1) << (key & np.uint64(63))
            high = (key & np.uint64(64)) > 0
            parity = [np.bitwise_xor.reduceat(bit * side, begin) for side in (~high, high)]
            size = n - (SHARE * n + OF - 1) // OF + 1
            line = np.repeat(np.arange(len(part)), size)
            place = places_in(np.cumsum(size) - size, size)
            token = key[begin[line] + place] & np.uint64((1 << 50) - 1)
            keep = (token >> np.uint64(TOKEN_BITS)) != 1
            if wanted is not None:
                own = signed(token[keep])
                keep[keep] = tokens[np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)] == own
            line, token, place = line[keep], token[keep], place[keep]
            columns = [
                signed(token),
                signed(part.line)[line],
                n[line].astype(np.int32),
                place.astype(np.int32),
                *(signed(p)[line] for p in parity),
                doc[line],
                part.number[line].astype(np.int32),
            ]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], NAMES)

        def later(name: int, place: tuple[int, int]) -> bool:
            """Of equal lines of a task only those with an earlier place than before are needed."""
            if name in firsts and firsts[name] <= place:
                return True
            firsts[name] = place
            return False

        for batch in batches:
            ids = batch.column(0).to_numpy()
            for part in lines_of([t or "" for t in batch.column(1).to_pylist()], two=False):
                if wanted is not None and len(part):
                    marked = may[(part.word & np.uint64((1 << MARK_BITS) - 1)).view(np.int64)]
                    part = some_lines(part, np.logical_or.reduceat(marked, np.cumsum(part.n) - part.n))
                doc = ids[part.text]
                places = zip(doc.tolist(), part.number.tolist(), strict=True)
                fresh = ~np.fromiter(map(later, part.line.tolist(), places), bool, len(part))
                part = some_lines(part, fresh)
                doc, ends = doc[fresh], np.cumsum(part.n)
                for a in range(0, len(part), LINES):
                    own = slice(a, a + LINES)
                    words = part.word[ends[a] - part.n[a] : ends[min(a + LINES, len(part)) - 1]]
                    yield rows(Lines(*(c[own] for c in (part.text, part.number, part.line, part.other, part.n)), words), doc[own])
            if len(firsts) > CACHED:
                firsts.clear()

    def crates(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = np.concatenate([b.column("token").to_numpy() & (1 << TOKEN_BITS) - 1 for b in held]) % shares
        order = np.argsort(share, kind="stable")
        columns = [np.concatenate([b.column(n).to_numpy() for b in held])[order] for n in NAMES]
        at = np.flatnonzero(np.diff(share[order], prepend=-1))
        for way, a, b in zip(share[order[at]].tolist(), at.tolist(), [*at[1:].tolist(), len(order)], strict=True):
            crate = b"".join(c[a:b].tobytes() for c in columns)
            yield pa.RecordBatch.from_arrays([pa.array([way], pa.int32()), pa.array([b - a], pa.int32()), pa.array([crate], pa.binary())], ["share", "n", "crate"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in index(batches):
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= PACKED:
                yield from crates(held)
                held, size = [], 0
        if held:
            yield from crates(held)

    named = docs.select(F.coalesce("doc_id", F.lit(FIRST)).cast("long").alias("doc"), "text")
    if shares:
        return named.mapInArrow(packed, "share int, n int, crate binary")
    return named.mapInArrow(index, INDEXED)


ROW = np.dtype([("token", "i8"), ("line", "i8"), ("n", "i4"), ("place", "i4"), ("p0", "i8"), ("p1", "i8"), ("doc", "i8"), ("number", "i4")])
NAMES = list(ROW.names)
INDEXED = "token long, line long, n int, place int, p0 long, p1 long, doc long, number int"


def _near(a: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether rows i and j pass the filters for equal tokens, and the parity distance."""
    total = a["n"][i] + a["n"][j]
    overlap = (SHARE * total + SHARE + OF - 1) // (SHARE + OF)
    before = np.minimum(a["place"][i], a["place"][j])
    after = np.minimum(a["n"][i] - a["place"][i], a["n"][j] - a["place"][j])
    # Unsigned: numpy counts the bits of the magnitude of negative numbers.
    differ = [(a[p][i] ^ a[p][j]).view(np.uint64) for p in ("p0", "p1")]
    apart = sum(np.bitwise_count(d).astype(np.int32) for d in differ)
    fits = (before + after >= overlap) & (apart <= total - 2 * overlap) & (a["line"][i] != a["line"][j])
    return fits, apart


def compare_lists(a: dict[str, np.ndarray]) -> dict[str, np.ndarray] | None:
    """Nearest earlier candidates of each row; a holds whole lists of tokens, in the order of tokens."""
    # The tokens are in order already: their rank and the size of the line are one key.
    rank = np.cumsum(np.diff(a["token"], prepend=a["token"][:1]) != 0) << 32 | a["n"]
    order = np.lexsort((a["line"], rank))
    fresh = np.r_[True, (np.diff(rank[order]) != 0) | (np.diff(a["line"][order]) != 0)]
    if not fresh.all():  # equal lines from several tasks: the first place counts
        again = ~fresh
        again[:-1] |= ~fresh[1:]
        run, own = np.cumsum(fresh)[again], order[again]
        order[again] = own[np.lexsort((a["number"][own], a["doc"][own], run))]
        order = order[fresh]
    a = {k: v[order] for k, v in a.items()}
    size = len(a["token"])
    active = np.flatnonzero(a["token"][1:] == a["token"][:-1])
    if not len(active):
        return None
    nearest = np.full((size, NEAREST), -1, np.int64)
    distance = np.full((size, NEAREST), 1 << 20, np.int32)
    total = np.zeros(size, np.int64)
    step = 1
    while len(active):
        other = active + step
        fits, apart = _near(a, active, other)
        i, j, apart = active[fits], other[fits], apart[fits]
        earlier = (a["doc"][i] < a["doc"][j]) | ((a["doc"][i] == a["doc"][j]) & (a["number"][i] < a["number"][j]))
        same = (a["doc"][i] == a["doc"][j]) & (a["number"][i] == a["number"][j])
        late, early = np.where(earlier, j, i)[~same], np.where(earlier, i, j)[~same]
        apart = apart[~same]
        # A row is late at most twice in a step: as the first and as the second of a pair.
        for turn in (late == i[~same], late != i[~same]):
            who, with_, dist = late[turn], early[turn], apart[turn]
            total[who] += 1
            worst = distance[who].argmax(1)
            better = distance[who, worst] > dist
            nearest[who[better], worst[better]] = with_[better]
            distance[who[better], worst[better]] = dist[better]
        step += 1
        active = active[active + step < size]
        other = active + step
        # Rows are ordered by token and length: a pair too far apart stays so.
        active = active[(a["token"][other] == a["token"][active]) & (SHARE * a["n"][other] <= OF * a["n"][active])]
    late, slot = np.nonzero(nearest >= 0)
    if not len(late):
        return None
    early = nearest[late, slot]
    return {
        **{n: a[n][late] for n in ("line", "doc", "number")},
        **{f"e_{n}": a[n][early] for n in ("line", "doc", "number")},
        "more": total[late] > NEAREST,
        "token": a["token"][late],
    }


FOUND = "line long, doc long, number int, e_line long, e_doc long, e_number int, more boolean"


def packed_candidates(rows: DataFrame, shares: int) -> DataFrame:
    """The same as `candidates` of rows that are packed by share, and whole lists: a task has those of the tokens of a share.

    (..., n, crate): where a list has a row with more candidates than the nearest, all its rows are packed in a crate.
    """
    names = [*(w.split()[0] for w in FOUND.split(", ")), "n", "crate"]
    types = [pa.int64(), pa.int64(), pa.int32()] * 2 + [pa.bool_(), pa.int32(), pa.binary()]

    def out(found: dict[str, object], n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found[c], t) if c in found else pa.nulls(n, t) for c, t in zip(names, types, strict=True)], names)

    def lists(crates: list[bytes], sizes: list[int]) -> Iterator[pa.RecordBatch]:
        a: dict[str, np.ndarray] = {}
        begin = [0] * len(crates)
        for name in NAMES:
            kind = ROW[name]
            a[name] = np.concatenate([np.frombuffer(c, kind, n, at) for c, n, at in zip(crates, sizes, begin, strict=True)])
            begin = [at + n * kind.itemsize for at, n in zip(begin, sizes, strict=True)]
            if name == "token":  # rows that are alone with their token go at once
                order = np.argsort(a["token"], kind="stable")
                again = np.diff(a["token"][order]) == 0
                order = order[np.r_[False, again] | np.r_[again, False]]
            a[name] = a[name][order]
        tokens = a["token"]
        at = 0
        while at < len(tokens):
            end = int(np.searchsorted(tokens, tokens[min(at + LISTED, len(tokens)) - 1], side="right"))
            own = {n: v[at:end] for n, v in a.items()}
            if (found := compare_lists(own)) is not None:
                yield out(found, len(found["line"]))
                if found["more"].any():
                    whole = np.isin(own["token"], found["token"][found["more"]])
                    crate = b"".join(own[n][whole].tobytes() for n in NAMES)
                    yield out({"n": [np.count_nonzero(whole)], "crate": [crate]}, 1)
            at = end

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[bytes], list[int]]] = {}  # of one share, as each has a partition of its own
        for batch in batches:
            for way, n, crate in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                crates, sizes = held.setdefault(way, ([], []))
                crates.append(crate)
                sizes.append(n)
        for crates, sizes in held.values():
            yield from lists(crates, sizes)

    return rows.repartitionById(shares, "share").mapInArrow(pairs, f"{FOUND}, n int, crate binary")


def unpacked(rows: DataFrame) -> DataFrame:
    """The rows in the crates of rows(n, crate)."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, crate in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                at, columns = 0, []
                for name in NAMES:
                    columns.append(pa.array(np.frombuffer(crate, ROW[name], n, at)))
                    at += n * ROW[name].itemsize
                yield pa.RecordBatch.from_arrays(columns, NAMES)

    return rows.select("n", "crate").mapInArrow(unpack, INDEXED)


def candidates(rows: DataFrame) -> DataFrame:
    """(line, doc, number, e_line, e_doc, e_number, more): a late line and an earlier candidate."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None

        def out(a: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
            again = a["token"][1:] == a["token"][:-1]
            shared = np.r_[False, again] | np.r_[again, False]  # rows are sorted by token: others are alone with theirs
            if not again.any():
                return
            a = {n: v[shared] for n, v in a.items()}
            if (found := compare_lists(a)) is not None:
                del found["token"]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in found.values()], list(found))

        for batch in batches:
            if not batch.num_rows:
                continue
            a = {n: batch.column(n).to_numpy() for n in NAMES}
            if held is not None:
                a = {n: np.concatenate([held[n], a[n]]) for n in NAMES}
            cut = int(np.searchsorted(a["token"], a["token"][-1]))  # the last list may go on
            if cut and (cut >= LISTED or len(a["token"]) - cut > 1000):
                yield from out({n: v[:cut] for n, v in a.items()})
                a = {n: v[cut:] for n, v in a.items()}
            held = a
        if held is not None:
            yield from out(held)

    dealt = rows.repartition("token").sortWithinPartitions("token")
    return dealt.mapInArrow(pairs, FOUND)


def all_candidates(own: DataFrame, late: DataFrame, rows_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Every candidate of the lines in `late`(line, doc, number), by a join on the words; `own` has their rows.

    `rows_of` gives the rows of other lines for the words in a table.
    """
    mine = materialize(own.join(late, ["line", "doc", "number"], "left_semi"), "line-open-rows")
    rows = rows_of(materialize(mine.select("token").distinct(), "line-open-words"))
    mine = mine.select(*(F.col(n).alias(f"m_{n}") if n != "token" else F.col(n) for n in NAMES))
    total = F.col("n") + F.col("m_n")
    overlap = F.ceil(total * SHARE / (SHARE + OF))
    apart = F.bit_count(F.col("p0").bitwiseXOR(F.col("m_p0"))) + F.bit_count(F.col("p1").bitwiseXOR(F.col("m_p1")))
    bound = F.least("place", "m_place") + F.least(F.col("n") - F.col("place"), F.col("m_n") - F.col("m_place"))
    earlier = (F.col("doc") < F.col("m_doc")) | ((F.col("doc") == F.col("m_doc")) & (F.col("number") < F.col("m_number")))
    fits = (bound >= overlap) & (apart <= total - 2 * overlap) & earlier & (F.col("line") != F.col("m_line"))
    return mine.join(rows, "token").where(fits).select(
        *(F.col(f"m_{n}").alias(n) for n in ("line", "doc", "number")),
        *(F.col(n).alias(f"e_{n}") for n in ("line", "doc", "number")),
    ).distinct()


def verify(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(line, doc, number) of the late lines of `pairs` whose words are similar to the earlier line's."""
    late = pairs.select("line", "doc", "number")
    early = pairs.select(*(F.col(f"e_{n}").alias(n) for n in ("line", "doc", "number")))
    needed = late.union(early).where("number >= 0").distinct()
    needed = needed.groupBy("doc").agg(F.collect_list(F.struct("number", "line")).alias("lines"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs_, texts, wanted = (c.to_pylist() for c in batch.columns)
            # Only the asked lines are hashed: rows that share a doc_id have other lines at these numbers.
            places, lines_ = [], []
            for doc, text, asked in zip(docs_, texts, wanted, strict=True):
                held = (text or "").split("\n")
                own = [(w["number"], w["line"]) for w in asked if w["number"] < len(held)]
                places += [(line, doc, number) for number, line in own]
                lines_ += [held[number] for number, _ in own]
            out = []
            for place, text, line in zip(places, lines_, line_hashes(lines_), strict=True):
                if line == place[0]:
                    words_ = {w.decode("utf-8", "replace") for w in text.encode("utf-8", "surrogatepass").split()}
                    out.append((*place, sorted(words_)))
            if out:
                types = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string())]
                columns = zip(zip(*out, strict=True), types, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], ["line", "doc", "number", "words"])

    named = docs.select(F.coalesce("doc_id", F.lit(FIRST)).cast("long").alias("doc"), "text").join(needed, "doc")
    sets = named.select("doc", "text", "lines").mapInArrow(words, "line long, doc long, number int, words array<string>")
    sets = materialize(sets.dropDuplicates(["line", "doc", "number"]), "line-words")
    earlier = sets.select(*(F.col(n).alias(f"e_{n}") for n in ("line", "doc", "number", "words")))
    both = pairs.join(sets, ["line", "doc", "number"]).join(earlier, ["e_line", "e_doc", "e_number"])
    shared = F.size(F.array_intersect("words", "e_words"))
    union = F.size("words") + F.size("e_words") - shared
    return both.where(OF * shared >= SHARE * union).select("line", "doc", "number").distinct()


def repeats(passed: DataFrame) -> DataFrame:
    """(line, doc, number) of the lines that are equal to an earlier one."""
    lines = passed.where("segment IS NULL").select("line", "other", "doc", "number")
    place = F.struct("doc", "number")
    copies = lines.groupBy("line", "other").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("first"))
    copies = copies.where("copies > 1").drop("copies")
    return lines.join(copies, ["line", "other"]).where(place > F.col("first")).select("line", "doc", "number")


def similar_lines(docs: DataFrame, passed: DataFrame) -> DataFrame:
    """(line, doc, number) of the lines that are similar, not equal, to an earlier one; by the first place of equal lines."""
    levels = word_sketch(passed)
    shares = max(index_shares(passed), 1)
    if packed := shares <= MOST_SHARES:
        found = materialize(packed_candidates(prefix_rows(docs, levels, shares=shares), shares), "line-lists")
        lists = unpacked(found.where("crate IS NOT NULL"))
        found = found.where("crate IS NULL")
    else:  # crates would hold few words: rows of words are shuffled and sorted as such
        found = candidates(prefix_rows(docs, levels))
    pairs = materialize(found.groupBy("line", "doc", "number", "e_line", "e_doc", "e_number").agg(F.max("more").alias("more")), "line-candidates")
    with settings(docs.sparkSession, BLOOM):  # texts without a candidate line stay out of the shuffle
        settled = materialize(verify(docs, pairs), "line-settled")
    open_ = pairs.where("more").select("line", "doc", "number").distinct()
    open_ = materialize(open_.join(settled, ["line", "doc", "number"], "left_anti"), "line-open")
    if open_.isEmpty():
        return settled

    def rows_of(tokens: DataFrame) -> DataFrame:
        if packed:
            return lists.join(tokens, "token", "left_semi")
        if 0 < tokens.count() <= SENT_TOKENS:
            return prefix_rows(docs, levels, np.sort(tokens.toArrow().column("token").to_numpy()))
        return prefix_rows(docs, levels)

    if packed:
        own = lists
    else:
        key = F.coalesce("doc_id", F.lit(FIRST))
        own = prefix_rows(docs.join(open_.where("number >= 0").select(F.col("doc").alias("_doc")), key == F.col("_doc"), "left_semi"), levels)
    with settings(docs.sparkSession, BLOOM):
        rest = materialize(all_candidates(own, open_, rows_of), "line-candidates")
        return settled.union(materialize(verify(docs, rest), "line-settled"))


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc, removed array<struct<number, line>>): the lines to remove, for documents that have any."""
    passed = first_pass(docs)
    gone = repeats(passed).union(similar_lines(docs, passed)).distinct()
    return gone.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("number", "line"))).alias("removed"))


def _without() -> Column:
    @F.pandas_udf("text string, removed array<int>")
    def without(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, removed in batches:
            whole = texts.tolist()
            places, lines_ = [], []
            for i, asked in enumerate(removed):
                if asked is not None and len(asked):
                    held = whole[i].split("\n")
                    own = [(g["number"], g["line"]) for g in asked if g["number"] < len(held)]
                    places += [(i, number, line) for number, line in own]
                    lines_ += [held[number] for number, _ in own]
            numbers: list[list[int]] = [[] for _ in whole]
            for (i, number, line), found in zip(places, line_hashes(lines_), strict=True):
                if found == line:
                    numbers[i].append(number)
            out = []
            for text, own in zip(whole, numbers, strict=True):
                if own:
                    drop = set(own)
                    text = "\n".join(line for i, line in enumerate(text.split("\n")) if i not in drop)
                out.append((text, own) if own else (None, None))
            yield pd.DataFrame(out, columns=["text", "removed"])

    # Texts that no line may leave are not sent.
    return without(F.when(F.col("_removed").isNotNull(), whole_text()), F.col("_removed"))


def _joined(docs: DataFrame) -> DataFrame:
    """The documents with `_without`(text, lines, removed), what stays of them."""
    gone = materialize(removed_lines(docs), "line-removed").select(F.col("doc").alias("_doc"), F.col("removed").alias("_removed"))
    joined = docs.join(gone, F.coalesce("doc_id", F.lit(FIRST)) == F.col("_doc"), "left").withColumn("_left", _without())
    newlines = F.octet_length(whole_text()) - F.octet_length(F.replace(whole_text(), F.lit("\n"), F.lit("")))
    return joined.withColumn(
        "_without",
        F.struct(
            F.coalesce("_left.text", whole_text()).alias("text"),
            (newlines + 1).alias("lines"),
            F.coalesce("_left.removed", F.array().cast("array<int>")).alias("removed"),
        ),
    )


def deduplicate_lines(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_lines, n_removed, removed, text; a row per document.

    `removed` holds the line numbers (from 0) that go, `text` is what stays.
    """
    return _joined(docs).select(
        "doc_id",
        F.col("_without.lines").alias("n_lines"),
        F.size("_without.removed").alias("n_removed"),
        F.col("_without.removed").alias("removed"),
        F.col("_without.text").alias("text"),
    )


def keep_first_lines(docs: DataFrame) -> DataFrame:
    """The documents with the text that stays and its n_chars; a null text stays null."""
    new = F.when(F.col("text").isNotNull(), F.col("_without.text"))
    changed = {"text": new} | ({"n_chars": F.length(new).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    joined = _joined(docs)
    return joined.select(*(changed[n].alias(n) if n in changed else joined[n] for n in docs.columns))
