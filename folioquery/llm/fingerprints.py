"""Document fingerprints from Lempel-Ziv phrases, compared by minimum hashes.

A text is parsed from the left into phrases, each the shortest piece that is not yet in the text's
dictionary. Texts that would compress each other share phrases, so the likeness of two phrase sets,
estimated by equal positions of their minimum-hash signatures, is likeness in the sense of
compression. Every document is also compared with its edited text, whose second half comes from the
next document by descending doc_id; for this the documents are dealt into ranges of doc_id once, and
the first document of a range also goes to the range before it.

Phrases are as long as they come: together they are no longer than the text, and the longest grows with its square root
at most. Null counts as the empty text, which has no phrase and a signature of its own. Equal texts have equal
fingerprints. Rows without doc_id come last; rows that share a doc_id are ordered by a hash of their
text. The document after the last is the first, so a single document is its own next. An empty
table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquery.llm.common import slices, text_bytes, whole_text

HASHES = 64
UNIT = 1_000_000  # characters of phrases hashed at a time
RANGE_BYTES = 8 << 20  # text per range of doc_ids
MOST_RANGES = 50_000
LAST = -(2**63)
BASE = np.uint64(0x9E3779B97F4A7C15)
_random = np.random.default_rng(9)
FACTORS = _random.integers(0, 2**31, HASHES, np.uint32) * np.uint32(2) + np.uint32(1)
OFFSETS = _random.integers(0, 2**32, HASHES, np.uint32)


def parse(text: str, known: set[str], open_: str, phrases: list[str]) -> str:
    """Append the phrases of `text`, which goes on from the unfinished phrase `open_`; what is unfinished now."""
    add, append = known.add, phrases.append
    for letter in text:
        open_ += letter
        if open_ not in known:
            add(open_)
            append(open_)
            open_ = ""
    return open_


def hashes(phrases: list[str]) -> np.ndarray:
    """A 32-bit hash of each phrase by its characters, the same on every machine."""
    sizes = np.fromiter(map(len, phrases), np.int64, len(phrases))
    codes = np.frombuffer("".join(phrases).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    ends = np.cumsum(sizes)
    place = np.arange(len(codes)) - np.repeat(ends - sizes, sizes)
    # Each character is mixed with its place in the phrase; sums modulo 2**64 don't overflow in numpy.
    mixed = (codes + np.uint64(1)) * BASE + place.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    total = np.add.reduceat(mixed, ends - sizes)
    total ^= total >> np.uint64(30)
    total *= np.uint64(0x94D049BB133111EB)
    return (total >> np.uint64(32)).astype(np.uint32)


def parts(phrases: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring phrases of at most 20,000 phrases and about UNIT characters."""
    for at in range(0, len(phrases), 20_000):
        for start, end in slices(phrases[at : at + 20_000], UNIT):
            yield at + start, at + end


def signature(phrases: list[str]) -> np.ndarray:
    """The low half of the least of each of the hash functions over all phrases."""
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for start, end in parts(phrases):
        own = hashes(phrases[start:end])
        least = np.minimum(least, (own[:, None] * FACTORS[None, :] + OFFSETS[None, :]).min(0))
    return (least & np.uint32(0xFFFF)).astype(">u2")


def both_signatures(text: str, donor: str) -> tuple[np.ndarray, np.ndarray, str]:
    """Signatures of a text and of its edited text, and the edited text; their common half is parsed once."""
    half = len(text) // 2
    head, tail, new = text[: len(text) - half], text[len(text) - half :], donor[:half]
    known: set[str] = set()
    phrases: list[str] = []
    open_ = parse(head, known, "", phrases)
    known_too, phrases_too = set(known), list(phrases)
    rest = parse(tail, known, open_, phrases)
    rest_too = parse(new, known_too, open_, phrases_too)
    own = signature(phrases + [rest] if rest else phrases)
    edited = signature(phrases_too + [rest_too] if rest_too else phrases_too)
    return own, edited, head + new


def text_signature(text: str) -> np.ndarray:
    phrases: list[str] = []
    rest = parse(text, set(), "", phrases)
    return signature(phrases + [rest] if rest else phrases)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def ranges(docs: DataFrame) -> list:
    """Upper ends of the ranges of doc_id, ascending; every one is the doc_id of a row."""
    wanted = min(max(1, -(-text_bytes(docs) // RANGE_BYTES)), MOST_RANGES)
    shares = [i / wanted for i in range(1, wanted)] + [1.0]
    key = F.coalesce("doc_id", F.lit(LAST))
    found = docs.agg(F.percentile_approx(key, shares, 10 * MOST_RANGES).alias("ends"), F.max(key).alias("top")).first()
    return sorted({*(found["ends"] or []), found["top"]} - {None})


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    doc_id is a number; a row per document.
    """
    ends = np.array(ranges(docs), np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(ends)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    @F.pandas_udf("array<struct<range:int,guest:boolean>>")
    def targets(keys: pd.Series) -> pd.Series:
        own = shared.value
        at = np.searchsorted(own, keys.to_numpy())
        # The row that opens a range also ends the range of the next higher ids; the very first ends the last.
        return pd.Series(
            [
                [{"range": i, "guest": False}] + [{"range": (i + 1) % len(own), "guest": True}] * bool(own[i] == k)
                for i, k in zip(at.tolist(), keys.tolist(), strict=True)
            ]
        )

    key = F.coalesce("doc_id", F.lit(LAST)).cast("long")
    rows = docs.select("doc_id", key.alias("key"), whole_text().alias("text"))
    rows = rows.select("*", F.explode(targets("key")).alias("to")).select("doc_id", "key", "text", "to.range", "to.guest")
    dealt = rows.repartition("range").sortWithinPartitions("range", "guest", F.desc("key"), F.xxhash64("text"))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = None  # range of the row that waits for its next
        text, doc_id, waiting = "", None, False
        result = None  # finished but for the likeness to the next document

        def full(row: list, next_signature: np.ndarray) -> list:
            own, edited = row[3], row[4]
            return [*row[:3], own.tobytes().hex(), edited.tobytes().hex(), likeness(own, edited), likeness(own, next_signature)]

        for batch in batches:
            done: list[list] = []
            ids = batch.column("doc_id")
            index = zip(*(batch.column(n).to_pylist() for n in ("range", "guest", "text")), strict=True)
            for i, (range_, guest, next_text) in enumerate(index):
                if range_ != here:
                    here, result, waiting = range_, None, False
                elif waiting:
                    own, edited, edited_text = both_signatures(text, next_text)
                    if result is not None:
                        done.append(full(result, own))
                    result = [doc_id, len(text), sha256(edited_text.encode()).hexdigest(), own, edited]
                if guest:
                    if waiting:
                        done.append(full(result, text_signature(next_text)))
                    waiting, result = False, None
                else:
                    text, doc_id, waiting = next_text, ids[i].as_py(), True
            if done:
                columns = list(zip(*done, strict=True))
                types = [ids.type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return dealt.mapInArrow(
        compare,
        f"doc_id {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )
