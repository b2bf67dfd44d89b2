"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Every text is encoded by both tokenizers. In a batch of documents the token starts of either side find the
covering token of the other by an as-of merge keyed by document; the union of both directions is all
overlaps. Where tokens of both sides end at the same byte, a group ends. In a group with one token on either side
the links are its overlaps, in the others every token of one side is linked with every one of the other; large groups
are linked by their distinct ids with counts, so a long group never becomes all its pairs of places.

How many documents hold a pair of ids linked is counted over the corpus. Batches are gathered into blocks that are
written once; a block asks for its distinct pairs with plain (pair, block) rows, which are summed by pair
before they meet, joined with the totals and given back to the block. No table of pairs is ever broadcast: only
the highest count of each id of the first vocabulary is, a row per vocabulary entry at most.

Texts that are null, empty, or that the tokens of either side do not give back byte by byte have no tokens: zeros and
an empty groups_sha256. Rows that share a doc_id are documents of their own, and each counts. Equal texts have equal rows.
A text is encoded whole, whatever its length, and a block holds one text at least. An empty table gives no
rows. Only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from folioquery.llm.common import slices, squeeze, unsqueeze
from folioquery.llm.token_counts import byte_letters
from folioquery.session import materialize

BLOCK_PAIRS = 2_000_000  # pairs of documents that a block gathers
SLICE = 400_000  # characters aligned at a time
PRODUCT = 1 << 12  # pairs of places of a group, above which its distinct ids are paired
OTHER_SCRIPT = re.compile(r"[^\x00-ɏ]")
PIECE_SPACE = "▁"
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


@dataclass
class Side:
    """A tokenizer: texts to ids, the bytes of every id, and its written ids before each separator."""

    encode: Callable[[list[str]], list[list[int]]]
    token: list[bytes]
    written: list[str]  # of id i: [2 * i] inside a group, [2 * i + 1] at its end
    size: np.ndarray


def side(encode: Callable, token: list[bytes], end: str) -> Side:
    written = [text for i in range(len(token)) for text in (f"{i},", f"{i}{end}")]
    return Side(encode, token, written, np.array([len(t) for t in token], np.int64))


def byte_level(tokenizer: str, ranks: str, pattern: str) -> Side:
    """Byte-level BPE of a tokenizers file. The rank file of the same vocabulary gives the same ids for Latin
    texts in a quarter of the time; all others go through the library of the file. Special strings are text."""
    import tiktoken
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer)
    library.encode_special_tokens = True
    with open(ranks, "rb") as file:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
    quick = tiktoken.Encoding("aligned", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    byte_of = {letter: byte for byte, letter in enumerate(byte_letters())}

    def encode(texts: list[str]) -> list[list[int]]:
        other = [i for i, t in enumerate(texts) if OTHER_SCRIPT.search(t)]
        found = dict(zip(other, library.encode_batch_fast([f" {texts[i]}" for i in other], add_special_tokens=False), strict=True))
        return [found[i].ids if i in found else quick.encode_ordinary(f" {t}") for i, t in enumerate(texts)]

    tokens = [library.id_to_token(i) or "" for i in range(library.get_vocab_size())]
    return side(encode, [bytes(byte_of.get(c, 0) for c in t) for t in tokens], "|")


def pieces(model: str) -> Side:
    """A sentencepiece model, which puts the space before the text itself."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model)
    names = [library.id_to_piece(i) for i in range(library.vocab_size())]
    tokens = [
        bytes([int(found[1], 16)]) if (found := BYTE_PIECE.fullmatch(name)) else name.replace(PIECE_SPACE, " ").encode() for name in names
    ]
    return side(lambda texts: library.encode(texts, num_threads=1), tokens, ";")


def token_ids(own: Side, texts: list[str]) -> list[list[int]]:
    """Ids of the texts; none where their bytes are not the text after a space."""
    out = own.encode(texts)
    joined = own.token.__getitem__
    return [ids if b"".join(map(joined, ids)) == f" {text}".encode("utf-8", "surrogatepass") else [] for ids, text in zip(out, texts, strict=True)]


@dataclass
class Aligned:
    """Documents of a slice: token and group numbers, and their distinct pairs with the number of links."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups_sha256: list[str]
    doc: np.ndarray  # of each pair
    pair: np.ndarray  # id of the first * vocabulary of the second + id of the second
    links: np.ndarray


def covering(at: np.ndarray, doc: np.ndarray, other: np.ndarray, other_doc: np.ndarray) -> np.ndarray:
    """Row of the other side whose token covers each start: the last one of the document that starts there or before."""
    left = pd.DataFrame({"at": at, "doc": doc})
    right = pd.DataFrame({"at": other, "doc": other_doc, "row": np.arange(len(other))})
    return pd.merge_asof(left, right, on="at", by="doc")["row"].to_numpy()


def align(texts: list[str], a: Side, b: Side) -> Aligned:
    """Align the tokens of all texts at once; documents lie one after the other on one line of bytes."""
    ids_a, ids_b = token_ids(a, texts), token_ids(b, texts)
    for i, (x, y) in enumerate(zip(ids_a, ids_b, strict=True)):
        if not x or not y or not texts[i]:
            ids_a[i] = ids_b[i] = []
    n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(ids)) for ids in (ids_a, ids_b))
    flat_a, flat_b = (np.fromiter((i for own in ids for i in own), np.int64, int(n.sum())) for ids, n in ((ids_a, n_a), (ids_b, n_b)))
    doc_a, doc_b = (np.repeat(np.arange(len(texts)), n) for n in (n_a, n_b))
    if not len(flat_a):
        none = np.zeros(0, np.int64)
        return Aligned(n_a, n_b, n_a, n_a, [""] * len(texts), none, none, none)
    # Both sides give the same bytes, so their lines have the same places.
    end_a, end_b = np.cumsum(a.size[flat_a]), np.cumsum(b.size[flat_b])
    start_a, start_b = end_a - a.size[flat_a], end_b - b.size[flat_b]
    ends = np.minimum(np.searchsorted(end_b, end_a), len(end_b) - 1)
    common = end_b[ends] == end_a
    common_b = np.zeros(len(end_b), bool)
    common_b[ends[common]] = True
    group_a, group_b = np.cumsum(common) - common, np.cumsum(common_b) - common_b
    in_a, in_b = np.bincount(group_a), np.bincount(group_b)
    doc = doc_a[common]  # of each group
    n_groups = np.bincount(doc, minlength=len(texts))
    n_links = np.bincount(doc, in_a * in_b, len(texts)).astype(np.int64)

    simple = (in_a == 1) | (in_b == 1)
    cover_a, cover_b = covering(start_a, doc_a, start_b, doc_b), covering(start_b, doc_b, start_a, doc_a)
    first = np.flatnonzero(simple[group_a])
    second = np.flatnonzero(simple[group_b] & (start_a[cover_b] != start_b))  # equal starts are found from both sides
    links = [
        (doc_a[first], flat_a[first], flat_b[cover_a[first]], np.ones(len(first), np.int64)),
        (doc_b[second], flat_a[cover_b[second]], flat_b[second], np.ones(len(second), np.int64)),
    ]
    first_b = np.cumsum(in_b) - in_b
    wide = in_a * in_b > PRODUCT
    whole = np.flatnonzero((~simple & ~wide)[group_a])
    times = in_b[group_a[whole]]
    place = np.repeat(first_b[group_a[whole]], times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    links.append((np.repeat(doc_a[whole], times), np.repeat(flat_a[whole], times), flat_b[place], np.ones(len(place), np.int64)))
    first_a = np.cumsum(in_a) - in_a
    for g in np.flatnonzero(~simple & wide):
        x, many = np.unique(flat_a[first_a[g] : first_a[g] + in_a[g]], return_counts=True)
        y, more = np.unique(flat_b[first_b[g] : first_b[g] + in_b[g]], return_counts=True)
        n = len(x) * len(y)
        links.append((np.full(n, doc[g]), np.repeat(x, len(y)), np.tile(y, len(x)), np.outer(many, more).ravel()))
    doc_of, x, y, count = (np.concatenate(c) for c in zip(*links, strict=True))
    # One number for document and pair; a slice has few documents.
    vocabulary = len(a.token) * len(b.token)
    key, inverse = np.unique(doc_of * vocabulary + x * len(b.token) + y, return_inverse=True)
    total = np.bincount(inverse, count).astype(np.int64)

    # Written tokens in the order of the groups: those of the first side, then those of the second.
    written = a.written + b.written
    codes = np.empty(len(flat_a) + len(flat_b), np.int64)
    codes[np.arange(len(flat_a)) + first_b[group_a]] = 2 * flat_a + common
    codes[np.arange(len(flat_b)) + (first_a + in_a)[group_b]] = len(a.written) + 2 * flat_b + common_b
    edges = np.r_[0, np.cumsum(n_a + n_b)]
    text_of = written.__getitem__
    hashes = ["" if s == e else sha256("".join(map(text_of, codes[s:e].tolist()))[:-1].encode()).hexdigest() for s, e in pairwise(edges.tolist())]
    return Aligned(n_a, n_b, n_groups, n_links, hashes, key // vocabulary, key % vocabulary, total)


def aligned_blocks(docs: DataFrame, sides: Callable[[], tuple[Side, Side]]) -> DataFrame:
    """(block, pairs, holders, docs BINARY): blocks of documents with their distinct pairs and how many hold each."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides()
        task = TaskContext.get().partitionId() << 32
        ids: list = []
        parts: list[Aligned] = []
        held = 0

        def block() -> pa.RecordBatch:
            nonlocal task
            doc = np.concatenate([p.doc + before for p, before in zip(parts, np.cumsum([0] + [len(p.n_a) for p in parts[:-1]]), strict=True)])
            pair, place = np.unique(np.concatenate([p.pair for p in parts]), return_inverse=True)
            numbers = [np.concatenate([getattr(p, n) for p in parts]) for n in ("n_a", "n_b", "n_groups", "n_links")]
            hashes = [h for p in parts for h in p.groups_sha256]
            links = np.concatenate([p.links for p in parts])
            packed = squeeze((ids, numbers, hashes, np.bincount(doc, minlength=len(ids)), place.astype(np.uint32), links.astype(np.uint32 if links.max(initial=0) < 2**32 else np.int64)))
            holders = np.bincount(place, minlength=len(pair)).astype(np.int32)
            task += 1
            columns = [pa.array([task], pa.int64()), pa.array([pair], pa.list_(pa.int64())), pa.array([holders], pa.list_(pa.int32())), pa.array([packed], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["block", "pairs", "holders", "docs"])

        for batch in batches:
            own = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for start, end in slices(texts, SLICE):
                part = align(texts[start:end], a, b)
                ids += own[start:end]
                parts.append(part)
                held += len(part.pair) + end - start
                if held >= BLOCK_PAIRS:
                    yield block()
                    ids, parts, held = [], [], 0
        if parts:
            yield block()

    return docs.select("doc_id", "text").mapInArrow(gather, "block long, pairs array<long>, holders array<int>, docs binary")


def pair_counts(blocks: DataFrame, vocabulary: int) -> DataFrame:
    """(pair, n, best): documents of the corpus that hold a pair, and whether no pair of its first id has more."""
    pairs = blocks.select(F.explode(F.arrays_zip("pairs", "holders")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.holders").alias("n"))
    counts = materialize(pairs.groupBy("pair").agg(F.sum("n").alias("n")), "align-counts")
    first = F.floor(F.col("pair") / vocabulary)
    highest = counts.groupBy(first.alias("id")).agg(F.max("n").alias("highest"))  # a row per id of the vocabulary
    return counts.join(F.broadcast(highest), first == F.col("id")).select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def align_documents(docs: DataFrame, tokenizer: str, ranks: str, pattern: str, model: str) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; a row per document.

    `tokenizer` (byte-level BPE, with the `ranks` and splitting `pattern` of the same vocabulary) and `model`
    (sentencepiece) are files that every executor can read.
    """
    id_field = docs.schema["doc_id"].dataType
    vocabulary = len(pieces(model).token)
    blocks = materialize(aligned_blocks(docs, lambda: (byte_level(tokenizer, ranks, pattern), pieces(model))), "align-blocks")
    asked = blocks.select("block", F.posexplode("pairs").alias("place", "pair"))
    # Count and mark of a pair in one number; the pairs of one block, in their order, are a bounded list.
    answer = F.struct("place", (F.col("n") * 2 + F.col("best").cast("int")).alias("answer"))
    known = asked.join(pair_counts(blocks, vocabulary), "pair").groupBy("block").agg(F.collect_list(answer).alias("answers"))
    whole = blocks.select("block", "docs").join(known.select("block", F.array_sort("answers")["answer"].alias("answers")), "block", "left")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed, own in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, numbers, hashes, sizes, place, links = unsqueeze(packed)
                answers = own.values.to_numpy() if own.is_valid else np.zeros(0, np.int64)
                found, links = answers[place], links.astype(np.int64)
                edges = np.r_[0, np.cumsum(sizes)]
                sums = [np.r_[0, np.cumsum(c)] for c in (links * (found & 1), links * (found >> 1))]
                values = [*numbers, *(s[edges[1:]] - s[edges[:-1]] for s in sums)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, to_arrow_type(id_field)), *(pa.array(v, pa.int64()) for v in values), pa.array(hashes, pa.string())], names
                )

    schema = f"doc_id {id_field.simpleString()}, " + ", ".join(f"{n} long" for n in names[1:-1]) + ", groups_sha256 string"
    return whole.select("docs", "answers").mapInArrow(finish, schema)
