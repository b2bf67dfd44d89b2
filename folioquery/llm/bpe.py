"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Documents are cut into blocks. Each block gives its distinct pre-tokens, dealt out by a hash of the
word: all blocks' requests for a word meet in one partition, which encodes it once and answers
every block. The answers join the documents of the block, and the ids of a text are put together by
the position of its pre-tokens. Decoding looks the ids up in the token-byte table, which has as
many rows as the vocabulary and is sent to the tasks. Requests and answers are packed, so a frequent word is one entry
of each block, whatever its count, and routed in rounds (`routing`), so that their rows grow with the corpus and not its square.

The documents are read twice, so rows that do not come straight from files are written first: both reads must see the
same blocks. Pre-tokens are split as the libraries split them (`token_counts.odd_characters`).

Null counts as the empty text, which has no ids. Repeated rows and copies are encoded like others;
equal texts give equal results. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from folioquery.llm.common import blocks, pack_documents, stable, text_bytes, unsqueeze
from folioquery.llm.routing import ANSWER, REQUEST, answer_row, answered, homeward, outward, request_row, ways
from folioquery.llm.token_counts import Splitter, odd_characters, pre_tokens

SHARE_BYTES = 8 << 20  # text per share of the words


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


def token_bytes(path: str) -> list[bytes]:
    """The token-byte table, by id."""
    ranks = ranks_of(path)
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def encoder(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks_of(path), special_tokens={})


def word_key(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode())


def split_words(words: list[str], n: int) -> dict[int, list[str]]:
    dealt: dict[int, list[str]] = {}
    for word in words:
        dealt.setdefault(word_key(word) % n, []).append(word)
    return dealt


def word_requests(docs: DataFrame, pattern: str, odd: str, each: int) -> DataFrame:
    """(way, origin, crate): the distinct words of each block, in order, by their key modulo `each`."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(pattern, odd)
        for block, _, texts in blocks(batches):
            distinct: set[str] = set()
            for text in texts:
                for chunk in pre_tokens(splitter.of(text), text):
                    distinct.update(chunk)
            for way, own in split_words(sorted(distinct), each).items():
                yield request_row(way, block, own)

    return docs.select("doc_id", "text").mapInArrow(ask, REQUEST)


def encode_requests(requests: DataFrame, ranks: str, pattern: str, shares: int, levels: int) -> DataFrame:
    """(origin, crate): each distinct word of a share is encoded once; words come back with the numbers and run of their ids."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks, pattern).encode_ordinary
        share, known = None, {}

        def ids(words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
            for word in words:
                if word not in known:
                    known[word] = np.array(encode(word), np.uint32)
            found = [known[w] for w in words]
            return words, np.array([len(x) for x in found], np.uint32), np.concatenate(found)

        for batch in batches:
            for own, origin, crate in zip(*(batch.column(n).to_pylist() for n in ("way", "origin", "crate")), strict=True):
                if own != share:  # sorted by share: the words of one share are held at a time
                    share = own
                    known.clear()
                yield answer_row(origin, answered(unsqueeze(crate), levels, ids))

    return requests.repartition(shares, "way").sortWithinPartitions("way").mapInArrow(answer, ANSWER)


def encode_and_decode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_tokens, ids_sha256, decoded_sha256; a row per document.

    `ranks` is a rank file that every executor can read.
    """

    def written(ids: np.ndarray, table: list[bytes]) -> tuple[str, bytes]:
        found = ids.tolist()
        return " ".join(map(str, found)), b"".join(map(table.__getitem__, found))

    def digest(parts: Iterator[list[tuple[str, bytes]]]) -> tuple[int, str, str]:
        n, ids_sha, decoded_sha = 0, sha256(), sha256()
        for words in parts:
            line = " ".join([w[0] for w in words])
            ids_sha.update((" " + line if n else line).encode())
            decoded_sha.update(b"".join([w[1] for w in words]))
            n += line.count(" ") + 1
        return n, ids_sha.hexdigest(), decoded_sha.hexdigest()

    columns = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _assemble(docs, ranks, pattern, written, digest, columns, [pa.int64(), pa.string(), pa.string()])


def encode_texts(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, ids array<int>, decoded BINARY; the ids and the bytes they stand for."""

    def decoded(ids: np.ndarray, table: list[bytes]) -> tuple[list[int], bytes]:
        found = ids.tolist()
        return found, b"".join(map(table.__getitem__, found))

    def whole(parts: Iterator[list[tuple[list[int], bytes]]]) -> tuple[list[int], bytes]:
        words = [w for part in parts for w in part]
        return [i for w in words for i in w[0]], b"".join([w[1] for w in words])

    return _assemble(docs, ranks, pattern, decoded, whole, "ids array<int>, decoded binary", [pa.list_(pa.int32()), pa.binary()])


def _assemble(
    docs: DataFrame, ranks: str, pattern: str, decode: Callable, finish: Callable, columns: str, types: list[pa.DataType]
) -> DataFrame:
    """`decode` takes the ids of a distinct word and the token-byte table, once for each block; `finish`
    turns what it gave for the words of a text, in their order and in parts, into the result columns."""
    spark = docs.sparkSession
    id_field = docs.schema["doc_id"].dataType
    names = ["doc_id", *(c.split(" ")[0] for c in columns.split(", "))]
    docs, odd = stable(docs.select("doc_id", "text")), odd_characters()
    each, levels = ways(max(1, -(-text_bytes(docs) // SHARE_BYTES)))
    shares = each**levels
    asked = outward(word_requests(docs, pattern, odd, each), each, levels, split_words)
    answers = homeward(encode_requests(asked, ranks, pattern, shares, levels), each, levels)
    # The table has one row per token of the vocabulary.
    shared = spark.sparkContext.broadcast(token_bytes(ranks))
    rows = pack_documents(docs).select("block", "docs", F.lit(None).cast("binary").alias("crate"))
    rows = rows.unionByName(answers.select(F.col("origin").alias("block"), F.lit(None).cast("binary").alias("docs"), "crate"))
    # Answers come before the documents of their block. Nothing is grouped: a task holds one block.
    dealt = rows.repartition(shares, "block").sortWithinPartitions("block", F.col("docs").isNotNull())

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, table, id_type = Splitter(pattern, odd), shared.value, to_arrow_type(id_field)
        current, codes = None, {}
        for batch in batches:
            for block, packed, crate in zip(*(batch.column(n).to_pylist() for n in ("block", "docs", "crate")), strict=True):
                if block != current:
                    current, codes = block, {}
                if packed is None:
                    for words, sizes, flat in unsqueeze(crate):
                        start = 0
                        for word, end in zip(words, np.cumsum(sizes).tolist(), strict=True):
                            codes[word] = decode(flat[start:end], table)
                            start = end
                    continue
                doc_ids, texts = unsqueeze(packed)
                done, held, out = 0, 0, []
                for i, text in enumerate(texts):
                    parts = ([codes[w] for w in chunk] for chunk in pre_tokens(splitter.of(text), text) if chunk)
                    try:
                        out.append(finish(parts))
                    except KeyError as word:
                        raise RuntimeError(f"no answer for {word} in block {block}: the input changed between two reads") from word
                    held += len(text)
                    if held > 4_000_000 or i == len(texts) - 1:
                        results = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(doc_ids[done : i + 1], id_type), *results], names)
                        done, held, out = i + 1, 0, []

    return dealt.mapInArrow(assemble, f"doc_id {id_field.simpleString()}, {columns}")
