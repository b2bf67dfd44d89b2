"""Token counts, the BPE round trip and packing against the libraries themselves."""

import base64
from hashlib import sha256
from time import process_time
from zlib import crc32

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql.functions import rand
from tokenizers import Tokenizer

from folioquery.llm import bpe, packing, token_counts
from folioquery.llm.queries import PATTERN, QUERIES, RANKS, TOKENIZER


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def ranks():
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def counts_of(library, rows):
    return sorted(
        (i is None, i or 0, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512)
        for i, t in rows
    )


def test_counts_equal_the_library(docs, rows, library):
    got = token_counts.token_counts(docs, TOKENIZER, PATTERN).collect()
    assert sorted((r[0] is None, r[0] or 0, *r[1:]) for r in got) == counts_of(library, rows)


def test_counts_query(spark, data, corpus, library):
    got = QUERIES["op2_token_counts"](spark, data).collect()
    assert sorted((False, *r) for r in got) == counts_of(library, corpus.items())


def test_merging_takes_overlapping_places_in_turn(library):
    merger, specials = token_counts.load(TOKENIZER)
    words = ["a" * n for n in range(1, 40)] + ["=" * 70, "abababab", "ßßß", "\n\n\n"]
    want = [len(library.encode(w, add_special_tokens=False).ids) for w in words]
    assert merger.counts([w.encode() for w in words]).tolist() == want
    assert specials == ("<|endoftext|>",)
    assert len(merger.counts([])) == 0


def test_long_pre_tokens(library, monkeypatch):
    """Places kept by rank give what passes over all symbols give, and what the library gives."""
    rng = np.random.default_rng(5)
    merger, _ = token_counts.load(TOKENIZER)
    letters = np.array(list("etaoinshrdlucmfwypvbgkjqxz"))
    words = ["".join(letters[(rng.random(n) ** 2 * 26).astype(int)]) for n in (1, 2, 3, 50, 400, 2500, 9000)]
    words += ["a" * n for n in (1, 2, 3, 2001, 4096)] + ["ab" * 1500, "日本語" * 900, "=" * 3000, "aab" * 999 + "a"]
    plain = [w.encode() for w in words]
    want = [len(library.encode(w, add_special_tokens=False).ids) for w in words]
    assert merger.counts(plain).tolist() == want
    monkeypatch.setattr(token_counts, "LONG_WORD", 1)
    assert merger.counts(plain).tolist() == want
    monkeypatch.setattr(token_counts, "LONG_WORD", 1 << 40)
    assert merger.counts(plain[:6] + plain[7:]).tolist() == want[:6] + want[7:]


def test_a_pre_token_of_a_megabyte_takes_seconds(library):
    rng = np.random.default_rng(6)
    word = "".join(np.array(list("abcdefghijklmnopqrstuvwxyz"))[rng.integers(0, 26, 1_000_000)])
    merger, _ = token_counts.load(TOKENIZER)
    start = process_time()
    found = merger.counts([word.encode()]).tolist()
    assert process_time() - start < 60
    assert found == [len(library.encode(word, add_special_tokens=False).ids)]


def test_long_texts_are_counted_in_chunks(library, monkeypatch):
    monkeypatch.setattr(token_counts, "CHUNK", 50)
    text = "it's a long-ish text,  with   blanks\n\n and more " * 20
    splitter = token_counts.Splitter(PATTERN, token_counts.odd_characters())
    got = token_counts.count_tokens([text], token_counts.load(TOKENIZER), splitter, {})
    assert got == [len(library.encode(text, add_special_tokens=False).ids)]


def digests(ranks, text):
    ids = ranks.encode_ordinary(text or "")
    assert ranks.decode_bytes(ids) == (text or "").encode()
    return len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256((text or "").encode()).hexdigest()


def test_bpe_equals_the_library(docs, rows, ranks):
    got = bpe.encode_and_decode(docs, RANKS, PATTERN).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(key, got)) == sorted(key((i, *digests(ranks, t))) for i, t in rows)


def test_bpe_query_and_small_blocks(spark, data, corpus, ranks):
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op5_bpe_roundtrip"](spark, data).collect()}
    assert got == {i: digests(ranks, t) for i, t in corpus.items()}


def test_bpe_gives_ids_and_bytes(frame, ranks):
    row = bpe.encode_texts(frame([(1, "hello  wörld")]), RANKS, PATTERN).first()
    assert row["ids"] == ranks.encode_ordinary("hello  wörld") and bytes(row["decoded"]) == "hello  wörld".encode()


def check_packing(pieces, rows, library, capacity):
    """Every piece has its ids, sequences are gapless and within capacity; the number of sequences."""
    by_doc = {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append(r)
    wanted = {}
    for i, t in rows:
        wanted.setdefault(i, []).append([*library.encode(t or "", add_special_tokens=False).ids, 0])
    assert set(by_doc) == set(wanted)
    for i, lists in wanted.items():
        found = sorted(by_doc[i], key=lambda r: r["piece"])
        assert sum(r["length"] for r in found) == sum(map(len, lists))
        ids = lists[0]
        if len(lists) == 1:
            assert [r["piece"] for r in found] == list(range(-(-len(ids) // capacity)))
            assert all(r["length"] == capacity for r in found[1:])
            for r in found:
                part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
                assert r["ids_crc32"] == crc32(part.tobytes())
    sequences = {}
    for r in pieces:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing(docs, rows, library):
    got = packing.pack_sequences(docs, TOKENIZER, RANKS, PATTERN).collect()
    check_packing(got, rows, library, 2048)
    small = packing.pack_sequences(docs, TOKENIZER, RANKS, PATTERN, capacity=64).collect()
    check_packing(small, rows, library, 64)


def test_packing_query_is_near_the_bound(spark, data, corpus, library):
    got = QUERIES["op8_packing"](spark, data).collect()
    used = check_packing(got, corpus.items(), library, 2048)
    assert used <= 1.01 * -(-sum(r["length"] for r in got) // 2048) + 1


@pytest.mark.parametrize("histogram", [{}, {5: 3}, {2048: 4}, {1: 5000}, {1025: 10}, {1024: 7, 1030: 3, 1018: 3}, {700: 100, 650: 90, 640: 80, 8: 500}])
def test_plan_places_every_piece_once(histogram):
    runs = packing.plan(histogram)
    placed = {}
    for content, count in runs:
        assert sum(content) <= 2048 and count > 0
        for length in content:
            placed[length] = placed.get(length, 0) + count
    assert placed == histogram


def test_plan_uses_full_patterns():
    runs = packing.plan({1500: 1000, 548: 1000, 1024: 500, 400: 10})
    assert sum(c for _, c in runs) <= 1250 + 2


def test_empty_tables(empty):
    assert token_counts.token_counts(empty, TOKENIZER, PATTERN).collect() == []
    assert bpe.encode_and_decode(empty, RANKS, PATTERN).collect() == []
    assert packing.pack_sequences(empty, TOKENIZER, RANKS, PATTERN).collect() == []


def test_every_code_point_is_split_as_the_libraries_split_it(spark, library, ranks):
    """Places where the class of a character decides; the two libraries and the pattern have tables of their own."""
    characters = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0x30000, 0x110000, 251)]
    texts = ["".join(f"a{c}a {c}1{c}{c} .{c}." for c in characters[i : i + 25]) for i in range(0, len(characters), 25)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, TOKENIZER, PATTERN).collect()}
    want = {i: len(e.ids) for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False))}
    assert got == want
    got = {r["doc_id"]: r["ids_sha256"] for r in bpe.encode_and_decode(docs, RANKS, PATTERN).select("doc_id", "ids_sha256").collect()}
    assert got == {i: digests(ranks, t)[1] for i, t in enumerate(texts)}


def test_rows_in_another_order_at_every_read(frame, rows, ranks):
    """Rows from a shuffle may come in another order each time they are read."""
    docs = frame(rows).orderBy(rand())
    got = bpe.encode_and_decode(docs, RANKS, PATTERN).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(key, got)) == sorted(key((i, *digests(ranks, t))) for i, t in rows)
