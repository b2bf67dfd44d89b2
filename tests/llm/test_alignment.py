"""Alignment against a plain version over byte offsets, and the quick encoder against the library."""

from collections import Counter, defaultdict
from hashlib import sha256

import pytest
import sentencepiece
from tokenizers import Tokenizer

from folioquery.llm import alignment
from folioquery.llm.queries import PATTERN, PIECES, QUERIES, RANKS, TOKENIZER
from folioquery.llm.token_counts import byte_letters


@pytest.fixture(scope="module")
def encoders():
    first = Tokenizer.from_file(TOKENIZER)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    byte_of = {c: b for b, c in enumerate(byte_letters())}

    def one(text):
        ids = first.encode(" " + text, add_special_tokens=False).ids
        return ids, [bytes(byte_of[c] for c in first.id_to_token(i)) for i in ids]

    def two(text):
        ids = second.encode(text)
        names = [second.id_to_piece(i) for i in ids]
        return ids, [bytes([int(n[3:5], 16)]) if second.is_byte(i) else n.replace("▁", " ").encode() for i, n in zip(ids, names, strict=True)]

    return one, two


def plain(rows, encoders):
    """Rows of the operator, group by group in plain Python."""
    documents = []
    for doc_id, text in rows:
        (ids_a, a), (ids_b, b) = (e(text or "") for e in encoders)
        want = b" " + (text or "").encode()
        if not text or b"".join(a) != want or b"".join(b) != want:
            documents.append((doc_id, None, None, None))
            continue
        ends = []
        for tokens in (a, b):
            at, own = 0, []
            for t in tokens:
                at += len(t)
                own.append(at)
            ends.append(own)
        groups, i, j = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            x, y = [], []
            while i < len(a) and ends[0][i] <= end:
                x.append(ids_a[i])
                i += 1
            while j < len(b) and ends[1][j] <= end:
                y.append(ids_b[j])
                j += 1
            groups.append((x, y))
        documents.append((doc_id, ids_a, ids_b, groups))
    counts = Counter()
    for *_, groups in documents:
        counts.update({(x, y) for xs, ys in groups or [] for x in xs for y in ys})
    highest = defaultdict(int)
    for (x, _), n in counts.items():
        highest[x] = max(highest[x], n)
    out = []
    for doc_id, ids_a, ids_b, groups in documents:
        if groups is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x, y) for xs, ys in groups for x in xs for y in ys]
        written = ";".join(f"{','.join(map(str, xs))}|{','.join(map(str, ys))}" for xs, ys in groups)
        best = sum(counts[p] == highest[p[0]] for p in links)
        out.append((doc_id, len(ids_a), len(ids_b), len(groups), len(links), best, sum(counts[p] for p in links), sha256(written.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def align(docs):
    return alignment.align_documents(docs, TOKENIZER, RANKS, PATTERN, PIECES)


MORE = [(50, "a▁b"), (51, "xyzzy" * 300), (52, "日本語の長い文章です。" * 40), (53, "\u0000nul"), (54, "  two  spaces "), (55, "0123456789" * 30), (56, "== ++ --" * 50)]


def test_alignment_equals_the_plain_version(frame, rows, encoders):
    both = [*rows, *MORE]
    assert rows_of(align(frame(both).repartition(3))) == plain(both, encoders)


def test_small_blocks_and_wide_groups(frame, rows, encoders, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_PAIRS", 1)
    monkeypatch.setattr(alignment, "PRODUCT", 1)
    monkeypatch.setattr(alignment, "SLICE", 10)
    both = [*[r for r in rows if r[1] is None or len(r[1]) < 10_000], *MORE]
    assert rows_of(align(frame(both).repartition(2))) == plain(both, encoders)


def test_query(spark, data, corpus, encoders):
    assert rows_of(QUERIES["op12_alignment"](spark, data)) == plain(corpus.items(), encoders)


def test_empty_table(empty):
    assert align(empty).collect() == []


def test_quick_encoder_equals_the_library():
    """Every code point that the quick way takes, in the places where classes of characters decide."""
    own = alignment.byte_level(TOKENIZER, RANKS, PATTERN)
    library = Tokenizer.from_file(TOKENIZER)
    library.encode_special_tokens = True
    texts = [f"a{c}a {c}1{c}{c} .{c}." for c in map(chr, range(0x250))] + ["<|endoftext|> x<|endoftext|>"]
    assert not any(alignment.OTHER_SCRIPT.search(t) for t in texts)
    assert own.encode(texts) == [e.ids for e in library.encode_batch([" " + t for t in texts], add_special_tokens=False)]


def test_overlaps_are_found_from_both_sides():
    import numpy as np

    at, doc = np.array([0, 2, 5, 9]), np.array([0, 0, 1, 1])
    other, other_doc = np.array([0, 1, 5, 6, 8]), np.array([0, 0, 1, 1, 1])
    assert alignment.covering(at, doc, other, other_doc).tolist() == [0, 1, 2, 4]
    assert alignment.covering(other, other_doc, at, doc).tolist() == [0, 0, 2, 2, 2]
