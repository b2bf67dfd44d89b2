"""Exact dedup, line dedup, SimHash classes, fingerprints and shards against brute force."""

import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
import xxhash

from check import connect, normalized
from folioquery.llm import exact_dedup, fingerprints, line_dedup, sharding, simhash
from folioquery.llm.queries import QUERIES, SQL


def low(i):
    return (i is not None, i or 0)


def exact_model(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out, seen = [], set()
    for i, t in rows:
        keep = max(groups[t or ""], key=low)
        first = i == keep and (t or "") not in seen
        if i == keep:
            seen.add(t or "")
        out.append((*low(i), *low(keep), len(groups[t or ""]), first, sha256((t or "").encode()).hexdigest()))
    return sorted(out)


def flat(got):
    return sorted((*low(r["doc_id"]), *low(r["keep_id"]), r["group_size"], r["kept"], r["text_sha256"]) for r in got)


@pytest.mark.parametrize("settings", [{}, {"primes": (2, 3)}, {"huge": 100}, {"huge": 100, "chunk": 7}])
def test_exact_duplicates(docs, rows, settings):
    """Also where nearly all fingerprints collide, and where texts are cut into many chunks."""
    assert flat(exact_dedup.exact_duplicates(docs, **settings).collect()) == exact_model(rows)


def test_chunks_combine(monkeypatch):
    data = bytes(range(256)) * 5
    for prime in exact_dedup.PRIMES:
        whole = exact_dedup.chunk_hashes([data], prime)[0]
        parts = [data[:300], b"", data[300:777], data[777:]]
        hashes = exact_dedup.chunk_hashes(parts, prime)
        after = [len(data) - 300, len(data) - 300, len(data) - 777, 0]
        assert sum(exact_dedup.combine(prime, h, a) for h, a in zip(hashes, after)) % prime == whole


def test_exact_query_equals_sql(spark, data):
    got = QUERIES["op4_exact_dedup"](spark, data).toPandas()
    assert normalized(got) == normalized(connect(data).execute(SQL["op4_exact_dedup"]).df())


def test_copies_that_stay(docs, rows):
    kept = exact_dedup.keep_first_of_copies(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({t or "" for _, t in rows})


def shards_of(got, rows, shards=16):
    assert Counter((*low(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == Counter(
        (*low(i), len((t or "").encode()) + 1, crc32((t or "").encode())) for i, t in rows
    )
    by = {}
    for r in got:
        assert r["law"] == "bytes" and r["grown_shard"] is None
        by.setdefault(r["shard"], []).append(r)
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    assert set(by) <= set(range(shards))
    return {s: sum(r["size"] for r in own) for s, own in by.items()}


def test_shards(docs, rows):
    got = sharding.shard_by_bytes(docs).collect()
    shards_of(got, rows)
    copies = {r["shard"] for r in got if r["text_crc32"] == crc32(rows[0][1].encode())}
    assert len(copies) == 1


def test_shards_query_is_balanced(spark, data, corpus):
    sizes = shards_of(QUERIES["op3_sharding"](spark, data).collect(), corpus.items())
    longest = max(len(t.encode()) for t in corpus.values()) + 1
    mean = sum(sizes.values()) / 16
    assert all(abs(s - mean) <= longest for s in sizes.values())


def test_many_copies_share_a_shard_and_have_slots(frame):
    rows = [(i, "same") for i in range(900)] + [(1000 + i, f"text {i} " * 20) for i in range(300)]
    got = sharding.shard_by_bytes(frame(rows)).collect()
    shards_of(got, rows)
    assert len({r["shard"] for r in got if r["doc_id"] < 900}) == 1


def line_model(rows):
    """Lines to remove by comparing all pairs of lines."""
    lines = [
        (-(2**63) if i is None else i, k, frozenset(line.encode().split()))
        for i, t in rows
        for k, line in enumerate((t or "").split("\n"))
    ]
    lines = [x for x in lines if x[2]]
    gone = set()
    for doc, k, words in lines:
        if any(5 * len(words & w) >= 4 * len(words | w) and (d, n) < (doc, k) for d, n, w in lines):
            gone.add((doc, k))
    return gone


def removed(got):
    return {(-(2**63) if r["doc_id"] is None else r["doc_id"], k) for r in got for k in r["removed"]}


def near_lines(seed, n=400):
    """Lines with many near copies, exact copies, short lines and words that nearly all lines have."""
    random = np.random.default_rng(seed)
    bases = [[f"w{random.integers(0, 300)}" for _ in range(random.integers(1, 40))] for _ in range(25)]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(random.integers(1, 5)):
            words = list(bases[random.integers(0, len(bases))])
            for _ in range(random.integers(0, 4)):
                words[random.integers(0, len(words))] = f"v{random.integers(0, 60)}"
            lines.append(" ".join(words + ["the"] * int(random.integers(0, 2))))
        rows.append((int(i), "\n".join(lines)))
    return rows


def test_lines(docs, rows):
    got = line_dedup.deduplicate_lines(docs).collect()
    assert removed(got) == line_model(rows)
    assert len(got) == len(rows)
    texts = {r["doc_id"]: r["text"] for r in got}
    assert texts[None] == "no id at all, only text"


@pytest.mark.parametrize("nearest", [1, 8])
def test_lines_equal_brute_force(frame, monkeypatch, nearest):
    """With one nearest candidate many lines need the join with all of them."""
    monkeypatch.setattr(line_dedup, "NEAREST", nearest)
    monkeypatch.setattr(line_dedup, "SENT_TOKENS", 0 if nearest == 1 else 200_000)
    rows = near_lines(nearest)
    got = line_dedup.deduplicate_lines(frame(rows).repartition(5)).collect()
    assert removed(got) == line_model(rows)
    by = dict(rows)
    for r in got:
        gone = set(r["removed"])
        assert r["text"] == "\n".join(x for k, x in enumerate(by[r["doc_id"]].split("\n")) if k not in gone)
        assert r["n_removed"] == len(gone) and r["n_lines"] == by[r["doc_id"]].count("\n") + 1


@pytest.mark.parametrize("most", [0, 4096])
def test_open_lines_in_rows_and_in_crates(frame, monkeypatch, most):
    """Both placements give the brute force; packed in crates, the texts are indexed once, however many lines stay open."""
    calls, whole = [], line_dedup.prefix_rows
    monkeypatch.setattr(line_dedup, "prefix_rows", lambda *a, **k: calls.append(k) or whole(*a, **k))
    for name, value in (("NEAREST", 1), ("MOST_SHARES", most), ("SHARE_BYTES", 20_000), ("PACKED", 500), ("LISTED", 100)):
        monkeypatch.setattr(line_dedup, name, value)
    rows = near_lines(5, 250)
    got = line_dedup.deduplicate_lines(frame(rows).repartition(3)).collect()
    assert removed(got) == line_model(rows)
    assert (len(calls) == 1 and calls[0]["shares"] > 1) if most else len(calls) > 1


def test_words_of_any_length_have_hashes_of_their_own():
    """Eight bytes at a time: sizes around them, words that differ in one byte, zero bytes, the same word at other places."""
    words = [c * n for c in "ab\0é" for n in range(1, 40)] + ["x" * k + "y" + "x" * (30 - k) for k in range(31)]
    words = list(dict.fromkeys(words))
    found = line_dedup.split_lines([" ".join(words), "  \n" + "\t".join(reversed(words))])
    one, two = found.word[: len(words)].tolist(), found.word[len(words) :].tolist()
    assert len(set(one)) == len(words) and two == one[::-1]
    assert found.number.tolist() == [0, 1] and found.text.tolist() == [0, 1] and found.n.tolist() == [len(words)] * 2


def test_long_texts_are_split_between_lines():
    text = "\n".join(f"line {i} of many" if i % 3 else "" for i in range(500))
    whole = line_dedup.split_lines([text])
    parts = list(line_dedup.lines_of([text], unit=100))
    assert len(parts) > 5
    for name in ("number", "line", "other", "n", "word"):
        assert np.concatenate([getattr(p, name) for p in parts]).tolist() == getattr(whole, name).tolist()


def test_second_pass_gives_just_the_wanted_words(frame):
    """Lines without a wanted word are passed over, those with one give the same rows as in the first pass."""
    docs = frame(near_lines(3)).repartition(2)
    levels = line_dedup.word_sketch(line_dedup.first_pass(docs))
    rows = sorted(map(tuple, line_dedup.prefix_rows(docs, levels).collect()))
    tokens = np.sort(np.unique([r[0] for r in rows])[::5])
    got = sorted(map(tuple, line_dedup.prefix_rows(docs, levels, tokens).collect()))
    assert got == [r for r in rows if r[0] in set(tokens.tolist())] and 0 < len(got) < len(rows)


def test_first_pass_has_every_line_and_counts_every_word(frame):
    rows = [(1, "a b c\n\na b"), (2, "c d\n  \nb"), (2, "e"), (None, None)]
    passed = line_dedup.first_pass(frame(rows).coalesce(1))
    lines = passed.where("segment IS NULL").select("doc", "number").collect()
    assert sorted(map(tuple, lines)) == [(1, 0), (1, 2), (2, 0), (2, 0), (2, 2)]
    levels = line_dedup.word_sketch(passed)
    level = {n: 1 + int(np.ceil(4 * np.log2(n))) for n in (1, 2, 3)}
    for word, n in (("a", 2), ("b", 3), ("c", 2), ("d", 1), ("e", 1)):
        assert levels[int(line_dedup.split_lines([word]).word[0]) >> (64 - line_dedup.SKETCH_BITS)] == level[n]


def test_line_hashes_are_those_of_whole_texts(monkeypatch):
    lines = ["one two", "", " \t", "two one", "x" * 5000, "one  two"]
    whole = line_dedup.split_lines(["\n".join(lines)])
    by_number = dict(zip(whole.number.tolist(), whole.line.view(np.int64).tolist()))
    monkeypatch.setattr(line_dedup, "UNIT", 10)
    assert line_dedup.line_hashes(lines) == [by_number.get(i) for i in range(len(lines))]


def test_far_places_have_factors_of_their_own(frame):
    """Long words and long lines that differ only beyond the tables of factors."""
    a, b = "a" * 4096, "b" * 4096
    one, two = " ".join(["x"] * 4096 + ["y"] * 4096), " ".join(["y"] * 4096 + ["x"] * 4096)
    parts = line_dedup.split_lines([a + b, b + a, one, two])
    assert len(set(parts.line.tolist())) == len(set(parts.other.tolist())) == 4
    kept = line_dedup.keep_first_lines(frame([(1, a + b), (2, b + a)]))
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == {1: a + b, 2: b + a}


def test_stage_keeps_columns_and_nulls(docs):
    kept = line_dedup.keep_first_lines(docs)
    assert kept.columns == docs.columns
    rows = {r["doc_id"]: r for r in kept.collect()}
    assert rows[(3 * 7) % 11]["text"] is None
    assert all(r["n_chars"] == len(r["text"]) for r in rows.values() if r["text"] is not None)


def simhash_model(text):
    data = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def classes(points, distance):
    """Least reachable point of each point, by comparing all pairs."""
    points = sorted(points)
    label = {p: p for p in points}
    while True:
        new = {p: min(label[q] for q in points if bin(p ^ q).count("1") <= distance) for p in points}
        if new == label:
            return label
        label = new


def near_model(rows, distance=2):
    prints = [(i, simhash_model(t)) for i, t in rows]
    label = classes({f for _, f in prints}, distance)
    least = {}
    for i, f in prints:
        if i is not None:
            least[label[f]] = min(i, least.get(label[f], i))
    return sorted((*low(i), f"{f:016x}", *low(least.get(label[f]))) for i, f in prints)


def near_rows(got):
    return sorted((*low(r["doc_id"]), r["fingerprint"], *low(r["component_id"])) for r in got)


def test_near_duplicates(docs, rows):
    assert near_rows(simhash.near_duplicates(docs).collect()) == near_model(rows)


def test_near_duplicates_query(spark, data, corpus):
    got = QUERIES["op10_simhash"](spark, data).collect()
    assert near_rows(got) == near_model(corpus.items())


@pytest.mark.parametrize(("distance", "bucket"), [(2, 4096), (2, 3), (3, 5)])
def test_links_equal_all_pairs(spark, monkeypatch, distance, bucket):
    """Clusters and chains of fingerprints, also in hot buckets that are cut into grids."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    random = np.random.default_rng(distance)
    centres = random.integers(0, 2**64, 20, np.uint64)
    points = {int(c) for c in centres} | {0, 2**64 - 1}
    for c in [int(x) for x in centres[:8]] + [0]:
        at = c
        for _ in range(30):
            for bit in random.integers(0, 64, random.integers(1, distance + 2)):
                at ^= 1 << int(bit)
            points.add(at)
    signed = [p - 2**64 if p >= 2**63 else p for p in points]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long").repartition(4)
    plan = simhash.choose_partitioning(np.array(signed, np.int64).view(np.uint64), len(signed), distance)
    sizes = simhash.bucket_rows(frame, plan, None).groupBy("part", "value").count().where(f"count > {2 * bucket}")
    hot = sizes.selectExpr("part", "value", f"cast(ceil(count / {bucket}) as int) AS cuts")
    edges = simhash.bucket_links(simhash.bucket_rows(frame, plan, hot), distance)
    roots = {r["fp"] % 2**64: r["root"] % 2**64 for r in simhash.components(edges).collect()}
    want = classes(points, distance)
    got = {p: roots.get(p, p) for p in points}
    same = lambda label: {frozenset(q for q in points if label[q] == label[p]) for p in points}
    assert same(got) == same(want)


def test_different_texts_of_one_id_stay(frame):
    texts = ["red apples fall from old trees", "grey wolves hunt in deep snow at night", "a third text that is not like them"]
    rows = [(5, texts[0]), (5, texts[1]), (6, texts[2]), (5, texts[0]), (7, texts[1]), (None, texts[1]), (8, None), (8, "")]
    kept = sorted(((r["doc_id"], r["text"]) for r in simhash.keep_one_of_each(frame(rows)).collect()), key=repr)
    assert [r for r in kept if r[0] != 8] == sorted([(5, texts[0]), (5, texts[1]), (6, texts[2]), (None, texts[1])], key=repr)
    assert len([r for r in kept if r[0] == 8]) == 1


def test_one_of_each_class_stays(docs, rows):
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect())
    model = near_model(rows)
    assert ids == sorted({m[1] for m in model if m[0] and m[1] == m[4]})
    assert kept.where("doc_id is null").count() == 1


def fingerprint_model(rows):
    key = lambda r: (r[0] is not None, r[0] or 0)
    order = sorted(rows, key=key, reverse=True)
    out = []
    for k, (i, t) in enumerate(order):
        text, donor = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + donor[:half]
        own, new, after = (fingerprints.text_signature(x) for x in (text, edited, donor))
        out.append(
            (*low(i), len(text), sha256(edited.encode()).hexdigest(), own.tobytes().hex(), new.tobytes().hex(),
             float((own == new).mean()), float((own == after).mean()))
        )
    return sorted(out)


def fingerprint_rows(got):
    return sorted((*low(r[0]), *tuple(r)[1:]) for r in got)


@pytest.mark.parametrize("size", [100, 1 << 23])
def test_fingerprints(frame, rows, monkeypatch, size):
    """In one range and in as many as there are rows."""
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", size)
    unique = [r for k, r in enumerate(rows) if r not in rows[:k]]
    got = fingerprints.fingerprints(frame(unique).repartition(3)).collect()
    assert fingerprint_rows(got) == fingerprint_model(unique)


def test_fingerprints_of_repeated_rows_and_one_row(frame, docs, rows):
    assert fingerprints.fingerprints(docs).count() == len(rows)
    one = fingerprints.fingerprints(frame([(4, "only one")])).first()
    assert one["near_next"] == 1.0 and one["n_chars"] == 8


def test_fingerprints_query(spark, data, corpus):
    got = QUERIES["op9_lz_fingerprints"](spark, data).collect()
    assert fingerprint_rows(got) == fingerprint_model(list(corpus.items()))
    assert np.mean([r["near_edited"] for r in got]) > 2 * np.mean([r["near_next"] for r in got])


def plain_signature(text):
    """Phrases as strings, their hashes letter by letter, the least hashes one by one."""
    known, phrase, phrases = set(), "", []
    for letter in text:
        phrase += letter
        if phrase not in known:
            known.add(phrase)
            phrases.append(phrase)
            phrase = ""
    found = []
    for phrase in phrases:
        total = 0
        for place, letter in enumerate(phrase):
            mixed = ((ord(letter) + 1) * 0x9E3779B97F4A7C15 + place * 0xC2B2AE3D27D4EB4F) % 2**64
            mixed ^= mixed >> 29
            mixed = mixed * 0xBF58476D1CE4E5B9 % 2**64
            total = (total + (mixed ^ mixed >> 32)) % 2**64
        total ^= total >> 30
        found.append((total * 0x94D049BB133111EB % 2**64) >> 32)
    functions = zip(fingerprints.FACTORS.tolist(), fingerprints.OFFSETS.tolist(), strict=True)
    return phrases, [min([(h * a + b) % 2**32 for h in found], default=2**32 - 1) % 2**16 for a, b in functions]


def test_signatures_equal_plain_python(monkeypatch):
    monkeypatch.setattr(fingerprints, "UNIT", 1000)
    assert plain_signature("abaababab")[0] == ["a", "b", "aa", "ba", "bab"]
    for text in ["", "a", "abaababab", "a" * 50_000, "ünï 日本語 😀 " * 30, "the cat sat on the mat " * 9]:
        assert fingerprints.text_signature(text).tolist() == plain_signature(text)[1]
    long = []
    fingerprints.parse("a" * 200_000, set(), "", long)
    assert [len(p) for p in long] == list(range(1, 632))  # as long as they come


def test_empty_tables(empty):
    for made in (
        exact_dedup.exact_duplicates(empty),
        sharding.shard_by_bytes(empty),
        line_dedup.deduplicate_lines(empty),
        simhash.near_duplicates(empty),
        fingerprints.fingerprints(empty),
        simhash.keep_one_of_each(empty),
        line_dedup.keep_first_lines(empty),
    ):
        assert made.collect() == []
