"""Conversation repair against an exhaustive search and against the whole contract in plain Python."""

import itertools
import random
import re
from collections import defaultdict
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

from folioquery.llm import conversation_repair as repair
from folioquery.llm.queries import QUERIES

AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def cheapest(rows):
    """rows: (letter, must go, cut off). (cost, audit) of all scripts, row by row over the four states."""

    def with_insertions(best):
        best = dict(best)
        for _ in range(4):
            for state, (cost, audit) in list(best.items()):
                new = AFTER[state, "a" if state == 2 else "u"]
                best[new] = min(best.get(new, (10**9, "")), (cost + 2, audit + "I"))
        return best

    best = {0: (0, "")}
    for letter, gone, cut in rows:
        before, best = with_insertions(best), {}
        for state, (cost, audit) in before.items():
            steps = [(state, cost + 3, "D")]
            if not gone:
                steps += [(AFTER[state, letter], cost + cut, "K")] if (state, letter) in AFTER else []
                steps += [(AFTER[state, n], cost + 2 + cut, "R") for n in "ua" if (state, n) in AFTER]
            for new, total, edit in steps:
                best[new] = min(best.get(new, (10**9, "")), (total, audit + edit))
    best = with_insertions(best)
    return min(best[s] for s in (0, 3) if s in best)


def exhaustive(rows, most):
    """As `cheapest`, by trying every script of up to `most` insertions between rows."""
    found = []

    def go(i, state, cost, audit, inserted):
        if i == len(rows) and state in (0, 3):
            found.append((cost, audit))
        if inserted < most:
            go(i, AFTER[state, "a" if state == 2 else "u"], cost + 2, audit + "I", inserted + 1)
        if i == len(rows):
            return
        letter, gone, cut = rows[i]
        go(i + 1, state, cost + 3, audit + "D", 0)
        if not gone:
            if (state, letter) in AFTER:
                go(i + 1, AFTER[state, letter], cost + cut, audit + "K", 0)
            for new in "ua":
                if (state, new) in AFTER:
                    go(i + 1, AFTER[state, new], cost + 2 + cut, audit + "R", 0)

    go(0, 0, 0, "", 0)
    return min(found)


KINDS = [(letter, False, cut) for letter in "suax" for cut in (0, 1)] + [("u", True, 0)]


def symbol(row):
    letter, gone, cut = row
    return repair.DELETED if gone else 1 + 2 * "suax".index(letter) + cut


def by_matrices(sequences):
    products = repair.Products().of([tuple(map(symbol, s)) for s in sequences])
    out = []
    for s in sequences:
        cost, audit = repair.result_of(repair.vector_times([(0, ""), None, None, None], products[tuple(map(symbol, s))]))
        out.append((cost, repair.flat(audit)))
    return out


def test_matrices_equal_the_exhaustive_search():
    sequences = [s for n in (1, 2, 3) for s in itertools.product(KINDS, repeat=n)]
    assert by_matrices(sequences) == [exhaustive(s, 2) for s in sequences]
    assert [cheapest(s) for s in sequences] == by_matrices(sequences)


def test_long_sequences_share_rules():
    rng = random.Random(3)
    sequences = [tuple(rng.choices(KINDS, k=rng.choice([1, 5, 40, 300]))) for _ in range(60)] + [(KINDS[2],) * 500, (KINDS[2], KINDS[4]) * 200]
    assert by_matrices(sequences) == [cheapest(s) for s in sequences]


def test_re_pair_gives_the_sequences_back():
    rng = np.random.default_rng(1)
    sequences = [rng.integers(0, 3, n) for n in (1, 2, 50, 200)] + [np.zeros(33, np.int64)]
    short, rules = repair.re_pair(sequences, 9)

    def spell(x):
        return [x] if x < 9 else spell(rules[x - 9][0]) + spell(rules[x - 9][1])

    assert [[y for x in s.tolist() for y in spell(x)] for s in short] == [s.tolist() for s in sequences]
    left = [p for s in short for p in itertools.pairwise(s.tolist())]
    # No pair is left twice but for places that overlap.
    assert all(left.count(p) == 1 or p[0] == p[1] for p in left)
    assert repair.re_pair([], 9) == ([], [])


def test_ropes():
    rng = random.Random(5)
    texts = ["".join(rng.choices("DIKR", k=rng.choice([0, 1, 30, 100]))) for _ in range(40)]
    rope, whole, made = "", "", []
    for t in texts:
        rope, whole = repair.join(rope, t), whole + t
        made.append((rope, whole))
    assert all(repair.flat(r) == w and repair.length(r) == len(w) for r, w in made)
    for (r, w), (s, v) in itertools.product(made, repeat=2):
        for x, y in (("", ""), ("D", "K"), ("K", "K" * 60)):
            assert repair.less(repair.join(r, x), repair.join(s, y)) == (w + x < v + y)


def test_runs_of_deletions():
    base = repair.Products().base
    for n in (1, 2, 3, 7, 12, 100):
        product = base[repair.DELETED]
        for _ in range(n - 1):
            product = repair.times(product, base[repair.DELETED])
        symbols = repair.run_of_deletions(n)
        run = base[symbols[0]]
        for s in symbols[1:]:
            run = repair.times(run, base[s])
        assert [[c and (c[0], repair.flat(c[1])) for c in row] for row in run] == [[c and (c[0], repair.flat(c[1])) for c in row] for row in product]
    assert repair.run_of_deletions(0) == []


def plain(rows):
    """The contract, conversation by conversation."""
    held = defaultdict(list)
    for conv, turn, role, text in rows:
        kind = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        own = held[conv]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        own += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, own in held.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha256(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in own:
            body = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
            seen.add((role, text))
        cost, audit = cheapest([(r[:1], f in ("blank", "duplicate"), int(f == "truncated")) for (_, r, _), f in zip(own, faults, strict=True)])
        lines, state, i = [], 0, 0
        for edit in audit:
            new = "a" if state == 2 else "u"
            if edit == "I":
                lines.append("user:" if new == "u" else "assistant:")
                state = AFTER[state, new]
                continue
            _, role, text = own[i]
            i += 1
            if edit == "D":
                continue
            role = role if edit == "K" else {"u": "user", "a": "assistant"}[new]
            lines.append(f"{role}:{text}")
            state = AFTER[state, role[0]]
        turns = [t for t, *_ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *counts, illegal, cost, audit, sha256("\n".join(lines).encode()).hexdigest(), len(own)))
    return sorted(out, key=repr)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


SCHEMA = "conv_id long, turn long, role string, text string, n long, seen boolean, kind string, audit string, symbols string"


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(11)
    words = ["yes.", "no", "why?", "", " \n", "Go on!", "I think so. ", None, "ok.\n", " .", "x" * 50_000 + "."]
    roles = ["user", "assistant", "system", None, "", "tool", "User"]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.choice([1, 2, 3, 8, 25])):
            rows.append((conv, rng.choice([turn, turn, turn + 2, turn // 2, None]), rng.choices(roles, [6, 6, 2, 1, 1, 1, 1])[0], rng.choice(words)))
    return [*rows, *rows[:20]]


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, 1, True, "k", "a", "s") for r in rows], SCHEMA)


def test_repair_equals_the_plain_version(spark, odd):
    assert rows_of(repair.repair(frame_of(spark, odd).repartition(5))) == plain(odd)


def test_a_long_conversation_is_cut_into_segments(spark, odd, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT", 3)
    monkeypatch.setattr(repair, "BATCH", 20)
    monkeypatch.setattr(repair, "RANGE_ROWS", 10)
    rng = random.Random(2)
    hot = [(7, t // 3, rng.choice(["user", "assistant"]), rng.choice(["a.", "b", "c!", f"t{t}."])) for t in range(600)]
    rows = odd + hot
    assert rows_of(repair.repair(frame_of(spark, rows).repartition(6))) == plain(rows)


def test_conversations_without_rows(spark):
    gone = next((c, t) for c in range(99) for t in range(9) if crc32(f"{c}:{t}".encode()) % 20 == 0)
    got = repair.repair(frame_of(spark, [(*gone, "user", "hello.")])).collect()
    assert [tuple(r) for r in got] == [(gone[0], 0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest(), 0)]
    assert repair.repair(frame_of(spark, [])).collect() == []


def test_query(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(QUERIES["op11_conversation_repair"](spark, data)) == plain(rows)


def test_repaired_texts(spark, odd):
    damaged = repair.damage(frame_of(spark, odd))
    parts = defaultdict(list)
    for r in sorted(repair.repaired_texts(damaged).collect(), key=lambda r: r["position"]):
        parts[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    for row in plain(odd):
        lines = parts[row[0]]
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        assert sha256("\n".join(lines).encode()).hexdigest() == row[8]
