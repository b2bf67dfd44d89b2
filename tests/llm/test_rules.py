"""Quality rules: measures against plain Python, estimation against a plain loop, the query against SQL."""

import math
import re
from collections import Counter

import duckdb
import pytest

from folioquery.llm import quality_rules as rules
from folioquery.llm.queries import QUERIES, SQL
from folioquery.session import materialize

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    words = WORD.findall(text or "")
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    spans = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(spans)
    covered = {i + k for i, s in enumerate(spans) if often[s] > 1 for k in range(5)}
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def base(text):
    n, _, _, _, repeated = counts(text)
    return n < 10 or 100 * repeated > 20 * n


MORE = [
    (60, "one two three four five one two three four five"),
    (61, "a a a a a a"),
    (62, "a b c d e"),
    (63, "x y z\r\nx y z\r\nx y z\n\n \n# & #"),
    (64, "a b c d e f a b c d e g b c d e f " + " ".join(map(str, range(40)))),
    (65, " wide space  \x0b\x0c\x1c end…"),
    (66, "same words here to say. " * 900),
]


def test_counts_equal_plain_python(frame, rows):
    both = [*rows, *MORE]
    got = rules.rate(frame(both).repartition(3)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    want = sorted(((i, *counts(t), base(t)) for i, t in both), key=repr)
    assert sorted(((r["doc_id"], *(r[n] for n in names), r["base_failed"]) for r in got), key=repr) == want
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_equal_hashes_are_told_apart(frame, monkeypatch):
    """With a hash that is the same for all windows the words decide."""
    monkeypatch.setattr(rules.F, "xxhash64", lambda *columns: rules.F.lit(1).cast("long"))
    row = rules.measure(frame(MORE)).collect()
    assert {r["doc_id"]: r["n_repeat_words"] for r in row} == {i: counts(t)[4] for i, t in MORE}


def plain_estimate(patterns, n_rules):
    good, right, wrong = 0.5, [rules.RIGHT] * n_rules, [rules.RIGHT] * n_rules
    total = sum(n for _, n in patterns)
    belief = rules.SMOOTH * total

    def rate(votes):
        odds = math.log(good / (1 - good))
        for v, a, b in zip(votes, right, wrong, strict=True):
            odds += {1: math.log(a / (1 - b)), -1: math.log((1 - a) / b), 0: 0.0}[v]
        return 1 / (1 + math.exp(-odds))

    for _ in range(rules.ROUNDS):
        rated = [(v, n, n * rate(v)) for v, n in patterns]
        good_ = (sum(g for *_, g in rated) + 0.5 * belief) / (total + belief)
        right_ = [
            (sum(g for v, n, g in rated if v[i] == 1) + rules.RIGHT * belief) / (sum(g for v, n, g in rated if v[i]) + belief)
            for i in range(n_rules)
        ]
        wrong_ = [
            (sum(n - g for v, n, g in rated if v[i] == -1) + rules.RIGHT * belief) / (sum(n - g for v, n, g in rated if v[i]) + belief)
            for i in range(n_rules)
        ]
        good, right, wrong = good_, right_, wrong_
    return good, right, wrong


def test_estimation_equals_a_plain_loop(spark):
    patterns = [([1, 1, 0], 50), ([1, -1, 1], 20), ([-1, -1, -1], 30), ([0, 0, 0], 5), ([1, 1, -1], 9), ([0, -1, -1], 4)]
    table = materialize(spark.createDataFrame(patterns, "votes array<int>, n long").coalesce(1), "patterns")
    got = rules.estimate(table, 3)
    want = plain_estimate(patterns, 3)
    assert got.good == pytest.approx(want[0]) and got.on_good == pytest.approx(want[1]) and got.on_bad == pytest.approx(want[2])
    assert rules.estimate(table.where("n < 0"), 3) == rules.Trust(0.5, (0.8,) * 3, (0.8,) * 3)


def test_estimation_finds_planted_accuracies(spark):
    """Votes drawn from known accuracies, as exact shares."""
    a, b, good = (0.95, 0.9, 0.85, 0.8), (0.9, 0.85, 0.9, 0.75), 0.7
    patterns = []
    for code in range(16):
        votes = [1 if code >> i & 1 else -1 for i in range(4)]
        on_good = math.prod(x if v == 1 else 1 - x for v, x in zip(votes, a, strict=True))
        on_bad = math.prod(x if v == -1 else 1 - x for v, x in zip(votes, b, strict=True))
        patterns.append((votes, round(1_000_000 * (good * on_good + (1 - good) * on_bad))))
    table = materialize(spark.createDataFrame(patterns, "votes array<int>, n long").coalesce(1), "patterns")
    got = rules.estimate(table, 4, rounds=60, smooth=0.0001)
    assert got.good == pytest.approx(good, abs=0.02)
    assert got.on_good == pytest.approx(a, abs=0.02) and got.on_bad == pytest.approx(b, abs=0.03)


def test_query_equals_sql(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    frame = QUERIES["op13_quality_rules"](spark, data)
    got = frame.collect()
    con.execute(SQL["op13_quality_rules"])
    names = [c[0] for c in con.description]
    want = [dict(zip(names, r, strict=True)) for r in con.fetchall()]
    assert sorted(names) == sorted(frame.columns)
    key = lambda r: r["doc_id"]
    assert [r.asDict() for r in sorted(got, key=key)] == sorted(want, key=key)


def test_good_documents_stay_and_bad_ones_go(spark, data):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in QUERIES["op13_quality_rules"](spark, data).collect()}
    good = [got[i]["kept"] for i, q in labels.items() if q == 1 and i in got and not got[i]["base_failed"]]
    bad = [got[i]["kept"] for i, q in labels.items() if q == 0 and i in got]
    assert sum(good) >= 0.98 * len(good)
    assert sum(bad) <= 0.6 * len(bad)


def test_no_python_in_the_plan(spark, data):
    plan = rules.measure(spark.read.parquet(f"{data}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_empty_table(empty):
    assert rules.rate(empty).collect() == []
