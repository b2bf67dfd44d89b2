"""Toxicity and quality models, and the pipeline that strings the stages together."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql.functions import rand

import corpus_pipeline
from folioquery.llm import line_dedup, quality, simhash, toxicity
from folioquery.llm.queries import QUERIES


def story(seed, n, insult=None):
    """Sentences of invented words; the insult stands in one of them."""
    random = np.random.default_rng(seed)
    parts = [" ".join(f"{a}{b}" for a, b in random.choice(list("bdfglmnprst"), (6, 2))) for _ in range(n)]
    if insult:
        parts[int(random.integers(0, n))] += f" {insult} you"
    return ". ".join(parts) + "."


@pytest.fixture(scope="module")
def labelled(frame, labels):
    texts = [story(i, 3 + i % 20, ("idiot", "moronic", "moronish")[i % 3] if i % 4 == 0 else None) for i in range(400)]
    rows = [*enumerate(texts), (900, None), (901, ""), (None, "idiot you. idiot")]
    return frame(rows), labels([(i, 1, int(i % 4 == 0)) for i in range(400)]), rows


def test_toxic_documents_and_sentences_are_found(labelled):
    docs, labels, rows = labelled
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, labels).collect()}
    assert len(got) == len(rows)
    held = [i for i in range(400) if got[i]["held_out"]]
    assert 100 < len(held) < 170
    right = [got[i]["predicted"] == (i % 4 == 0) for i in held]
    assert np.mean(right) > 0.95
    for i in range(0, 400, 4):
        if got[i]["predicted"]:
            places = [rows[i][1][s["start"] : s["end"]] for s in got[i]["offending"]]
            assert any("idiot" in p or "moron" in p for p in places) and len(places) <= 2
    assert got[900]["score"] == got[901]["score"] == 0 and got[None]["predicted"] == 1
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_held_out_labels_are_never_learned_from(labelled, labels):
    docs, known, _ = labelled
    held = [r["doc_id"] for r in docs.where(toxicity.held_out() & toxicity.F.col("doc_id").isNotNull()).collect()]
    flipped = [(r["doc_id"], r["quality"], 1 - r["toxic"] if r["doc_id"] in held else r["toxic"]) for r in known.collect()]
    a, b = (toxicity.train(docs, x) for x in (known, labels(flipped)))
    assert a.bias == b.bias and (a.weights == b.weights).all()


def test_without_labels_nothing_is_toxic(labelled, labels, empty):
    docs, known, rows = labelled
    assert toxicity.keep_clean(docs, labels([])).count() == len(rows)
    assert toxicity.score_documents(empty, known).collect() == []
    assert toxicity.keep_clean(docs, known).columns == docs.columns


def test_toxicity_query(spark, data, corpus):
    got = QUERIES["op6_toxicity"](spark, data).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(corpus)


def kneser_ney(texts, order):
    """Interpolated modified Kneser-Ney in plain dictionaries; probability of the last unit of a tuple."""
    counts = {order: Counter()}
    for t in texts:
        units = framed(t, order)
        counts[order].update(tuple(units[i : i + order]) for i in range(len(units) - order + 1))
    for m in range(order - 1, 0, -1):
        counts[m] = Counter(g[1:] for g in counts[m + 1])
    cuts, totals, spare = {}, defaultdict(float), defaultdict(float)
    for m, own in counts.items():
        n = [sum(1 for c in own.values() if c == k) for k in range(1, 5)]
        cuts[m] = [0.5] * 3
        if n[0] and n[1]:
            y = n[0] / (n[0] + 2 * n[1])
            cuts[m] = [min(max(k + 1 - (k + 2) * y * n[k + 1] / n[k] if n[k] else 0.5, 0.05), k + 0.95) for k in range(3)]
        for g, c in own.items():
            totals[g[:-1]] += c
            spare[g[:-1]] += cuts[m][min(c, 3) - 1]

    def p(gram):
        if not gram:
            return 1 / (1 << quality.BITS)
        m, context = len(gram), gram[:-1]
        if not totals.get(context):
            return p(gram[1:])
        c = counts[m][gram]
        own = max(c - cuts[m][min(c, 3) - 1], 0) if c else 0
        return own / totals[context] + spare[context] / totals[context] * p(gram[1:])

    return p


def framed(text, order):
    clean = quality.SPACE.sub(" ", text).strip()
    return [1] * (order - 1) + [2 + ord(c) % 4094 for c in clean] + [1]


def perplexity(p, text, order):
    units = framed(text, order)
    logs = [math.log(p(tuple(units[i : i + order]))) for i in range(len(units) - order + 1)]
    return math.exp(-sum(logs) / len(logs))


@pytest.mark.parametrize("order", [2, 4])
def test_perplexity_equals_plain_model(frame, docs, rows, order):
    trained = [t or "" for _, t in rows[:3]] + ["the dog was late, the fox was not. " * 3]
    model = quality.train(frame(list(enumerate(trained))), order)
    p = kneser_ney(trained, order)
    got = quality.perplexities(docs, model, order).collect()
    assert len(got) == len(rows)
    known = {r["doc_id"]: r["perplexity"] for r in got}
    for i, t in rows:
        assert known[i] == pytest.approx(perplexity(p, t or "", order), rel=1e-4)


def test_probabilities_sum_to_one():
    p = kneser_ney(["abab", "abc ab"], 3)
    total = sum(p((2 + ord("a"), 2 + ord("b"), u)) for u in range(1 << quality.BITS))
    assert total == pytest.approx(1)


@pytest.fixture(scope="module")
def graded(frame, labels):
    good = [(i, story(i, 12)) for i in range(300)]
    bad = [(1000 + i, story(i, 12).upper().replace(" ", "### ")) for i in range(40)]
    rows = [*good, *bad, (2000, None), (2001, "")]
    return frame(rows), labels([(i, 1, 0) for i in range(200)] + [(1000 + i, 0, 0) for i in range(40)])


def test_bad_documents_are_rejected_and_clean_ones_stay(graded):
    docs, labels = graded
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(docs, labels, quantile=0.99).collect()}
    assert len(kept) == 342
    assert sum(kept[i] for i in range(300)) >= 290
    assert not any(kept[1000 + i] for i in range(40))
    stage = quality.keep_good(docs, labels, quantile=0.99)
    assert stage.columns == docs.columns
    assert {r["doc_id"] for r in stage.collect()} == {i for i, k in kept.items() if k}


def test_rows_in_another_order_at_every_read(frame, docs, rows):
    model = quality.train(docs, 3)
    want = sorted((tuple(r) for r in quality.perplexities(docs, model, 3).collect()), key=repr)
    assert sorted((tuple(r) for r in quality.perplexities(frame(rows).orderBy(rand()), model, 3).collect()), key=repr) == want


def test_without_trusted_text_all_stay(graded, labels, empty):
    docs, known = graded
    assert quality.keep_good(docs, labels([])).count() == 342
    assert quality.judge(empty, known).collect() == []


def test_quality_query(spark, data, corpus):
    got = QUERIES["op1_quality"](spark, data).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(corpus)
    assert np.mean([r["kept"] for r in got]) > 0.7


def test_pipeline_stages(spark, data, corpus):
    """Each stage against its operator's brute force or query, on what the one before kept."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "line_dedup", "simhash", "packing"]
    toxic = {r["doc_id"] for r in QUERIES["op6_toxicity"](spark, data).collect() if r["predicted"]}
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(corpus_pipeline.materialize(stage(spark, kept[-1], data), f"test-{name}"))
        assert kept[-1].columns == columns
    ids = [{r["doc_id"] for r in k.select("doc_id").collect()} for k in kept]
    assert ids[1] == set(corpus) - toxic
    low = {r["doc_id"] for r in quality.judge(kept[1], spark.read.parquet(f"{data}/labels.parquet")).where("not kept").collect()}
    assert ids[2] == ids[1] - low
    texts = {r["doc_id"]: r["text"] for r in line_dedup.deduplicate_lines(kept[2]).collect()}
    assert {r["doc_id"]: r["text"] for r in kept[3].collect()} == texts
    classes = simhash.near_duplicates(kept[3]).collect()
    assert ids[4] == {r["component_id"] for r in classes}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, data).collect()} == ids[4]
    assert corpus_pipeline.ORACLE_SQL is None
