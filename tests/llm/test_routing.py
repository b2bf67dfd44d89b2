"""Requests routed in rounds: the same answers for any number of rounds, rows in proportion to the input."""

import random
import sys
from hashlib import sha256

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from folioquery.llm import bpe, common, quality, routing
from folioquery.llm.common import unsqueeze
from folioquery.llm.queries import PATTERN, RANKS
from folioquery.llm.routing import ANSWER, REQUEST, answer_row, answered, homeward, outward, request_row, ways

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the tasks of this file travel with the job


def split(keys, n):
    out = {}
    for key in keys:
        out.setdefault(key % n, []).append(key)
    return out



@pytest.mark.parametrize(("shares", "fan", "want"), [(1, 8, (1, 1)), (8, 8, (8, 1)), (9, 8, (3, 2)), (64, 8, (8, 2)), (65, 8, (5, 3)), (12_500_000, 256, (233, 3))])
def test_ways(shares, fan, want):
    assert ways(shares, fan) == want


def ask(spark, wanted, each):
    """Level-1 requests for {block: keys}."""
    rows = [(b, k) for b, k in wanted.items()]
    asked = spark.createDataFrame(rows, "block long, keys array<long>").repartition(5)

    def pack(batches):
        for batch in batches:
            for block, keys in zip(batch.column("block").to_pylist(), batch.column("keys").to_pylist(), strict=True):
                for way, own in split(keys, each).items():
                    yield request_row(way, block, own)

    return asked.mapInArrow(pack, REQUEST)


def route(spark, wanted, each, levels):
    """What each block gets, and the rows of every round."""
    sent = outward(ask(spark, wanted, each), each, levels, split).cache()
    shares = each**levels

    def answer(batches):
        for batch in batches:
            for share, origin, crate in zip(*(batch.column(n).to_pylist() for n in ("way", "origin", "crate")), strict=True):
                yield answer_row(origin, answered(unsqueeze(crate), levels, lambda keys: [(k, share, k * k) for k in keys]))

    replies = homeward(sent.repartition(shares, "way").mapInArrow(answer, ANSWER), each, levels).collect()
    got = {}
    for origin, crate in replies:
        for values in unsqueeze(bytes(crate)):
            got.setdefault(origin, []).extend(values)
    return got, sent.count(), len(replies)


@pytest.mark.parametrize(("each", "levels"), [(1, 1), (7, 1), (3, 2), (3, 3), (2, 4)])
def test_every_key_comes_back_once_to_its_block(spark, each, levels):
    rng = random.Random(each * 10 + levels)
    wanted = {b: rng.sample(range(500), rng.randrange(1, 60)) for b in range(-20, 20)}
    got, _, _ = route(spark, wanted, each, levels)
    assert {b: sorted(v) for b, v in got.items()} == {b: sorted((k, k % each**levels, k * k) for k in ks) for b, ks in wanted.items()}


def test_no_requests(spark):
    assert outward(spark.createDataFrame([], REQUEST), 3, 2, split).collect() == []
    assert homeward(spark.createDataFrame([], ANSWER), 3, 2).collect() == []


def test_small_trips(spark, monkeypatch):
    monkeypatch.setattr(routing, "TRIP_BYTES", 1)
    wanted = {b: list(range(b, b + 40)) for b in range(30)}
    got, _, _ = route(spark, wanted, 3, 3)
    assert {b: sorted(k for k, _, _ in v) for b, v in got.items()} == wanted


def test_rows_grow_with_the_input(spark):
    """Ten times the blocks and shares: rows per block stay, where one row per block and share would be ten times as many."""
    per_block = []
    for blocks in (12, 120):
        each, levels = ways(blocks, 8)
        wanted = {b: list(range(2000)) for b in range(blocks)}
        _, sent, replied = route(spark, wanted, each, levels)
        per_block.append(((sent / blocks) / each, (replied / blocks) / each))
    assert max(max(p) for p in per_block) <= 2.5
    assert per_block[1][0] <= 1.6 * per_block[0][0]


def test_a_task_that_runs_again_makes_the_same_trips(spark):
    requests = ask(spark, {b: list(range(b, b + 50)) for b in range(40)}, 3).cache()
    runs = [{tuple(r) for r in outward(requests.orderBy(F.rand(seed)), 3, 3, split).collect()} for seed in (1, 2)]
    assert runs[0] == runs[1]


@pytest.fixture
def many_rounds(monkeypatch):
    monkeypatch.setattr(routing, "FAN", 3)
    monkeypatch.setattr(common.blocks, "__defaults__", (2_000,))
    monkeypatch.setattr(bpe, "SHARE_BYTES", 30_000)
    monkeypatch.setattr(quality, "SHARE_BYTES", 30_000)


def test_bpe_in_many_rounds(docs, rows, many_rounds):
    assert ways(-(-common.text_bytes(docs) // bpe.SHARE_BYTES))[1] >= 3
    encoding = bpe.encoder(RANKS, PATTERN)

    def want(i, text):
        ids = encoding.encode_ordinary(text or "")
        return i is None, i or 0, len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256((text or "").encode()).hexdigest()

    got = bpe.encode_and_decode(docs, RANKS, PATTERN).collect()
    assert sorted((r[0] is None, r[0] or 0, *r[1:]) for r in got) == sorted(want(i, t) for i, t in rows)


def test_perplexities_in_many_rounds(docs, request):
    model = quality.train(docs.where("text is not null"), 3).cache()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text_hash"], r["n_units"], round(r["perplexity"], 9))
    once = sorted(map(key, quality.perplexities(docs, model, 3).collect()))
    request.getfixturevalue("many_rounds")
    assert sorted(map(key, quality.perplexities(docs, model, 3).collect())) == once
