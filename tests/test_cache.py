import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folioquery.operators import cache
from folioquery.sources import cache_store

START = datetime(2024, 1, 1)
DAY = 24 * 3600


def model(asks, ttl):
    """Plain statement of the reuse rule."""
    live, out = {}, {}
    for ask_id, key, ts in sorted(asks, key=lambda a: (a[2], a[0])):
        if key not in live or ts >= live[key][0]:
            live[key] = (ts + timedelta(seconds=ttl), ask_id)
        out[ask_id] = live[key][1]
    return out


def random_asks(seed, n, keys, span_days):
    rng = random.Random(seed)
    return [
        (i, "hot" if rng.random() < 0.4 else f"k{rng.randrange(keys)}",
         START + timedelta(hours=rng.randrange(span_days * 24), microseconds=rng.choice([0, 0, 1])))
        for i in range(n)
    ]


def frame(spark, asks):
    return spark.createDataFrame(asks, "ask_id long, key string, ts timestamp")


@pytest.mark.parametrize("hot_rows, dense_rows", [(10**9, 0), (100, 10**9), (0, 10), (0, 0)])
def test_reuse_equals_the_model(spark, hot_rows, dense_rows):
    asks = random_asks(1, 800, 12, 9)
    found = cache.reuse_within_ttl(frame(spark, asks), DAY, hot_rows, dense_rows=dense_rows).collect()
    assert {r["ask_id"]: r["source_id"] for r in found} == model(asks, DAY)
    assert all(r["reused"] == (r["ask_id"] != r["source_id"]) for r in found)


def test_reuse_over_many_batches(spark):
    asks = random_asks(2, 500, 3, 20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = cache.reuse_within_ttl(frame(spark, asks), DAY).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["ask_id"]: r["source_id"] for r in found} == model(asks, DAY)


@pytest.mark.parametrize("hot_rows", [10**9, 0])
def test_boundary_and_no_prolonging(spark, hot_rows):
    hours = [0, 12, 23.999, 24, 30, 47.9, 48]
    asks = [(i, "k", START + timedelta(hours=h)) for i, h in enumerate(hours)]
    found = {r["ask_id"]: r["source_id"] for r in cache.reuse_within_ttl(frame(spark, asks), DAY, hot_rows).collect()}
    # Exactly at the expiry the answer is computed again; reads do not prolong it.
    assert found == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: 6}


@pytest.fixture
def entries(spark):
    rows = [("a", "1", [1, 2], START), ("b", "2", [3], START + timedelta(hours=5))]
    results = spark.createDataFrame(rows, "key string, payload string, document_ids array<int>, written_at timestamp")
    return cache.cache_entries(results, 3600)


def test_lookup_and_misses(spark, entries):
    asked = [(1, "a", 0), (2, "a", 3599), (3, "a", 3600), (4, "b", 0), (5, "c", 0), (6, "b", 5 * 3600)]
    requests = spark.createDataFrame(
        [(i, k, START + timedelta(seconds=s)) for i, k, s in asked], "id int, key string, asked_at timestamp"
    )
    found = {r["id"]: (r["cached"], r["payload"]) for r in cache.lookup(requests, entries).collect()}
    assert found == {1: (True, "1"), 2: (True, "1"), 3: (False, None), 4: (False, None), 5: (False, None), 6: (True, "2")}
    assert {r["id"] for r in cache.misses(requests, entries).collect()} == {3, 4, 5}
    nothing = entries.where(F.lit(False))
    assert cache.lookup(requests, nothing).where("cached").count() == 0
    assert cache.misses(requests, nothing).count() == 6


def test_last_write_wins_and_restarts_the_time(spark, entries):
    rows = [("a", "old", [1], START + timedelta(hours=1)), ("a", "new", [1], START + timedelta(hours=2)), ("z", "3", [9], START)]
    written = cache.write_cache(
        entries, spark.createDataFrame(rows, "key string, payload string, document_ids array<int>, written_at timestamp"), 3600
    )
    found = {r["key"]: (r["payload"], r["expires_at"]) for r in written.collect()}
    assert found["a"] == ("new", START + timedelta(hours=3))
    assert set(found) == {"a", "b", "z"} and written.count() == 3


def test_invalidation(spark, entries):
    documents = spark.createDataFrame([(2,), (7,)], "document_id int")
    assert [r["key"] for r in cache.invalidate(entries, documents).collect()] == ["b"]
    assert cache.invalidate(entries, documents, drop_all=True).count() == 0


def test_null_keys_are_keys_like_others(spark):
    start = datetime(2024, 1, 1)
    rows = [(i, None if i % 2 else "k", start + timedelta(hours=i)) for i in range(12)]
    asks = spark.createDataFrame(rows, "ask_id long, key string, ts timestamp")
    for hot in (5_000_000, 2):
        found = {r["ask_id"]: r["source_id"] for r in cache.reuse_within_ttl(asks, 4 * 3600, hot_rows=hot).collect()}
        assert found == {0: 0, 2: 0, 4: 4, 6: 4, 8: 8, 10: 8, 1: 1, 3: 1, 5: 5, 7: 5, 9: 9, 11: 9}


@pytest.mark.parametrize("ttl", [DAY, 3600, 40 * DAY])
def test_slices_compose(spark, ttl):
    """Slices much shorter and much longer than the TTL, in several levels."""
    for seed, size, fan in ((3, 400, 2), (4, 90, 3)):
        asks = random_asks(seed, size, 2, 9)
        found = cache.reuse_within_ttl(frame(spark, asks), ttl, hot_rows=0, slice_rows=max(size // 30, 1), fan=fan).collect()
        assert {r["ask_id"]: r["source_id"] for r in found} == model(asks, ttl)


def test_text_ids_and_a_hot_null_key(spark):
    asks = [(f"a{i:03}", None if i % 3 else "k", START + timedelta(hours=i)) for i in range(60)]
    log = spark.createDataFrame(asks, "ask_id string, key string, ts timestamp")
    found = cache.reuse_within_ttl(log, DAY, hot_rows=5, slice_rows=4, fan=3)
    assert {r["ask_id"]: r["source_id"] for r in found.collect()} == model(asks, DAY)
    assert found.schema["source_id"].dataType.simpleString() == "string"


ENTRY = "key string, payload string, document_ids array<string>, written_at timestamp, expires_at timestamp"


def entry(key, payload, ids, hour, lives=100):
    return (key, payload, ids, START + timedelta(hours=hour), START + timedelta(hours=hour + lives))


def test_cache_folder(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "cache")
    keys = spark.createDataFrame([("a",), ("b",), ("x",), (None,)], "key string")

    def found(of=keys):
        return {r["key"]: r["payload"] for r in cache_store.entries_of(of, folder, ENTRY).collect()}

    def add(*rows, **options):
        cache_store.add_entries(spark.createDataFrame(list(rows), ENTRY), folder, **options)

    assert found() == {} and cache_store.drop_answers(keys.withColumnRenamed("key", "document_id"), folder) == 0
    add(entry("a", "1", ["d", "e"], 0), entry("b", "2", ["e"], 0), entry("c", "3", [], 0))
    add(entry("a", "new", ["d"], 5))
    assert found() == {"a": "new", "b": "2"}
    monkeypatch.setattr(cache_store, "PUSHED_KEYS", 1)  # more keys than a literal filter takes
    assert found() == {"a": "new", "b": "2"}
    gone = spark.createDataFrame([("e",), ("e",)], "document_id string")
    assert cache_store.drop_answers(gone, folder) == 2  # the first answer of `a` used it as well
    assert found() == {}
    later = 24 * 365 * 20  # hours, after the drop
    add(entry("b", "later", ["e"], later))
    assert found() == {"b": "later"}
    every = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    assert cache_store.compact_cache(spark, folder, (START + timedelta(hours=50)).timestamp()) == 2
    assert found(every) == {"b": "later", "c": "3"}
    assert cache_store.compact_cache(spark, folder, (START + timedelta(hours=500)).timestamp()) == 1
    assert found(every) == {"b": "later"} and len(list((tmp_path / "cache" / "entries").iterdir())) == 2
    for n in range(4):
        add(entry("a", str(n), ["d"], later + n), compact_after=2)
    assert found() == {"a": "3", "b": "later"}
    assert cache_store.drop_answers(spark.createDataFrame([("d",)], "document_id string"), folder) == 1


def test_a_lookup_reads_the_asked_buckets(spark, tmp_path):
    folder = str(tmp_path / "cache")
    rows = [entry(f"k{i}", str(i), [], 0) for i in range(500)]
    cache_store.add_entries(spark.createDataFrame(rows, ENTRY), folder)
    asked = cache_store.entries_of(spark.createDataFrame([("k7",)], "key string"), folder, ENTRY)
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(key,k7)" in plan
    assert [r["payload"] for r in asked.collect()] == ["7"]


def test_answers_of_deleted_documents(spark):
    entries = spark.createDataFrame([entry("a", "1", ["d"], 0), entry("b", "2", ["d"], 9), entry("c", "3", ["e"], 0)], ENTRY)
    deleted = spark.createDataFrame([("d", START + timedelta(hours=5))], "document_id string, deleted_at timestamp")
    assert {r["key"] for r in cache_store.without_deleted(entries, deleted).collect()} == {"b", "c"}
    assert cache_store.without_deleted(entries, None) is entries
