import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from test_cache import model

from folioquery.operators.chunking import chunk_documents
from folioquery.plans.analyze import analyze_documents
from folioquery.sources.store import load_tables
from folioquery.streaming import stages
from folioquery.streaming.stages import analyze_stage, parse_stage, read_file_stream, reuse_stage

DOCS = "document_id string, filename string, content string"


def write_parts(spark, path, parts, schema):
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)


def test_parse_stage_equals_batch_and_resumes(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    parts = [[(f"d{i}", f"{i}.txt", f"word{i} " * (i * 7)) for i in range(n, n + 4)] for n in (0, 4, 8)]
    write_parts(spark, source, parts[:2], DOCS)
    stream = read_file_stream(spark, source, DOCS, files_per_batch=1)
    parse_stage(stream, target, 10, 3)
    write_parts(spark, source, parts[2:], DOCS)
    parse_stage(read_file_stream(spark, source, DOCS, files_per_batch=1), target, 10, 3)
    found = spark.read.parquet(f"{target}/chunks")
    want = chunk_documents(spark.read.schema(DOCS).parquet(source), 10, 3)
    assert found.count() == want.count()
    assert found.select(want.columns).exceptAll(want).count() == 0
    tasks = {r["document_id"]: r for r in spark.read.parquet(f"{target}/tasks").collect()}
    assert set(tasks) == {f"d{i}" for i in range(12)}
    assert tasks["d0"]["chunk_ids"] is None and len(tasks["d11"]["chunk_ids"]) == 11


def test_analyze_stage_equals_batch(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    write_parts(spark, source, [[("a", "a.txt", "One. Two two.")], [("b", "b.txt", ""), ("c", "c.txt", "x y z")]], DOCS)
    analyze_stage(read_file_stream(spark, source, DOCS, files_per_batch=1), target, width=8)
    found = load_tables(spark, f"{target}/tables")
    want = analyze_documents(spark.read.schema(DOCS).parquet(source), width=8)
    for name, table in want.items():
        columns = table.columns
        assert found[name].count() == table.count()
        assert found[name].select(columns).exceptAll(table).count() == 0, name


def test_reuse_stage_over_micro_batches_equals_the_model(spark, tmp_path):
    rng = random.Random(8)
    start = datetime(2024, 1, 1)
    asks = [(i, f"k{rng.randrange(4)}", start + timedelta(minutes=rng.randrange(60 * 24 * 6))) for i in range(300)]
    asks.sort(key=lambda a: a[2])
    parts = [asks[i : i + 60] for i in range(0, 300, 60)]
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "ask_id long, key string, ts timestamp"
    write_parts(spark, source, parts, schema)
    reuse_stage(read_file_stream(spark, source, schema, files_per_batch=1), target, 24 * 3600)
    found = spark.read.parquet(f"{target}/answers").select("ask_id", "source_id")
    assert {r["ask_id"]: r["source_id"] for r in found.collect()} == model(asks, 24 * 3600)
    assert found.where(F.col("ask_id") == F.col("source_id")).count() > 4


def ask_parts(rng, start, parts, n, keys):
    return [
        [(100 * p + i, rng.choice(keys), start + timedelta(minutes=rng.randrange(60 * 24 * 6))) for i in range(n)] for p in range(parts)
    ]


def arrival_model(parts, ttl_seconds):
    """Each ask in the order of arrival, by time within a part, is answered by the live entry or computed."""
    live, sources = {}, {}
    for part in parts:
        for ask, key, ts in sorted(part, key=lambda a: (a[2], a[0])):
            if key not in live or ts >= live[key][0]:
                live[key] = (ts + timedelta(seconds=ttl_seconds), ask)
            sources[ask] = live[key][1]
    return sources


def test_reuse_stage_walks_batches_and_keeps_entries_over_runs(spark, tmp_path, monkeypatch):
    """Late asks, a NULL key, keys that go on in the next Arrow batch, and entries read from several folders of state."""
    monkeypatch.setattr(stages, "STATE_FOLDERS", 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        parts = ask_parts(random.Random(5), datetime(2024, 1, 1), 5, 60, ["a", "b", "c", None])
        source, target = str(tmp_path / "in"), str(tmp_path / "out")
        schema = "ask_id long, key string, ts timestamp"
        for part in parts:  # as several files of one micro-batch each
            spark.createDataFrame(part, schema).repartition(3).write.mode("append").parquet(source)
            reuse_stage(read_file_stream(spark, source, schema), target, 24 * 3600)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = spark.read.parquet(f"{target}/answers").select("ask_id", "source_id").collect()
    assert len(found) == 300
    assert {r["ask_id"]: r["source_id"] for r in found} == arrival_model(parts, 24 * 3600)
    assert spark.read.parquet(f"{target}/state").where("batch = 4").count() == 4  # every second folder has all keys
