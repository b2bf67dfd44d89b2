import numpy as np
import pytest
from pyspark.sql import functions as F

from folioquery.operators import similarity
from folioquery.operators.ivf import (
    build_inverted_file,
    load_inverted_file,
    recall,
    save_inverted_file,
    top_k_ivf,
)
from folioquery.operators.retrieval import attach_summaries, hits_are_small, retrieve
from folioquery.operators.similarity import similar_pairs, top_k, width_mismatches

Q = "question_id int, vector array<float>, scopes array<int>, top_k int"
V = "chunk_id string, vector array<float>, document_id int"


def frames(spark, n_questions=30, n_vectors=400, width=6, hot=0.4, copies=0.3, seed=1):
    """Vectors of which one document holds a large share, and a share are copies of one vector."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(size=(n_vectors, width)).astype(np.float32)
    vectors[rng.random(n_vectors) < copies] = vectors[0]
    vectors[5] = 0
    documents = np.where(rng.random(n_vectors) < hot, 0, rng.integers(1, 20, n_vectors))
    questions = rng.normal(size=(n_questions, width)).astype(np.float32)
    questions[3] = vectors[0]
    scopes = [[0, int(rng.integers(1, 20))] if i % 3 else [] for i in range(n_questions)]
    tops = [int(i % 6 + 1) for i in range(n_questions)]
    v_rows = [(f"c{i:05d}", vectors[i].tolist(), int(documents[i])) for i in range(n_vectors)]
    q_rows = [(i, questions[i].tolist(), scopes[i], tops[i]) for i in range(n_questions)]
    return q_rows, v_rows, spark.createDataFrame(q_rows, Q), spark.createDataFrame(v_rows, V)


def brute(q_rows, v_rows, threshold, k=None, scoped=False):
    found = set()
    for qid, q, scopes, top in q_rows:
        q = np.array(q, dtype=np.float32).astype(float)
        hits = []
        for cid, v, doc in v_rows:
            v = np.array(v, dtype=np.float32).astype(float)
            if not v.any() or (scoped and doc not in scopes):
                continue
            sim = round(float(q @ v / (np.linalg.norm(q) * np.linalg.norm(v))), 9)
            if sim >= threshold:
                hits.append((-sim, cid))
        for rank, (sim, cid) in enumerate(sorted(hits), 1):
            if k is None or rank <= (top if k == "own" else k):
                found.add((qid, cid) if k is None else (qid, cid, rank))
    return found


PLACEMENTS = [{}, {"broadcast_bytes": 0, "block_bytes": 8 * 6 * 40}, {"broadcast_bytes": 0}]


@pytest.mark.parametrize("options", PLACEMENTS)
@pytest.mark.parametrize("scope", [None, "document_id"])
def test_top_k_equals_brute_force(spark, options, scope):
    q_rows, v_rows, questions, vectors = frames(spark)
    hits = top_k(questions, vectors, scope=scope, threshold=-1.0, **options).collect()
    found = {(r["question_id"], r["chunk_id"], r["rank"]) for r in hits}
    assert found == brute(q_rows, v_rows, -1.0, "own", scope is not None)


@pytest.mark.parametrize("options", PLACEMENTS)
def test_pairs_above_the_threshold_are_complete(spark, options):
    q_rows, v_rows, questions, vectors = frames(spark)
    found = {(r["question_id"], r["chunk_id"]) for r in similar_pairs(questions, vectors, threshold=0.5, **options).collect()}
    assert found == brute(q_rows, v_rows, 0.5)


def test_best_pairs_across_batches(spark):
    """Many small batches: floors rise, equal similarities are still decided by id."""
    q_rows, v_rows, questions, vectors = frames(spark, n_vectors=900, copies=0.6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "25")
    try:
        hits = top_k(questions.drop("top_k"), vectors.coalesce(1), threshold=-1.0, k=4).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r["question_id"], r["chunk_id"], r["rank"]) for r in hits} == brute(q_rows, v_rows, -1.0, 4)


def test_cutting_inside_a_task(spark, monkeypatch):
    import pyarrow as pa

    from folioquery.operators import similarity

    rng = np.random.default_rng(4)
    table = pa.table({"question_id": pa.array([1]), "top_k": pa.array([2], pa.int32()), "vector": pa.array([[1.0, 0.0]])})
    schema = pa.schema([("question_id", pa.int64()), ("top_k", pa.int32()), ("chunk_id", pa.int64()), ("similarity", pa.float64())])
    task = similarity._Search(table, None, 2, 2, -1.0, schema)
    task.n_room = 3
    angles = rng.random(100)
    for start in range(0, 100, 10):
        part = angles[start : start + 10]
        batch = pa.RecordBatch.from_arrays(
            [pa.array(np.arange(start, start + 10)), pa.array([[float(np.cos(a)), float(np.sin(a))] for a in part])],
            names=["chunk_id", "vector"],
        )
        assert list(task.add(batch, None)) == []
        assert task.n_kept <= 3 + 10
    found = [r for b in task.finish() for r in b.to_pylist()]
    assert [r["chunk_id"] for r in found] == np.argsort(angles)[:2].tolist()


def test_threshold_is_inclusive_and_applies_before_the_limit(spark):
    questions = spark.createDataFrame([(1, [1.0, 0.0], [1], 5)], Q)
    vectors = spark.createDataFrame([("a", [0.6, 0.8], 1), ("b", [0.8, 0.6], 1), ("c", [1.0, 0.0], 2)], V)
    hits = top_k(questions, vectors, scope="document_id", threshold=0.6).orderBy("rank").collect()
    assert [(r["chunk_id"], r["rank"]) for r in hits] == [("b", 1), ("a", 2)]
    assert [r["chunk_id"] for r in top_k(questions, vectors, threshold=0.61).orderBy("rank").collect()] == ["c", "b"]


def test_no_scopes_no_hits(spark):
    questions = spark.createDataFrame([(1, [1.0, 0.0], [], 5)], Q)
    vectors = spark.createDataFrame([("c", [1.0, 0.0], 2)], V)
    for options in PLACEMENTS:
        assert top_k(questions, vectors, scope="document_id", threshold=-1.0, **options).count() == 0


def test_ranking_is_cut_before_the_exchange(spark):
    _, _, questions, vectors = frames(spark)
    plan = top_k(questions, vectors, threshold=0.0)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_retrieve_adds_chunks_and_defaults(spark):
    questions = spark.createDataFrame([(1, [1.0, 0.0], [1, 2], 5)], Q)
    embeddings = spark.createDataFrame([("a", [1.0, 0.0], 1), ("b", [1.0, 0.1], 2)], V).withColumn("model", F.lit("m"))
    chunks = spark.createDataFrame([("a", 1, 0, "text a", 2), ("b", 2, 0, "text b", 2)],
                                   "chunk_id string, document_id int, ord int, text string, token_count int")
    summaries = spark.createDataFrame([(1, "sum", ["p"])], "document_id int, summary string, key_points array<string>")
    for options in ({}, {"broadcast_bytes": 0}):
        rows = retrieve(questions, embeddings, chunks, summaries, **options).orderBy("rank").collect()
        assert [(r["text"], r["model"], r["summary"], r["key_points"]) for r in rows] == [
            ("text a", "m", "sum", ["p"]), ("text b", "m", "", []),
        ]


def test_summaries_join_keeps_all_hits(spark):
    hits = spark.createDataFrame([(1, 7)], "question_id int, document_id int")
    none = spark.createDataFrame([], "document_id int, summary string, key_points array<string>")
    assert attach_summaries(hits, none).collect()[0]["key_points"] == []


def test_hit_bound():
    assert hits_are_small(1000) and not hits_are_small(10_000_000)


def test_inverted_file(spark, tmp_path):
    _, _, questions, vectors = frames(spark, n_vectors=600, copies=0.0)
    index = build_inverted_file(vectors, lists=8)
    exact = top_k(questions, vectors, threshold=-1.0)
    everything = top_k_ivf(questions, index, nprobe=8, threshold=-1.0)
    columns = ["question_id", "chunk_id", "rank"]
    assert everything.select(columns).exceptAll(exact.select(columns)).count() == 0
    assert recall(everything, exact).first()["recall"] == 1.0
    shares = [recall(top_k_ivf(questions, index, nprobe=n, threshold=-1.0), exact).first()["recall"] for n in (1, 4)]
    assert 0.2 < shares[0] <= shares[1]
    # The zero vector is not indexed; every other vector is in exactly one list.
    assert index.vectors.count() == 599
    save_inverted_file(index, str(tmp_path / "index"))
    stored = load_inverted_file(spark, str(tmp_path / "index"))
    assert stored.vectors.count() == 599 and stored.vectors.select("list_id").distinct().count() <= 8
    assert np.array_equal(stored.centroids, index.centroids)
    again = top_k_ivf(questions, stored, nprobe=3, threshold=-1.0).select(columns)
    assert again.exceptAll(top_k_ivf(questions, index, nprobe=3, threshold=-1.0).select(columns)).count() == 0
    # Restricted to documents as well: the same rows as the exact restricted search when all lists are probed.
    within = top_k_ivf(questions, stored, nprobe=8, within="document_id", threshold=-1.0).select(columns)
    restricted = top_k(questions, vectors, scope="document_id", threshold=-1.0).select(columns)
    assert within.count() == restricted.count() and within.exceptAll(restricted).count() == 0
    some = top_k_ivf(questions, stored, nprobe=2, within="document_id", threshold=-1.0)
    assert 0 < recall(some, restricted).first()["recall"] < 1


def test_mixed_widths_and_large_k(spark):
    """A question of another width changes nothing for the others; a top_k above 20 is served."""
    vectors = spark.createDataFrame(
        [(f"c{i:03}", [float(i + 1), 1.0, 0.5, 0.25]) for i in range(60)] + [("wide", [1.0] * 6)],
        "chunk_id string, vector array<double>",
    )
    asked = [("a", [1.0, 0.0, 0.0, 0.0], 50), ("b", [0.0, 1.0, 0.0, 0.0], 2), ("c", [1.0] * 5, 5), ("d", [1.0] * 6, 5)]
    questions = spark.createDataFrame(asked, "question_id string, vector array<double>, top_k int")
    for sent in (1 << 20, 0):
        hits = top_k(questions, vectors, threshold=-1.0, broadcast_bytes=sent).collect()
        counts = {q: sum(h["question_id"] == q for h in hits) for q, _, _ in asked}
        assert counts == {"a": 50, "b": 2, "c": 0, "d": 1}
    assert [tuple(r) for r in width_mismatches(questions, vectors).collect()] == [("c", 5)]


def test_small_blocks_grow_into_few_tiles_that_stream(spark):
    """Rows are copied to few tiles, whatever the least block is, and a task gives its pairs back as it goes."""
    q_rows, v_rows, questions, vectors = frames(spark, n_questions=600, n_vectors=1500, copies=0.0)
    pairs = similar_pairs(questions, vectors, threshold=0.9, broadcast_bytes=0, block_bytes=8 * 6 * 4)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroups" not in plan and "MapInArrow" in plan
    assert pairs.rdd.getNumPartitions() <= 4 * 4 * spark.sparkContext.defaultParallelism
    assert {(r["question_id"], r["chunk_id"]) for r in pairs.collect()} == brute(q_rows, v_rows, 0.9)


@pytest.mark.parametrize("scope", [None, "document_id"])
def test_many_products_take_tiles_with_the_same_rows(spark, monkeypatch, scope):
    from folioquery.operators import similarity

    monkeypatch.setattr(similarity, "UNCOUNTED_BYTES", 0)
    monkeypatch.setattr(similarity, "SENT_PAIRS", 1)
    monkeypatch.setattr(similarity, "TILE_ROWS", 16)
    monkeypatch.setattr(similarity, "TILE_PARTITIONS", 3)  # several tiles in a partition
    q_rows, v_rows, questions, vectors = frames(spark)
    # Values of another integer type, repeats and nulls among the scopes.
    questions = questions.withColumn("scopes", F.concat(F.col("scopes").cast("array<bigint>"), "scopes", F.array(F.lit(None).cast("bigint"))))
    hits = top_k(questions, vectors, scope=scope, threshold=-1.0).collect()
    assert {(r["question_id"], r["chunk_id"], r["rank"]) for r in hits} == brute(q_rows, v_rows, -1.0, "own", scope is not None)


@pytest.mark.parametrize("options", PLACEMENTS)
def test_similarities_nearer_than_single_precision(spark, options):
    """Differences of 1e-8 decide about rank and threshold."""
    cosines = [0.6 + i * 2e-8 for i in range(-40, 41)]
    vectors = spark.createDataFrame(
        [(f"c{i:03d}", [c, float(np.sqrt(1 - c * c))], 1) for i, c in enumerate(cosines)], V.replace("float", "double")
    )
    questions = spark.createDataFrame([(1, [1.0, 0.0], [1], 3)], Q)
    hits = top_k(questions, vectors, threshold=0.6, **options).orderBy("rank").collect()
    assert [r["chunk_id"] for r in hits] == ["c080", "c079", "c078"]
    assert similar_pairs(questions, vectors, threshold=0.6, **options).count() == 41


def test_places_of_few_and_many_true_values():
    rng = np.random.default_rng(2)
    for shape in [(512, 1024), (7, 13), (1, 3), (5, 0)]:
        for share in (0, 0.0005, 0.02, 0.5, 1):
            keep = rng.random(shape) < share
            assert similarity._true_places(keep).tolist() == np.flatnonzero(keep).tolist()


def test_product_of_a_search_stays_in_the_cache_of_a_core():
    assert similarity.QUESTIONS_PER_PRODUCT * similarity.VECTORS_PER_PRODUCT * 4 <= 2 * 1024 * 1024
