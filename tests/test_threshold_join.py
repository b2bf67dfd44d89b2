import numpy as np
import pytest
from pyspark.sql import functions as F

from folioquery.operators import threshold_join as tj
from folioquery.operators.similarity import similar_pairs

Q = "question_id int, vector array<float>"
V = "chunk_id string, vector array<float>, document_id int"


def clustered(spark, n_vectors=600, n_questions=80, width=16, centres=12, noise=0.12, hot=0.35, seed=3):
    """Directions around a few centres; one direction is held by a third of all vectors."""
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, width))
    middle /= np.linalg.norm(middle, axis=1, keepdims=True)

    def draw(n):
        return (middle[rng.integers(0, centres, n)] + noise * rng.normal(size=(n, width)) / np.sqrt(width) * 2).astype(np.float32)

    vectors, questions = draw(n_vectors), draw(n_questions)
    vectors[rng.random(n_vectors) < hot] = vectors[0]
    vectors[7], questions[5] = 0, 0
    v_rows = [(f"c{i:05d}", v.tolist(), i % 9) for i, v in enumerate(vectors)]
    q_rows = [(i, q.tolist()) for i, q in enumerate(questions)]
    return q_rows, v_rows, spark.createDataFrame(q_rows, Q), spark.createDataFrame(v_rows, V)


def brute(q_rows, v_rows, threshold):
    out = []
    for qid, q in q_rows:
        for cid, v, *_ in v_rows:
            if q is None or v is None or len(q) != len(v) or not np.any(q) or not np.any(v):
                continue
            a, b = np.array(q, np.float32).astype(float), np.array(v, np.float32).astype(float)
            if round(float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))), 9) >= threshold:
                out.append((qid, cid))
    return sorted(out)


def rows(df):
    return sorted((r["question_id"], r["chunk_id"]) for r in df.select("question_id", "chunk_id").collect())


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0, "block_bytes": 8 * 16 * 50}])
@pytest.mark.parametrize("threshold", [0.9, 0.5, -0.2])
def test_pruned_join_equals_all_pairs(spark, threshold, options):
    q_rows, v_rows, questions, vectors = clustered(spark)
    found = tj.threshold_join(questions, vectors, threshold=threshold, most_share=1.0, **options)
    assert found.pruned == {16: True}
    expected = brute(q_rows, v_rows, threshold)
    assert expected and rows(found.pairs) == expected


def test_few_candidates_are_left_among_clusters(spark):
    q_rows, v_rows, questions, vectors = clustered(spark)
    found = tj.threshold_join(questions, vectors, threshold=0.9)
    assert found.pruned == {16: True}
    total = found.reads.agg(F.sum("candidates"), F.count("*")).first()
    assert total[1] == 79  # the zero question reads nothing
    assert len(brute(q_rows, v_rows, 0.9)) <= total[0] < 0.4 * 79 * 599


def test_every_match_lies_in_a_cell_that_is_read():
    rng = np.random.default_rng(11)
    for width, spread in ((2, 1.0), (3, 0.3), (24, 0.5)):
        centre = rng.normal(size=(5, width))
        units = tj.unit_rows(centre[rng.integers(0, 5, 400)] + spread * rng.normal(size=(400, width)))
        pivots = units[:20]
        sims = units @ pivots.T
        cell = sims.argmax(axis=1)
        angle = np.arccos(np.clip(sims[np.arange(400), cell], -1, 1))
        inner = np.array([angle[cell == c].min(initial=np.inf) for c in range(20)])
        outer = np.array([angle[cell == c].max(initial=-np.inf) for c in range(20)])
        cells = tj.Cells(pivots, inner, outer, np.bincount(cell, minlength=20))
        for threshold in (-0.5, 0.2, 0.7, 0.95, 1.0):
            may = tj.cells_in_reach(units, cells, threshold)
            q, v = np.nonzero(np.round(units @ units.T, 9) >= threshold)
            assert may[q, cell[v]].all()


def test_unstructured_vectors_take_the_plain_blocks(spark):
    rng = np.random.default_rng(2)
    v_rows = [(f"c{i}", x.astype(np.float32).tolist(), 0) for i, x in enumerate(rng.normal(size=(200, 16)))]
    q_rows = [(i, x.astype(np.float32).tolist()) for i, x in enumerate(rng.normal(size=(20, 16)))]
    found = tj.threshold_join(spark.createDataFrame(q_rows, Q), spark.createDataFrame(v_rows, V), threshold=0.1)
    assert found.pruned == {16: False}
    assert rows(found.pairs) == brute(q_rows, v_rows, 0.1)


def test_widths_nulls_repeats_and_payload(spark):
    v_rows = [("a", [1.0, 0.0], 1), ("a", [1.0, 0.0], 1), ("b", [0.0, 2.0], None), ("c", None, 3), ("d", [0.0, 0.0], 4),
              ("e", [1.0, 0.0, 0.0], 5), ("f", [], 6)]
    q_rows = [(1, [3.0, 0.0]), (1, [3.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [2.0, 0.0, 0.0]), (5, [1.0] * 5), (None, [0.0, 1.0])]
    questions, vectors = spark.createDataFrame(q_rows, Q), spark.createDataFrame(v_rows, V)
    # A column of the questions that clashes with one of the cells is no obstacle.
    clashing = questions.withColumn("scopes", F.array(F.lit(9))).withColumn("candidates", F.lit("x"))
    found = tj.threshold_join(clashing, vectors, threshold=0.5, carry=("document_id",), most_share=1.0)
    pairs = [(r["question_id"], r["chunk_id"], r["document_id"], r["similarity"]) for r in found.pairs.collect()]
    assert sorted(pairs, key=str) == sorted([(1, "a", 1, 1.0)] * 4 + [(None, "b", None, 1.0), (4, "e", 5, 1.0)], key=str)
    assert found.pairs.columns == similar_pairs(questions, vectors, carry=("document_id",)).columns


@pytest.mark.parametrize("empty", ["questions", "vectors", "both"])
def test_an_empty_side_gives_no_pairs(spark, empty):
    _, _, questions, vectors = clustered(spark, 20, 8)
    questions = questions.where("false") if empty != "vectors" else questions
    vectors = vectors.where("false") if empty != "questions" else vectors
    found = tj.threshold_join(questions, vectors)
    assert found.pairs.collect() == [] and found.reads.collect() == []
