"""Queries over the stored vectors: similarity, top-k, inverted file, vector forms."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.catalog import query
from folioquery.catalog.inputs import words_sql
from folioquery.functions.text import words
from folioquery.functions.vectors import cosine_similarity, l2_normalize, vector_from_text, vector_to_text
from folioquery.operators.embedding import embedding_width_violations
from folioquery.operators.ivf import build_inverted_file, inverted_file_of, list_reach, recall, top_k_ivf, top_k_ivf_exact
from folioquery.operators.retrieval import attach_chunks, attach_summaries
from folioquery.operators.similarity import similar_pairs, top_k, width_mismatches
from folioquery.operators.threshold_join import threshold_join
from folioquery.session import materialize, run_folder
from folioquery.sources.files import read_table
from folioquery.sources.index import build_index, open_index
from folioquery.sources.store import delete_documents, load_tables, register_model, save_tables, violations

THRESHOLD, K = 0.3, 5
LISTS = 10


def stored_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """embeddings: the label stands for the document of a vector."""
    return read_table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.col("label").alias("document_id")
    )


def vector_questions(spark: SparkSession, folder: str) -> DataFrame:
    """One question per pair of neighbouring vectors: their sum, asked of both documents."""
    stored = stored_vectors(spark, folder)
    following = stored.select(
        (F.col("chunk_id") - 1).alias("chunk_id"), F.col("vector").alias("next"), F.col("document_id").alias("other")
    )
    total = F.zip_with(F.col("vector").cast("array<double>"), F.col("next").cast("array<double>"), lambda x, y: x + y)
    return stored.join(following, "chunk_id").select(
        F.col("chunk_id").alias("question_id"), total.alias("vector"), F.array("document_id", "other").alias("scopes")
    )


def label_means(stored: DataFrame) -> np.ndarray:
    """The mean vector of each label, by label."""
    places = stored.select("document_id", F.posexplode(F.col("vector").cast("array<double>")).alias("i", "x"))
    means = places.groupBy("document_id", "i").agg(F.avg("x").alias("x"))
    lists = means.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("c"))
    # As many rows as there are labels.
    return np.array([[c["x"] for c in row["c"]] for row in lists.orderBy("document_id").collect()])


QUESTIONS = """
q AS (
  SELECT a.vec_id AS question_id, a.label AS one, b.label AS other,
         list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda p: p[1] + p[2]) AS qv
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
p AS (
  SELECT question_id, vec_id AS chunk_id, label, one, other,
         round(list_cosine_similarity(qv, CAST(embedding AS DOUBLE[])), 9) AS similarity
  FROM q, embeddings)"""


def _top_sql(condition: str = "true", bound: str = str(K)) -> str:
    return f"""
WITH {QUESTIONS}, r AS (
  SELECT question_id, chunk_id, similarity,
         row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC, chunk_id) AS rank
  FROM p WHERE similarity >= {THRESHOLD} AND {condition}),
t AS (SELECT question_id, chunk_id, CAST(rank AS INTEGER) AS rank, similarity FROM r WHERE rank <= {bound})"""


_ROUNDED = "question_id, chunk_id, rank, round(similarity, 6) AS similarity"


def rounded(hits: DataFrame) -> DataFrame:
    return hits.withColumn("similarity", F.round("similarity", 6))


@query("topk_exact", f"{_top_sql()} SELECT {_ROUNDED} FROM t")
def _topk(spark: SparkSession, folder: str) -> DataFrame:
    hits = top_k(vector_questions(spark, folder), stored_vectors(spark, folder), threshold=THRESHOLD, k=K)
    return rounded(hits)


@query("topk_exact_blocks", f"{_top_sql()} SELECT {_ROUNDED} FROM t")
def _topk_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The same with both sides cut into blocks, as for more questions than fit a broadcast."""
    hits = top_k(
        vector_questions(spark, folder), stored_vectors(spark, folder), threshold=THRESHOLD, k=K,
        broadcast_bytes=0, block_bytes=128 * 1024,
    )
    return rounded(hits)


@query("topk_per_request_k", f"{_top_sql(bound='question_id % 20 + 1')} SELECT {_ROUNDED} FROM t")
def _topk_own_k(spark: SparkSession, folder: str) -> DataFrame:
    questions = vector_questions(spark, folder).withColumn("top_k", (F.col("question_id") % 20 + 1).cast("int"))
    return rounded(top_k(questions, stored_vectors(spark, folder), threshold=THRESHOLD))


@query("retrieve_filtered", f"{_top_sql('label IN (one, other)')} SELECT {_ROUNDED} FROM t")
def _filtered(spark: SparkSession, folder: str) -> DataFrame:
    hits = top_k(
        vector_questions(spark, folder), stored_vectors(spark, folder), threshold=THRESHOLD, k=K, scope="document_id"
    )
    return rounded(hits)


@query("retrieve_filtered_blocks", f"{_top_sql('label IN (one, other)')} SELECT {_ROUNDED} FROM t")
def _filtered_blocks(spark: SparkSession, folder: str) -> DataFrame:
    hits = top_k(
        vector_questions(spark, folder), stored_vectors(spark, folder), threshold=THRESHOLD, k=K, scope="document_id",
        broadcast_bytes=0, block_bytes=16 * 1024,
    )
    return rounded(hits)


_PAIRS = f"WITH {QUESTIONS} SELECT question_id, chunk_id, round(similarity, 6) AS similarity FROM p"


@query("similarity_threshold", f"{_PAIRS} WHERE similarity >= 0.7")
def _threshold(spark: SparkSession, folder: str) -> DataFrame:
    pairs = similar_pairs(vector_questions(spark, folder), stored_vectors(spark, folder))
    return rounded(pairs.drop("top_k"))


@query("similarity_join", f"{_PAIRS} WHERE similarity >= {THRESHOLD}")
def _similarity_join(spark: SparkSession, folder: str) -> DataFrame:
    pairs = similar_pairs(vector_questions(spark, folder), stored_vectors(spark, folder), threshold=THRESHOLD)
    return rounded(pairs.drop("top_k"))


@query("similarity_join_pruned", f"{_PAIRS} WHERE similarity >= {THRESHOLD}")
def _similarity_join_pruned(spark: SparkSession, folder: str) -> DataFrame:
    """The same through cells that bounds leave, on every table (most_share)."""
    found = threshold_join(
        vector_questions(spark, folder), stored_vectors(spark, folder), threshold=THRESHOLD, most_share=1.0,
        broadcast_bytes=0, block_bytes=128 * 1024,
    )
    return rounded(found.pairs.drop("top_k"))


HIGH = 0.7


@query(
    "similarity_join_reads",
    f"""
WITH {QUESTIONS},
places AS (SELECT label, unnest(range(0, len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
means AS (SELECT label, i, avg(x) AS x FROM places GROUP BY ALL),
pivots AS (SELECT label AS cell, list(x ORDER BY i) AS c FROM means GROUP BY label),
member AS (
  SELECT vec_id, cell, acos(least(1, list_cosine_similarity(CAST(embedding AS DOUBLE[]), c))) AS angle FROM embeddings, pivots
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), c) DESC, cell) = 1),
cells AS (SELECT cell, c, min(angle) AS inside, max(angle) AS outside, count(*) AS n FROM member JOIN pivots USING (cell) GROUP BY ALL),
gaps AS (
  SELECT a.cell AS cell, b.cell AS near, sqrt(greatest(0, 2 - 2 * list_cosine_similarity(a.c, b.c))) AS gap FROM pivots a, pivots b),
s AS (SELECT question_id, cell, list_cosine_similarity(qv, c) AS sim FROM q, pivots),
best AS (
  SELECT question_id, cell AS near, sim AS top FROM s QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY sim DESC, cell) = 1),
least_angle AS (
  SELECT question_id, cell, n, greatest(
    0, acos(least(1, sim)) - outside, inside - acos(least(1, sim)),
    CASE WHEN gap > 1e-6 THEN asin(least(1, (top - sim) / gap)) ELSE 0 END) AS angle
  FROM s JOIN best USING (question_id) JOIN gaps USING (cell, near) JOIN cells USING (cell))
SELECT question_id, CAST(count(*) FILTER (WHERE cos(angle) >= {HIGH} - 1e-6) AS INTEGER) AS cells_read,
       CAST(coalesce(sum(n) FILTER (WHERE cos(angle) >= {HIGH} - 1e-6), 0) AS BIGINT) AS candidates
FROM least_angle GROUP BY question_id""",
)
def _similarity_join_reads(spark: SparkSession, folder: str) -> DataFrame:
    """How many cells and pairs the bounds leave to each question, around the mean vectors of the labels."""
    stored = stored_vectors(spark, folder)
    return threshold_join(
        vector_questions(spark, folder), stored, threshold=HIGH, pivots=label_means(stored), most_share=1.0
    ).reads


@query(
    "cosine_pairs",
    """
SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def _cosine(spark: SparkSession, folder: str) -> DataFrame:
    stored = stored_vectors(spark, folder)
    following = stored.select((F.col("chunk_id") - 1).alias("chunk_id"), F.col("vector").alias("next"))
    return stored.join(following, "chunk_id").select(
        F.col("chunk_id").alias("vec_id"),
        F.round(cosine_similarity(F.col("vector"), F.col("next")), 6).alias("similarity"),
    )


def text_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunk rows of the stored vectors: the document of the same number gives the text."""
    texts = read_table(spark, folder, "documents").select(
        F.col("doc_id").alias("chunk_id"), "text", F.size(words(F.col("text"))).alias("token_count")
    )
    return stored_vectors(spark, folder).select("chunk_id", "document_id").join(texts, "chunk_id")


@query(
    "retrieve_with_chunks",
    f"""{_top_sql()}
SELECT {_ROUNDED}, label AS document_id, text, CAST(len({words_sql('text')}) AS INTEGER) AS token_count
FROM t JOIN embeddings ON vec_id = chunk_id JOIN documents ON doc_id = chunk_id""",
)
def _with_chunks(spark: SparkSession, folder: str) -> DataFrame:
    hits = top_k(vector_questions(spark, folder), stored_vectors(spark, folder), threshold=THRESHOLD, k=K)
    return rounded(attach_chunks(hits, text_chunks(spark, folder)))


def label_summaries(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "labels").select(
        F.col("doc_id").alias("document_id"),
        F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("summary"),
        F.array(F.concat(F.lit("toxic "), F.col("toxic").cast("string"))).alias("key_points"),
    )


@query(
    "retrieve_with_summary",
    f"""{_top_sql()}
SELECT {_ROUNDED}, embeddings.label AS document_id,
       CASE WHEN l.doc_id IS NULL THEN '' ELSE concat('quality ', quality) END AS summary,
       CASE WHEN l.doc_id IS NULL THEN '' ELSE concat('toxic ', toxic) END AS key_points
FROM t JOIN embeddings ON vec_id = chunk_id LEFT JOIN labels l ON l.doc_id = embeddings.label""",
)
def _with_summary(spark: SparkSession, folder: str) -> DataFrame:
    stored = stored_vectors(spark, folder)
    hits = top_k(vector_questions(spark, folder), stored, threshold=THRESHOLD, k=K)
    with_documents = attach_chunks(hits, stored.select("chunk_id", "document_id"))
    with_summaries = attach_summaries(with_documents, label_summaries(spark, folder))
    return rounded(with_summaries).withColumn("key_points", F.array_join("key_points", "|"))


@query("topk_ivf")
def _ivf(spark: SparkSession, folder: str) -> DataFrame:
    index = build_inverted_file(stored_vectors(spark, folder), LISTS)
    return rounded(top_k_ivf(vector_questions(spark, folder), index, nprobe=3, threshold=THRESHOLD, k=K))


@query("topk_ivf_all_lists", f"{_top_sql()} SELECT {_ROUNDED} FROM t")
def _ivf_all(spark: SparkSession, folder: str) -> DataFrame:
    """Probing all lists is exact."""
    index = build_inverted_file(stored_vectors(spark, folder), LISTS)
    return rounded(top_k_ivf(vector_questions(spark, folder), index, nprobe=LISTS, threshold=THRESHOLD, k=K))


@query(
    "topk_ivf_label_lists",
    f"""
WITH {QUESTIONS},
places AS (SELECT label, unnest(range(0, len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
means AS (SELECT label, i, avg(x) AS x FROM places GROUP BY ALL),
lists AS (SELECT label AS list_id, list(x ORDER BY i) AS c FROM means GROUP BY label),
member AS (
  SELECT vec_id AS chunk_id, list_id FROM embeddings, lists
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), c) DESC, list_id) = 1),
probed AS (
  SELECT question_id, list_id FROM q, lists
  QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY list_cosine_similarity(qv, c) DESC, list_id) <= 3),
r AS (
  SELECT question_id, chunk_id, similarity, row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC, chunk_id) AS rank
  FROM p JOIN member USING (chunk_id) JOIN probed USING (question_id, list_id) WHERE similarity >= {THRESHOLD})
SELECT question_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(similarity, 6) AS similarity FROM r WHERE rank <= {K}""",
)
def _ivf_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Lists around the mean vector of each label instead of k-means: three lists are probed."""
    stored = stored_vectors(spark, folder)
    centroids = label_means(stored)
    index = inverted_file_of(stored, centroids)
    return rounded(top_k_ivf(vector_questions(spark, folder), index, nprobe=3, threshold=THRESHOLD, k=K))


@query("topk_ivf_filtered", f"{_top_sql('label IN (one, other)')} SELECT {_ROUNDED} FROM t")
def _ivf_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """All lists, restricted to the asked documents: exact as well."""
    index = build_inverted_file(stored_vectors(spark, folder), LISTS)
    questions = vector_questions(spark, folder)
    return rounded(top_k_ivf(questions, index, nprobe=LISTS, within="document_id", threshold=THRESHOLD, k=K))


@query("ivf_recall")
def _ivf_recall(spark: SparkSession, folder: str) -> DataFrame:
    stored, questions = stored_vectors(spark, folder), vector_questions(spark, folder)
    exact = materialize(top_k(questions, stored, threshold=-1.0, k=K), "exact-hits")
    index = build_inverted_file(stored, LISTS)
    index = replace(index, vectors=materialize(index.vectors, "listed-vectors"))
    table = None
    for nprobe in (1, 2, 5, LISTS):
        found = top_k_ivf(questions, index, nprobe=nprobe, threshold=-1.0, k=K)
        row = recall(found, exact).select(F.lit(LISTS).alias("lists"), F.lit(nprobe).alias("nprobe"), "*")
        table = row if table is None else table.unionByName(row)
    return table


@query("topk_ivf_exact", f"{_top_sql()} SELECT {_ROUNDED} FROM t")
def _ivf_exact(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest list first, then those whose reach allows a better hit: exact."""
    index = build_inverted_file(stored_vectors(spark, folder), LISTS)
    index = replace(index, vectors=materialize(index.vectors, "listed-vectors"))
    index = replace(index, reach=list_reach(index.vectors, index.centroids))
    hits, _ = top_k_ivf_exact(vector_questions(spark, folder), index, k=K, threshold=THRESHOLD)
    return rounded(hits)


def _collections(vectors: DataFrame) -> dict[str, DataFrame]:
    """The tables of a store whose documents are the labels."""
    documents = vectors.select("document_id").distinct().select("document_id", F.lit("ready").alias("status"))
    return {"documents": documents, "embeddings": vectors.withColumn("model", F.lit("given"))}


_MIXED = 32  # width of the vectors of label 0, and of the questions that begin in label 9


@query(
    "topk_mixed_width",
    f"""{_top_sql('label <> 0 AND one <> 9')}
SELECT 'hit' AS kind, question_id AS id, chunk_id, rank, round(similarity, 6) AS similarity, CAST(NULL AS INTEGER) AS width FROM t
UNION ALL SELECT 'question', question_id, NULL, NULL, NULL, {_MIXED} FROM q WHERE one = 9
UNION ALL SELECT 'vector', vec_id, NULL, NULL, NULL, {_MIXED} FROM embeddings WHERE label = 0""",
)
def _mixed_width(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors and questions of another width than the registered one are reported and change nothing for the others."""
    path = run_folder(spark, "widths")
    short = F.when(F.col("document_id") == 0, F.slice("vector", 1, _MIXED)).otherwise(F.col("vector"))
    register_model(spark, path, "given", 64)
    save_tables(_collections(stored_vectors(spark, folder).withColumn("vector", short)), path, "0")
    stored = load_tables(spark, path)["embeddings"]
    asked = F.when(F.element_at("scopes", 1) == 9, F.slice("vector", 1, _MIXED)).otherwise(F.col("vector"))
    questions = vector_questions(spark, folder).withColumn("vector", asked)
    hits = rounded(top_k(questions, stored, threshold=THRESHOLD, k=K)).withColumnRenamed("question_id", "id")
    unanswered = width_mismatches(questions, stored).withColumnRenamed("question_id", "id")
    aside = violations(spark, path).select(F.col("chunk_id").alias("id"), "width")
    rows = hits.select(F.lit("hit").alias("kind"), "id", "chunk_id", "rank", "similarity")
    for kind, other in (("question", unanswered), ("vector", aside)):
        rows = rows.unionByName(other.select(F.lit(kind).alias("kind"), "id", "width"), allowMissingColumns=True)
    return rows


@query(
    "index_follows_store",
    f"""
WITH {QUESTIONS.replace('CAST(embedding AS DOUBLE[])), 9)', 'CASE WHEN label = 3 THEN list_transform(CAST(embedding AS DOUBLE[]), lambda x: -x) ELSE CAST(embedding AS DOUBLE[]) END), 9)')},
r AS (
  SELECT question_id, chunk_id, similarity, row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC, chunk_id) AS rank
  FROM p WHERE similarity >= {THRESHOLD} AND label <> 5)
SELECT question_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(similarity, 6) AS similarity FROM r WHERE rank <= {K}""",
)
def _index_follows(spark: SparkSession, folder: str) -> DataFrame:
    """An index over a store whose label 3 came again with other vectors, and whose label 5 was deleted."""
    path, index = run_folder(spark, "indexed"), run_folder(spark, "index")
    stored = stored_vectors(spark, folder)
    register_model(spark, path, "given", 64)
    save_tables(_collections(stored), path, "0")
    build_index(spark, path, index, LISTS)
    again = stored.where("document_id = 3").withColumn("vector", F.transform("vector", lambda x: -x))
    save_tables(_collections(again), path, "1")
    delete_documents(stored.where("document_id = 5").select("document_id"), path)
    hits, _ = top_k_ivf_exact(vector_questions(spark, folder), open_index(spark, path, index), k=K, threshold=THRESHOLD)
    return rounded(hits)


@query(
    "l2_normalize",
    """
WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CASE WHEN label = 0 THEN 0 ELSE 3 * x END) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v)
SELECT vec_id, unnest(range(0, len(v))) AS pos, round(unnest(list_transform(v, lambda x: CASE WHEN n = 0 THEN x ELSE x / n END)), 6) AS value
FROM n""",
)
def _normalize(spark: SparkSession, folder: str) -> DataFrame:
    stored = stored_vectors(spark, folder)
    scaled = F.transform(
        F.col("vector").cast("array<double>"), lambda x: F.when(F.col("document_id") == 0, F.lit(0.0)).otherwise(3 * x)
    )
    unit = stored.select(F.col("chunk_id").alias("vec_id"), scaled.alias("v")).select(
        "vec_id", F.posexplode(l2_normalize(F.col("v"))).alias("pos", "value")
    )
    return unit.select("vec_id", F.col("pos").cast("bigint").alias("pos"), F.round("value", 6).alias("value"))


@query(
    "embedding_width_check",
    "SELECT vec_id, CAST(64 - label AS INTEGER) AS width FROM embeddings WHERE label <> 0",
)
def _width(spark: SparkSession, folder: str) -> DataFrame:
    cut = stored_vectors(spark, folder).select(
        F.col("chunk_id").alias("vec_id"), F.slice("vector", 1, F.size("vector") - F.col("document_id")).alias("vector")
    )
    return embedding_width_violations(cut, 64).select("vec_id", F.size("vector").alias("width"))


@query(
    "vector_text_roundtrip",
    """
SELECT vec_id, unnest(range(0, len(embedding))) AS pos, round(CAST(unnest(embedding) AS DOUBLE), 6) AS value
FROM embeddings""",
)
def _roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    texts = stored_vectors(spark, folder).select(
        F.col("chunk_id").alias("vec_id"), vector_to_text(F.col("vector")).alias("text")
    )
    values = texts.select("vec_id", F.posexplode(vector_from_text(F.col("text"))).alias("pos", "value"))
    return values.select(
        "vec_id", F.col("pos").cast("bigint").alias("pos"), F.round(F.col("value").cast("double"), 6).alias("value")
    )
