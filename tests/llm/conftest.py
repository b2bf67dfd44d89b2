import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that the operators use inside.
        T.StructField("score", T.StringType()),
        T.StructField("line", T.StringType()),
        T.StructField("block", T.StringType()),
    ]
)
LABELS = "doc_id long, quality int, toxic int, score string"

LONG = " ".join(f"w{i % 977}{'x' * (i % 7)}" for i in range(60_000))
TEXTS = [
    "the quick brown fox jumps over the lazy dog. It was late.",
    "the quick brown fox jumps over the lazy dog. It was late.",  # copy
    "the quick brown fox jumps over the lazy cat. It was late.\nA second line\n\nA second line",
    None,
    "",
    "   \n\t ",
    "Ünïcode – ça va? 日本語のテキスト 😀 it's they'll    　x",
    "special <|endoftext|> inside <|endoftext|>",
    "a" * 5000,
    LONG,
    "A second line\nthe quick brown fox jumps over the lazy dog. It was late. Indeed",
]


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text): ids not in order, a repeated row, a null id."""
    out = [((i * 7) % 11, text) for i, text in enumerate(TEXTS)]
    return [*out, out[0], (None, "no id at all, only text")]


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows, lang="en"):
        data = [(i, t, lang, "src", None if t is None else len(t), "s", "l", "b") for i, t in rows]
        return spark.createDataFrame(data, SCHEMA)

    return make


@pytest.fixture(scope="session")
def docs(frame, rows):
    return frame(rows).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(frame):
    return frame([])


@pytest.fixture(scope="session")
def labels(spark):
    return lambda rows: spark.createDataFrame([(*r, "x") for r in rows], LABELS)


@pytest.fixture(scope="session")
def corpus(spark, data):
    """Ids and texts of the small test corpus."""
    found = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    return {r["doc_id"]: r["text"] or "" for r in found}
