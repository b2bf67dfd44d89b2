import random

import pytest
from pyspark.sql import functions as F

from folioquery.functions.keys import embedding_key, query_key
from folioquery.functions.retry import backoff_ms
from folioquery.functions.text import clean_text, preview, response_key_points, response_summary, sentences
from folioquery.functions.vectors import cosine_similarity, l2_normalize, vector_from_text, vector_to_text


def apply(spark, fn, values, kind="string"):
    frame = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r["x"] for r in frame.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_preview_cases(spark):
    words60 = " ".join(["word"] * 60)
    exact = "x" * 150
    cases = {
        "short": "short",
        exact: exact,
        "y" * 151: "y" * 150 + "...",
        words60: " ".join(["word"] * 30) + "...",
        "a" + " " + "b" * 200: "a...",
        " " + "b" * 200: " " + "b" * 149 + "...",
        "é" * 75: "é" * 75,
        "é" * 200: "é" * 75 + "...",
        "x" + "é" * 200: "x" + "é" * 74 + "�...",
    }
    assert apply(spark, preview, list(cases)) == list(cases.values())


def test_preview_equals_the_model(spark):
    def model(text):
        raw = text.encode()
        if len(raw) <= 150:
            return text
        at = raw[:150].rfind(b" ")
        return (raw[:at] if at > 0 else raw[:150]).decode(errors="replace") + "..."

    rng = random.Random(3)
    texts = ["".join(rng.choice("ab é") for _ in range(rng.randint(60, 200))) for _ in range(200)]
    assert apply(spark, preview, texts) == [model(t) for t in texts]


def test_clean_text(spark):
    cases = {
        " a\x00b \t\n c\x0bd\x7f ": "ab cd",
        "\x01\x02": "",
        "  x y 　": "x y",
        "a\r\nb": "a b",
    }
    assert apply(spark, clean_text, list(cases)) == list(cases.values())


def test_model_responses(spark):
    response = "A summary\n\n  goes here.\n- one\n * two\n-- three\n** bold\n\t-\tfour"
    assert apply(spark, response_summary, [response, "", "- only"]) == ["A summary goes here.", "", ""]
    # Only dashes, stars and blanks are stripped from the start of a bullet.
    assert apply(spark, response_key_points, [response, "none"]) == [["one", "two", "three", "bold", "\tfour"], []]


def test_sentences_keep_their_split_position(spark):
    found = apply(spark, sentences, ["One. Two!\n\nThree?  ", ""])
    assert [(s["pos"], s["sentence"]) for s in found[0]] == [(0, "One"), (1, "Two"), (2, "Three")]
    assert found[1] == []


def test_query_key(spark):
    import hashlib

    def key(question, ids, k):
        frame = spark.createDataFrame([(question, ids, k)], "q string, ids array<string>, k int")
        return frame.select(query_key(F.col("q"), F.col("ids"), F.col("k"))).first()[0]

    want = hashlib.sha256(b"q:What?|docs:A,B,a,a|k:5").hexdigest()
    assert key("What?", ["a", "B", "a", "A"], 5) == want  # byte order, case and repeats kept
    assert key("What?", ["A", "a", "a", "B"], 5) == want
    assert key("What?", ["A", "a", "B"], 5) != want
    assert key("What?", ["A", "a", "a", "B"], 6) != want
    assert apply(spark, embedding_key, ["What?"]) == [hashlib.sha256(b"What?").hexdigest()]


@pytest.mark.parametrize("attempt,base,want", [(0, 100, 100), (1, 100, 200), (2, 100, 400), (3, 100, 800), (4, 100, 1600), (2, 1000, 4000)])
def test_backoff(spark, attempt, base, want):
    assert apply(spark, lambda c: backoff_ms(c, base), [attempt], "int") == [want]



def test_normalization_and_similarity(spark):
    unit = apply(spark, l2_normalize, [[3.0, 4.0], [0.0, 0.0]], "array<double>")
    assert unit == [[0.6, 0.8], [0.0, 0.0]]
    pairs = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    sims = [r[0] for r in pairs.select(cosine_similarity(F.col("a"), F.col("b"))).collect()]
    assert sims[0] == pytest.approx(0.5**0.5) and sims[1] is None


def test_vector_text(spark):
    vectors = [[0.5, -1.0, 0.0001, 1e-7], [], [12345678.0]]
    texts = apply(spark, vector_to_text, vectors, "array<float>")
    assert texts == ["[0.5,-1,0.0001,0.0000001]", "[]", "[12345678]"]
    back = apply(spark, vector_from_text, texts)
    assert [[pytest.approx(x) for x in v] for v in vectors] == back
