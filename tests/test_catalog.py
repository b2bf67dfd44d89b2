"""Every registered query against its SQL twin, and the contract of the entry file."""

import importlib

import pytest

from check import compare, connect
from folioquery.catalog import all_queries, all_sql

ROWS_ONLY = {"topk_ivf", "ivf_recall"}


@pytest.fixture(scope="module")
def twins(data):
    return connect(data)


def test_all_queries_but_the_approximate_ones_have_sql():
    assert set(all_queries()) - set(all_sql()) == ROWS_ONLY


@pytest.mark.parametrize("name", list(all_queries()))
def test_query_equals_sql(spark, twins, data, name):
    assert compare(spark, twins, data, name) == ""


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    frame = entry.entry(spark)
    assert {"question_id", "rank", "chunk_id", "similarity", "summary"} <= set(frame.columns)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("missing", ["folioquery.llm.queries", "xxhash", "corpus_pipeline"])
def test_entry_without_the_corpus_operators(monkeypatch, missing):
    """Whatever the corpus operators lack, the other queries are there."""
    import sys

    entry = importlib.import_module("__spark_entry__")
    for name in [n for n in sys.modules if n.startswith("folioquery.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, missing, None)
    assert set(all_queries()) <= set(entry.queries()) and set(all_sql()) <= set(entry.oracle_sql())
    assert "pipeline" not in entry.queries()
