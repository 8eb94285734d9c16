"""Callers' columns pass through whatever their names and types."""

import pytest
from pyspark.sql import functions as F

from rideledger.llm import jaccard_join, language, licenses, line_dedup, mixing

NAMES = ["_id", "_tie", "_node", "_words", "_epoch", "_kept", "_gone", "_size", "_doc_id", "_number", "_play", "_text", "id", "tie", "h", "n", "size", "play", "gone",
         "words", "node", "same", "kept", "row", "column 0", "A b.c d"]
TEXT = "One line of a text that is long enough to be one.\nAnother line that has some words too."


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, TEXT, "a", "en"), (2, TEXT, "b", "en"), (3, None, None, None), (4, "", "a", "de"), (None, "Just a few more words here", "c", "en"), (4, "", "a", "de")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    return df.select("*", *[F.concat(F.lit(f"{name}:"), F.coalesce("source", F.lit("?"))).alias(name) for name in NAMES], F.create_map(F.lit("k"), "source").alias("m"))


def same(rows):
    for row in rows:
        for name in NAMES:
            assert row[name] == f"{name}:{row.source or '?'}", name
        assert row["m"] == {"k": row.source}


def test_line_dedup(docs):
    rows = line_dedup.deduplicated(docs).collect()
    same(rows)
    assert len(rows) == 6 and {row.doc_id: row._n_removed for row in rows}[2] == 2


def test_mixing(docs):
    df = mixing.mixture(docs)
    rows = df.collect()
    same(rows)
    assert df.columns == docs.columns and rows


def test_jaccard_join(docs):
    df = jaccard_join.without_copies(docs)
    rows = df.collect()
    same(rows)
    assert df.columns == docs.columns and sorted(repr(row.doc_id) for row in rows) == ["1", "3", "4", "4", "None"]


def test_licenses(docs):
    rows = licenses.scanned(docs).collect()
    same(rows)
    assert len(rows) == 6


def test_language(docs):
    model = language.trained([("en", ["some", "words"]), ("de", ["einige", "worte"])])
    rows = language.predicted(docs.withColumn("_pred", F.lit("mine")), model).collect()
    same(rows)
    assert len(rows) == 6 and {row._pred for row in rows} <= {"en", "de", "und"}


def test_added_names_are_taken_over(docs):
    assert line_dedup.deduplicated(docs.withColumn("_n_lines", F.lit("mine"))).columns.count("_n_lines") == 1
    assert licenses.scanned(docs.withColumn("_found", F.lit("mine"))).columns.count("_found") == 1


def test_sample_is_bounded_when_half_the_table_is_one_text(spark):
    rows = [(i, "immer der gleiche text mit worten" if i % 2 else f"text nummer {i} hat wort w{i}", "de") for i in range(4000)]
    rows += [(i, f"wort {i}", f"label{i % 100}") for i in range(4000, 4200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = language.segments_of(df)
    assert sum(label == "de" for label, _ in got) <= language.DOCS_PER_LANGUAGE * language.SEGMENTS_PER_DOC
    assert len({label for label, _ in got}) <= language.MOST_LANGUAGES
    assert sum(words[:2] == ["immer", "der"] for _, words in got) <= 1
