"""Stages of the pipeline on clashing names, null labels, repeated rows and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id long, _h long, _several boolean, n_lines int, n_removed int, n_runs int, score double, topic string, probability double, _row int, _number int"


@pytest.fixture(scope="module")
def docs(spark):
    line = "this very same line of text stands in more than one of the documents here"
    texts = [(1, f"{line}\n{line} again\nown words of one"), (2, f"{line}\n{line} again\nother words of two"), (3, "alone " * 30), (3, "alone " * 30), (4, None), (5, ""), (None, "no id"), (6, "alone " * 30 + "more")]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, 8, True, 9, 10, 11, 0.5, "t", 0.25, 12, 13) for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('labels')}"
    spark.createDataFrame([(1, None, None), (2, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


STAGES = dict(corpus_pipeline.STAGES[:-1])


@pytest.mark.parametrize("name", sorted(STAGES))
def test_columns_and_their_values_stay(name, spark, docs, folder):
    found = STAGES[name](spark, docs, folder)
    assert found.columns == docs.columns and found.dtypes == docs.dtypes
    rows = found.collect()
    assert rows and all((r["_id"], r["_h"], r["n_lines"], r["n_removed"], r["n_runs"], r["score"], r["topic"], r["probability"], r["_row"], r["_number"]) == (7, 8, 9, 10, 11, 0.5, "t", 0.25, 12, 13) for r in rows)


def test_near_copies_and_lines(spark, docs, folder):
    # A document that repeats one word has one shingle; one with a word more has two.
    kept = sorted((r.doc_id or 0) for r in corpus_pipeline.dedup_near(spark, docs, folder).collect())
    assert kept == [0, 1, 2, 3, 4, 5, 6]
    texts = {r.doc_id: r.text for r in corpus_pipeline.dedup_lines(spark, docs, folder).collect() if r.doc_id in (1, 2)}
    assert texts[1].count("\n") == 2 and texts[2] == "other words of two"


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_tables(name, spark, docs, folder):
    assert dict(corpus_pipeline.STAGES)[name](spark, docs.where(F.lit(False)), folder).count() == 0
