"""Awkward rows that every operator of the subpackage must take."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, shard string, hits int, label string, fp int"
LONG = "alpha beta gamma delta " * 20_000


def awkward_rows():
    base = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a"),
        (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a"),  # repeated row
        (2, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "b"),
        (3, None, "en", "a"),
        (4, "", None, "a"),
        (5, " \t\n ", "fr", None),
        (6, LONG, "en", "a"),
        (None, "an id is missing here, MIT License applies", "en", None),
        (None, None, None, None),
        (8, "12345 !!! ???", "de", "c"),
        (9, "Übergröße naïve café \U0001f600 <|endoftext|> done", "de", ""),
        (20, "one", "fr", "b"),
    ]
    return [(*r, None if r[1] is None else len(r[1]), 0.5, "x", "y", 7, "z", 1) for r in base]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
