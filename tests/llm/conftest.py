"""Awkward documents for all operators: nulls in every column, empty, blank and very long texts, repeated rows, clashing columns."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from awkward import rows  # noqa: E402

#: Names the operators use for their own columns.
CLASH = ["score", "ids", "code", "fingerprint", "n_values", "kinds", "lines_dropped", "words_dropped", "payload", "error", "size", "target", "spot", "token", "place", "block", "hash", "first", "decoded", "media", "label", "matches"]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def clashing(docs):
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit("other").alias(c) for c in CLASH])


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("false")
