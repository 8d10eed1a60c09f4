import random

import pytest


@pytest.fixture
def rng():
    return random.Random(7)


DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) rows, with columns whose names clash with those that operators use."""

    def make(rows, extra=True):
        df = spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], DOC)
        if extra:
            from pyspark.sql import functions as F

            for c in ("score", "n", "key", "rep", "hash", "kept", "start", "component", "items"):
                df = df.withColumn(c, F.lit(None).cast("string"))
        return df

    return make


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "two words"), (None, None), (6, "A b c d e f"), (7, "a B c d e f"), (8, "x" * 5000), (9, "é中 ß. " * 40)]


@pytest.fixture
def odd():
    return list(ODD)
