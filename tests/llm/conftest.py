import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """``docs([(id, text), ...])`` with the columns of documents, and columns that clash with those inside."""

    def make(rows, extra=True):
        out = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], SCHEMA)
        return out.selectExpr("*", "1 AS id", "2 AS rep", "'x' AS key", "3 AS shard", "4 AS size", "'y' AS base", "'z' AS score") if extra else out

    return make


@pytest.fixture
def prose():
    """``prose(seed, n)``: n words of a small vocabulary."""

    def make(seed, n, words=400):
        r = random.Random(seed)
        return " ".join(f"w{r.randrange(words)}" + r.choice(["", "", "", ",", ".\n"]) for _ in range(n))

    return make


#: Null, empty, blank and odd texts that every operator must take.
ODD = [None, "", " \n\t ", "one", "two words", "a b c", "été 日本", "x" * 5000, "same " * 300]
