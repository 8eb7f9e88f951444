import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, salt string, host string, n string"


def words(rng, n, vocabulary=400):
    return " ".join("w%d" % rng.randrange(vocabulary) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and long texts, copies, repeated rows, and extra columns whose names clash."""
    rng = random.Random(5)
    long = words(rng, 6000, 5000)
    passage = words(rng, 90, 9000)
    texts = [None, "", "   \n\t ", "one", "a b c d", long, long, long + " tail", passage, "start " + passage + " end", "other words\n" + passage + "\nmore", "x" * 700, "é ü ß 日本語 \u00a0 z", "same line\nsame line\n\nsame line\n", "$ # | & %% <> *"]
    texts += [words(rng, rng.randrange(1, 120)) for _ in range(25)]
    rows = [(i, t, "en" if i % 3 else None, f"host{i % 4}" if i % 5 else None, len(t or ""), "b", "s", "h", "n") for i, t in enumerate(texts)]
    rows += [rows[3], rows[5], rows[20], (None, words(rng, 50), None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
