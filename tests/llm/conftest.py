import random

import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every awkward case, and columns named like those the operators make."""
    rng = random.Random(5)
    long = " ".join(rng.choice(["anre", "thes", "ontion", "of", "the", "écla"]) for _ in range(60_000))
    rows = [
        (1, None, "en"), (2, "", "en"), (3, long, "en"), (4, "one", None), (5, "one", "en"), (6, "ONE", "fr"),
        (7, "123 ... +++", "en"), (8, "The cat sat on the mat.\nIt was Ünïcode 日本語 \U0001f600.\n", "en"),
        (None, "the text of a row without an id", "en"), (None, "the text of a row without an id", "en"),
        (9, "twice the same row", "en"), (9, "twice the same row", "en"), (10, "x" * 3000, "de"),
        (11, "\n\n \t", None), (12, long + " tail", "en"),
    ]
    wide = [(*r, "src", 1, "a", 0, 0, "p", "d") for r in rows]
    return spark.createDataFrame(
        wide,
        "doc_id bigint, text string, lang string, source string, n_chars bigint, print string, shard int,"
        " part int, data string, found string",
    ).repartition(3)


@pytest.fixture(scope="session")
def texts(spark):
    """The small documents table, with its rows."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return docs, {r.doc_id: r for r in docs.collect()}
