import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SMALL = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog and runs far away\nAll rights reserved now", "a"),
        (2, "the quick brown fox jumps over the lazy dog and runs far away\nAll rights reserved now", "b"),
        (2, "the quick brown fox jumps over the lazy dog and runs far away\nAll rights reserved now", "b"),
        (3, None, "a"),
        (4, "", None),
        (5, " \t\n ", "c"),
        (None, "no id here but words enough to be kept by every rule that counts", "d"),
        (None, None, None),
        (6, LONG, "e"),
        (7, LONG + " and a tail", "f"),
        (8, "All rights reserved now\nsome more words", "e"),
        (9, "short", "g"),
    ]
    return spark.createDataFrame(
        [(*r, 7, "x", 1.5, True) for r in rows],
        "doc_id long, text string, source string, n_words int, line string, score double, kept boolean",
    )


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
