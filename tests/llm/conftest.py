from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, fp long, hash long, `_spans` string"


def prose(k: int, words: int) -> str:
    """Words that no other number shares."""
    return " ".join(f"w{k}x{i * 7919 % 10007}" for i in range(words))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empties, a long text, ties, repeated rows, and columns whose names clash."""
    long_text = "\n".join(f"line {i} of {prose(9, 12)}." for i in range(800))
    rows = [
        (1, prose(1, 60)), (1, prose(1, 60)), (2, prose(1, 60)), (3, None), (4, ""), (None, prose(2, 80)),
        (None, None), (5, long_text), (6, " \t\n "), (7, "a"), (8, "日本 😀 " * 30), (9, "x" * 3000),
        (10, prose(3, 40) + " " + prose(4, 50)), (11, prose(4, 50) + " " + prose(5, 40)),
    ]
    return spark.createDataFrame([(i, t, "en", 1, 2, "s") for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)

