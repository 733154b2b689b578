import random

import pytest

ROWS = "doc_id long, text string, lang string, source string, n_chars long, q string, gone int, _th string, kept int, cls string, text_x string"


def prose(rng: random.Random, n: int, words: int = 400) -> str:
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def table(spark, texts, first: int = 0):
    """Documents with the given texts and further columns whose names could clash with an operator's own."""
    rows = [(first + i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, None if t is None else len(t), "q", 1, "h", 0, "c", "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, ROWS)


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, short, marks only, repeated and very long texts."""
    rng = random.Random(8)
    return [None, "", " \t\n\r ", "one", "a b c d", "!!! ???", "\n\n\n", prose(rng, 30), prose(rng, 30_000, 900), "x" * 200_000, "é漢字 ünï", "one", "\x00\x01 \x85 nul"]


@pytest.fixture
def odd(spark, odd_texts):
    """The odd texts, two rows that repeat one, and one without an id."""
    rows = table(spark, odd_texts)
    again = rows.where("doc_id = 7")
    return rows.unionByName(again).unionByName(rows.where("doc_id = 7").selectExpr("cast(null as long) as doc_id", *[c for c in rows.columns if c != "doc_id"]))


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], ROWS)
