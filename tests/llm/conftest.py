import pytest

EXTRA = ["fp", "key", "n", "at", "line", "h", "start", "words", "k", "v", "component", "node", "row", "context", "tokens", "n_lines", "y", "class_id", "hash", "size", "row_0", "lines_0", "dropped_0", "_dropped_lines", "leaf", "whole", "id", "bands", "first", "part", "wanted", "pattern"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) with columns whose names the operators use themselves."""

    def f(rows):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *["x"] * len(EXTRA)) for i, t in rows], SCHEMA)

    return f


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empty and blank texts, repeated rows, one word, long texts, odd characters."""
    long = " ".join(f"w{i % 997}x{i % 13}" for i in range(60_000))
    rows = [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "two words"), (6, "a b c d e f g h i j k l m n"), (6, "a b c d e f g h i j k l m n"),
        (None, "no id here but words enough to count as a text"), (None, None), (7, long), (8, long), (9, "x" * 200_000),
        (10, "é 漢字 😀 'll 're \x00 end\r\nnext\n\n"), (11, "\n" * 5000), (-5, "negative id " * 30),
    ]
    return make(rows)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
