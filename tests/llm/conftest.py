import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, n bigint, key string, bin int, score double, taken int, uid int, list int"
MORE = (1, 2, "k", 3, 0.5, 4, 5, 6)


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), *MORE)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, repeated rows, ties, and columns whose names clash."""
    words = " ".join(f"word{i}" for i in range(60))
    return [
        row(1, words),
        row(1, words),
        row(2, words),
        row(3, None),
        row(4, ""),
        row(5, " \n\t "),
        row(None, "a b c", None, None),
        row(None, words + " more", None, None),
        row(6, "x" * 300_000),
        row(7, " ".join(f"long{i}" for i in range(60_000)), "de", None),
        row(8, "one"),
        row(9, "ONE"),
        row(10, "é\U0001f600 　z", None, "b"),
        (None, None, None, None, None, *[None] * len(MORE)),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
