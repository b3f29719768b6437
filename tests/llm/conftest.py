import pytest

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string, source string, n_chars long, row_id long, row string, _key string, ids string"


@pytest.fixture
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, and
    columns whose names the operators use themselves."""
    long = " ".join(f"word{i % 97}x{i % 13}" for i in range(3_000))
    rows = [
        (1, "Hello the World and the rest", "en"),
        (2, "hello THE world and the rest", "en"),
        (3, None, "en"),
        (4, "", None),
        (5, "   \n\t ", "de"),
        (6, "one", "en"),
        (7, "One", None),
        (8, long, "en"),
        (9, long.upper(), "en"),
        (9, long.upper(), "en"),
        (None, "hello the world and the rest", None),
        (None, None, None),
        (10, "ÉCOLE école ▁ 日本 \x00 ok", "fr"),
        (10, "another text of the same id", "en"),
        (11, "!!! 123 ###", "en"),
    ]
    return spark.createDataFrame([(i, t, lang, None, None, 5, "r", "k", "i") for i, t, lang in rows], ODD)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], ODD)


@pytest.fixture
def tables():
    """The smallest tables as they lie."""
    return SF
