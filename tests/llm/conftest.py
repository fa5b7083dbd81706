import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids and texts, empty, blank and long texts, repeated rows, ties and clashing column names."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(40_000))
    rows = [(1, "alpha beta gamma delta epsilon", "en", "a"), (1, "alpha beta gamma delta epsilon", "en", "a"), (2, None, None, None), (None, "alpha beta gamma delta epsilon", None, "a"), (3, "", "en", None), (4, " \n\t ", "en", "b"), (5, long, "en", "b"), (6, long + " tail", "en", "b"), (7, "ÀÉ ñandú çà", "fr", "a"), (8, "àé ñandú çà", "fr", "a"), (9, "ALPHA beta gamma delta epsilon", "de", "c"), (None, None, None, None), (10, "one", "en", "c"), (11, "日本語 テキスト 😀", None, "c")]
    return spark.createDataFrame([(*r, i, i % 3, "x") for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, row long, score int, k string")
