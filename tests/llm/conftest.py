import pytest


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns named as results are."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [
        (1, "first line here\nsecond line here\nthird line here\nfourth line here", "en", "a", 7),
        (2, "first line here\nsecond line here\nthird line here\nother", None, None, None),
        (2, "first line here\nsecond line here\nthird line here\nother", None, None, None),
        (3, "", "en", "a", 0),
        (4, None, "en", "a", None),
        (None, "a text without any id at all", None, "b", 1),
        (5, long, "de", "b", 1),
        (6, long + " tail", "de", "b", 1),
        (7, " \n\t\n ", "fr", "c", 2),
        (2, "another text under an id that is taken", "en", "a", 3),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens int")
