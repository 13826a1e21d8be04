import pytest

TEXTS = [
    (1, "Alpha beta gamma delta.", "en", "a"),
    (2, "Alpha beta gamma delta.", "en", "a"),
    (2, "Alpha beta gamma delta.", "en", "a"),
    (3, None, None, None),
    (4, "", "de", "b"),
    (None, "no id here at all", "en", None),
    (5, "long " * 30_000 + "tail", "en", "b"),
    (6, "  \t\n ", "fr", "c"),
    (7, "Grüße, señor ¿qué? 東京 𝒳 \x00 ½", "es", "c"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns whose names clash with internal ones."""
    rows = [(i, t, lang, s, 0, "x", 7) for i, t, lang, s in TEXTS]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, _id string, size int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
