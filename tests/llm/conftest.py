import pytest


@pytest.fixture
def docs(spark):
    """docs(texts, **columns): documents with clashing extra columns, in three partitions."""

    def make(texts, lang=None, source=None, ids=None):
        lang, source, ids = lang or ["en"] * len(texts), source or ["s"] * len(texts), ids or list(range(len(texts)))
        rows = [(i, t, la, s, len(t) if t is not None else None, "x", "y", "z") for i, t, la, s in zip(ids, texts, lang, source)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _key string, score string, size string").repartition(3)

    return make


ODD = [None, "", "   \t", "a", "same text here", "same\ttext  here", "same text here", "É ü 中文 🙂\n\nx"]


@pytest.fixture
def odd():
    return list(ODD)
