import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    def make(texts, source="s"):
        rows = [(i, t, "en", source, None if t is None else len(t)) for i, t in (texts.items() if isinstance(texts, dict) else texts)]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture(scope="session")
def edge_texts():
    """Null, empty, blank and very long texts, ties and repeats."""
    return [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "word " * 30_000), (6, "x" * 200_000), (4, "one"), (None, "one"), (None, None), (7, "é\x00▁ 日本 😀")]
