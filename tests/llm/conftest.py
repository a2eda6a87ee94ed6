import pytest


@pytest.fixture
def docs_of(spark):
    """A documents table with clashing column names, from (doc_id, text) pairs."""

    def make(pairs):
        rows = [(i, t, "en", "s", len(t) if t is not None else None, 7, "k") for i, t in pairs]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_tokens long, kept string")

    return make
