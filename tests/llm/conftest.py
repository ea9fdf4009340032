import pytest


@pytest.fixture
def make(spark):
    """A documents table from texts, or from whole rows."""

    def build(rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
        if rows and not isinstance(rows[0], tuple):
            rows = [(k, t, "en", "s", None if t is None else len(t)) for k, t in enumerate(rows)]
        return spark.createDataFrame(rows, schema)

    return build
