import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """A DataFrame of documents rows from (doc_id, text) pairs, with a clashing extra column."""

    def make(rows, extra="key"):
        full = [(i, t, "en", "s", None if t is None else len(t), 7) for i, t in rows]
        kinds = f"doc_id long, text string, lang string, source string, n_chars long, {extra} int"
        return spark.createDataFrame(full, kinds)

    return make
