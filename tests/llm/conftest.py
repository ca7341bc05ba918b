import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """(id, text) rows to a documents table; further columns are filled in."""
    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows],
                                     "doc_id bigint, text string, lang string, source string, n_chars bigint")

    return make
