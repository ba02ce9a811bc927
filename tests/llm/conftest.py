import pytest


@pytest.fixture
def docs(spark):
    """Makes documents from (doc_id, text), with columns whose names clash with the operators' own."""

    def make(rows):
        return spark.createDataFrame([(i, t, None, "s", 0, "k") for i, t in rows], "doc_id long, text string, lang string, source string, n_words long, key string").repartition(3)

    return make
