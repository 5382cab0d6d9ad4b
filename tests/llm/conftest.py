import pytest


@pytest.fixture
def docs_of(spark):
    """A documents table with columns whose names the operators use inside."""

    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, fp long, block int, shard int, score double, key string, base string"
        return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t), 1, 2, 3, 0.5, "k", "b") for i, t in rows], schema)

    return make
