import pytest


@pytest.fixture
def documents(spark):
    """A documents table with clashing extra columns: (doc_id, text) pairs, any of them null."""
    def make(*rows):
        return spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id bigint, text string, key string, n bigint")
    return make
