import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table with the given texts, ids 0, 1, 2, ..."""
    def make(texts, partitions=3):
        rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(
            partitions)
    return make
