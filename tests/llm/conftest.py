import pytest

CLASHING = "fp long, h string, t string, key string, n_words string, kept string, score string, component string, lo int, bin string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) with the table's columns and some with clashing names."""

    def make(rows, partitions=3):
        full = [(i, t, "en", f"src{(i or 0) % 3}", len(t or ""), 1, "x", "x", "x", "x", "x", "x", "x", 1, "x") for i, t in rows]
        schema = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
        return spark.createDataFrame(full, schema).repartition(partitions)

    return make
