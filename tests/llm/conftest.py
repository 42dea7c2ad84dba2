import pytest


@pytest.fixture
def docs_of(spark):
    """documents rows from (doc_id, text[, lang[, source]]) tuples, with extra columns whose names clash."""
    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s0", len(r[1] or ""), "x", "y")
                for r in rows]
        return spark.createDataFrame(
            full, "doc_id long, text string, lang string, source string, n_chars long, kept string, text_sha256 string").repartition(3)
    return make
