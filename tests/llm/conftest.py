import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Build a documents table from (doc_id, text[, lang[, source]]) rows, with extra columns whose names could clash."""
    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", len(r[1] or ""), "x", 1) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, _row string, shard int")
    return make
