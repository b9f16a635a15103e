import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus(spark, tmp_path_factory):
    """corpus(rows): a folder whose documents.parquet holds (doc_id, text, source) rows."""

    def make(rows, schema=SCHEMA):
        path = tmp_path_factory.mktemp("corpus")
        rows = [(i, t, "en", s, len(t or "")) if schema is SCHEMA else (i, t, s) for i, t, s in rows]
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
        return str(path)

    return make
