import duckdb
import pytest


@pytest.fixture(scope="session")
def corpus(sf):
    """(doc_id, text, lang, source) of the smallest documents table."""
    return duckdb.connect().execute(f"SELECT doc_id, text, lang, source FROM '{sf}/documents.parquet'").fetchall()


@pytest.fixture(scope="session")
def quality_labels(sf):
    return dict(duckdb.connect().execute(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall())
