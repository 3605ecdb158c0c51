import pyarrow.parquet as pq
import pytest


@pytest.fixture(scope="session")
def documents(sf_dir):
    t = pq.read_table(f"{sf_dir}/documents.parquet")
    return dict(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))


@pytest.fixture
def docs(spark):
    """A frame of documents from texts or (doc_id, text) pairs, with a clashing extra column."""

    def make(*rows):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame([(i, t, "x", "y", None) for i, t in rows], "doc_id long, text string, label string, score string, n_chars long")

    return make
