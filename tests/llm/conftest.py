from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus(spark, tmp_path_factory):
    """Writes rows as the documents table (and others) of a new folder, and gives the folder."""

    def write(texts, benchmark=(), labels=(), extra=()):
        base = str(tmp_path_factory.mktemp("corpus"))
        rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)] + list(extra)
        spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(f"{base}/documents.parquet")
        spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
        spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
        return base

    return write
