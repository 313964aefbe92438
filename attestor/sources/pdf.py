"""PDF files as documents: Spark's binaryFile source, one Arrow map that extracts page text, then plain columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.operators.passages import page_texts
from attestor.sources.pdf_objects import page_texts as page_texts_of


def _extractor() -> Callable[[bytes], list[str]]:
    """A PDF library where one is installed, else the engine's own reader."""
    try:
        import fitz
    except ImportError:
        return page_texts_of
    return lambda content: [page.get_text("text") for page in fitz.open(stream=content, filetype="pdf")]


def pages(files: DataFrame) -> DataFrame:
    """doc_id, page, text (raw), error of the pages of files(doc_id, content).

    A file that can't be read has one row, without page and text, whose error says why; other rows have no error.
    """

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = _extractor()
        for batch in batches:
            rows = []
            for doc_id, content in zip(batch["doc_id"], batch["content"], strict=True):
                try:
                    rows += [(doc_id, i, t, None) for i, t in enumerate(read(bytes(content)))]
                except Exception as e:  # noqa: BLE001  a damaged file must not stop the others
                    rows.append((doc_id, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["doc_id", "page", "text", "error"]).astype({"page": "Int32"})

    return files.select(F.col("doc_id").cast("string"), "content").mapInPandas(extract, "doc_id string, page int, text string, error string")


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the file's path) and text of all PDFs below path that can be read; a missing path is an error."""
    return page_texts(pages(pdf_files(spark, path)).where("error is null"))


def unreadable(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and error of the PDFs below path that can't be read."""
    return pages(pdf_files(spark, path)).where("error is not null").select("doc_id", "error")


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the file's path) and content of all PDFs below path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("doc_id"), "content")
