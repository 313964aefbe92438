"""Documents and responses from tables, text files and literals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.functions.text import short_id


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, most: int | None = None) -> DataFrame:
    """rows dealt out evenly if they come in fewer parts than tasks can run, as of one row group; for heavy work within rows.

    With `most`, a part has about so many rows at most, so that no task grows with the table.
    """
    parts = rows.sparkSession.sparkContext.defaultParallelism
    if most:
        parts = max(parts, -(-rows.count() // most))
    return rows.repartition(parts) if rows.rdd.getNumPartitions() < parts else rows


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (by content) and text of whole text files."""
    rows = spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")
    return rows.select(short_id(F.col("text")).alias("doc_id"), "text")


def pair(spark: SparkSession, source: str, response: str) -> tuple[DataFrame, DataFrame]:
    """One document and one response to it, as relations. Both must have text."""
    if not source or not response:
        raise ValueError("both a source and a response are needed")
    docs = spark.createDataFrame([(source,)], "text string").select(short_id(F.col("text")).alias("doc_id"), "text")
    return docs, docs.select(F.lit("0").alias("response_id"), "doc_id", F.lit(response).alias("text"))


def preview(text, most: int = 400):
    return F.concat(F.substring(text, 1, most), F.lit("..."))
