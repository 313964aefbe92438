"""Reports as text files: one a response, replaced when it is written again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_reports(reports: DataFrame, out: str) -> None:
    """Writes reports(response_id, report) below out, one text file in the folder response_id=... of each.

    Only the folders of the responses given are replaced, when all are written; so a run that is repeated gives the same files,
    and other responses' reports stay. Rows of one response are parts of its file; a null report is an empty one.
    """
    rows = reports.select(F.col("response_id").cast("string").alias("response_id"), F.coalesce("report", F.lit("")).alias("value"))
    rows = rows.repartition("response_id").sortWithinPartitions("response_id")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("response_id").text(out)


def read_reports(spark: SparkSession, out: str) -> DataFrame:
    """response_id and report of all files below out."""
    rows = spark.read.schema("value string, response_id string").text(out, wholetext=True)
    return rows.select("response_id", F.regexp_replace("value", r"\n\z", "").alias("report"))
