"""A lasting cache of what a model or a service said of a text, named by the text's SHA-256."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.sources.scratch import discard, stored
from attestor.sources.snapshots import SnapshotTable


class ContentCache:
    """Value columns (a DDL string) by name of the text, in a snapshot table that outlives runs and sessions."""

    def __init__(self, spark: SparkSession, path: str, values: str):
        self.table = SnapshotTable(spark, path, {"values": f"name string, {values}"}, key="name")

    def read(self) -> DataFrame:
        """name and values; a text that two writers have added at a time is there once."""
        return self.table.read("values").dropDuplicates(["name"])

    def filled(self, texts: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """text and values of each distinct text of texts(text); null texts have none.

        make gets name and text of those that the cache lacks, and gives name, the values and perhaps failed. What hasn't failed
        is added to the cache; what has is given back, and made again the next time.
        """
        asked = stored(texts.where("text is not null").select("text").distinct().withColumn("name", F.sha2("text", 256)), "asked")
        lacking = asked.join(self.read().select("name"), "name", "left_anti")
        columns = self.table.read("values").columns
        made = make(lacking)
        made = stored(made.select(*columns, F.col("failed") if "failed" in made.columns else F.lit(False).alias("failed")), "made")
        good = made.where("not failed").select(*columns)
        if not good.isEmpty():
            self.table.commit({"values": good})
        failed = made.where("failed").select(*columns)
        if failed.isEmpty():
            discard(made)
            return asked.join(self.read(), "name").drop("name")
        return asked.join(self.read().unionByName(failed), "name").drop("name")
