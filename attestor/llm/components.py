"""Connected components by alternating large-star and small-star steps, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import discard, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
    moved = down.join(least, F.col("u") == F.col("w")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """id and component (its smallest reachable id) of every id in edges(u, v) that isn't the smallest itself.

    Steps end when every id leads to one other, which leads nowhere: each component is then a star around its
    smallest id. Loops and nulls are dropped, repeated edges count once, an empty input gives an empty result.
    """
    now = written(edges.where("u <> v").select(F.col("u").cast("long"), F.col("v").cast("long")).distinct(), name)
    while not _stars(now):
        before, now = now, written(_small_star(_large_star(now)), name)
        discard(before)
    return now.select(F.col("u").alias("id"), F.col("v").alias("component"))


def _stars(edges: DataFrame) -> bool:
    if not edges.where("u <= v").isEmpty() or not edges.groupBy("u").count().where("count > 1").isEmpty():
        return False
    return edges.join(edges.select(F.col("v").alias("w")).distinct(), F.col("u") == F.col("w"), "left_semi").isEmpty()
