"""Rows from arrays, with the array made once.

An inner explode() makes Spark infer a filter on the array's size, and filters and projections are merged with what they read:
an array of an expensive expression is then made anew for the filter, and inside a lambda for each element. An outer
explode infers nothing, and nothing is merged across it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(rows: DataFrame, keep: list[str | Column], array: Column | str, value: str, position: str | None = None) -> DataFrame:
    """keep, and a row for each element of array as value, with its place from 0 as position if that is named; none for an empty or null array."""
    place = position or f"{value}_place"
    out = rows.select(*keep, F.posexplode_outer(array).alias(place, value)).where(F.col(place).isNotNull())
    return out if position else out.drop(place)


def once(rows: DataFrame, keep: list[str | Column], **made: Column) -> DataFrame:
    """keep and the columns made, each made once a row, however often it is then used."""
    names = list(made)
    out = rows.select(*keep, F.explode_outer(F.array(F.struct(*[made[n].alias(n) for n in names]))).alias("made"))
    return out.select(*[F.col(c) if isinstance(c, str) else c for c in out.columns if c != "made"], *[F.col(f"made.{n}") for n in names])
