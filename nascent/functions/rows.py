"""Turning arrays into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_once(df: DataFrame, keep: list[str], array: Column, name: str) -> DataFrame:
    """Rows of an array that is costly to compute.

    A plain ``explode`` makes the optimizer infer a filter on the array's size and push
    it down to the scan, which computes the array a second time. The outer form with a
    null check gives the same rows and computes it once.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())
