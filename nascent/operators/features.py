"""Derived vector features for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nascent.functions import vectors

KERNELS = (3, 5, 7)
CELLS = 16


def sequence_fold_features(df: DataFrame, steps: int = 12, vector: str = "vector") -> DataFrame:
    """Add ``fused``: the vector followed by average and maximum over its folded steps."""
    return df.withColumn(
        "fused",
        vectors.let(
            F.col(vector), lambda v: F.concat(v, vectors.pool_over_steps(vectors.fold(v, steps)))
        ),
    )


def filter_features(df: DataFrame, vector: str = "vector") -> DataFrame:
    """Add ``filtered``: moving averages of three widths, pooled to 16 cells each, then
    averaged and maximised over the cells."""
    def bank(v: Column) -> Column:
        return F.array(*[vectors.adaptive_average(vectors.moving_average(v, k), CELLS) for k in KERNELS])

    def assemble(channels: Column) -> Column:
        average = F.transform(channels, lambda c: vectors.total(c) / CELLS)
        return F.concat(F.flatten(channels), average, F.transform(channels, F.array_max))

    return df.withColumn("filtered", vectors.let(F.col(vector), lambda v: vectors.let(bank(v), assemble)))
