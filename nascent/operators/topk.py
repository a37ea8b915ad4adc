"""Top rows per group without sending a whole group to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(
    df: DataFrame,
    groups: list[str],
    order: list[Column],
    n: int,
    spread: str,
    rank: str = "rank",
    salts: int = 32,
) -> DataFrame:
    """Rows ranked ``1..n`` inside their group.

    Each group is first cut to ``n`` per salt, so the task that finishes a hot group
    sees at most ``n * salts`` of its rows.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(F.col(spread)), F.lit(salts)))
    part = Window.partitionBy(*groups, "_salt").orderBy(*order)
    kept = salted.withColumn("_part", F.row_number().over(part)).where(F.col("_part") <= n)
    final = Window.partitionBy(*groups).orderBy(*order)
    return (
        kept.drop("_salt", "_part")
        .withColumn(rank, F.row_number().over(final))
        .where(F.col(rank) <= n)
    )
