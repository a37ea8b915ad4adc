"""Consecutive numbers in a global order, and label indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nascent.session import attach_small, settle


def number_rows(df: DataFrame, order: list[Column | str], name: str, start: int = 0) -> DataFrame:
    """Number the rows ``start, start+1, ...`` in ``order``.

    Rows are range-partitioned and sorted, then each partition adds the number of rows
    in the partitions before it; no task sees all rows.
    """
    low_bits = (1 << 33) - 1
    placed = settle(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(low_bits)))
    )
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_pid")
        .agg(F.count("*").alias("_n"))
        .select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    joined = attach_small(placed, offsets, ["_pid"], spread="_pos", row_bytes=32)
    return joined.withColumn(name, F.col("_offset") + F.col("_pos") + start).drop(
        "_pid", "_pos", "_offset"
    )


def label_index(df: DataFrame, label: str, index: str = "label_idx") -> DataFrame:
    """``(label, index, rows)``: classes numbered in name order."""
    classes = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("rows"))
    return classes.withColumn(index, (F.row_number().over(Window.orderBy(label)) - 1).cast("int"))


def renumber_by_size(df: DataFrame, label: str, index: str = "cluster_id") -> DataFrame:
    """``(label, count, index)``: clusters numbered from the largest down, ties by name."""
    sizes = df.groupBy(label).agg(F.count("*").alias("count"))
    order = Window.orderBy(F.desc("count"), F.col(label))
    return sizes.withColumn(index, (F.row_number().over(order) - 1).cast("int"))
