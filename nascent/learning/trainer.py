"""The one training mechanism: local steps on every shard, then a weighted average.

A round is one Spark job. A shard is sized by rows, so that it fits a task whatever the
input. Every task joins its shard, in order of ids, takes the broadcast weights through
the round's epochs and returns one row; the rows are averaged by a Spark aggregate in two
levels, so neither the driver nor a single task receives all of them. The result does not
depend on how Arrow cuts the rows into batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nascent.session import fix_partitions

FAN_IN = 64
SHARD_ROWS = 50_000


def shards_for(rows: int, shards: int | None = None) -> int:
    """As many shards as asked for, else one for each ``SHARD_ROWS`` rows."""
    return shards or max(1, -(-rows // SHARD_ROWS))


def make_shards(df: DataFrame, id_column: str, shards: int | None = None) -> DataFrame:
    """Spread the rows evenly by the hash of the id and fix them in the shared folder.

    The id becomes the first column, by which ``train_round`` orders a shard.
    """
    shards = shards or shards_for(df.count())
    rest = [c for c in df.columns if c != id_column]
    # In order, so that seeds drawn from the rows do not depend on how the rows came.
    dealt = df.select(id_column, *rest).repartition(shards, id_column)
    return fix_partitions(dealt.sortWithinPartitions(id_column))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix, without touching single rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    return np.asarray(column.flatten(), dtype=np.float64).reshape(rows, -1) if rows else np.empty((0, 0))


def average(rows: DataFrame, shards: int) -> tuple[np.ndarray, float, float]:
    """Weighted mean of ``(shard, n, loss, w)`` rows: weights, loss and total ``n``."""
    mean = Summarizer.metrics("mean").summary(F.col("w"), F.col("n")).getField("mean")
    parts = [
        F.sum("n").alias("n"),
        (F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("loss"),
        mean.alias("w"),
    ]
    level = rows.withColumn("w", array_to_vector("w"))
    if shards > FAN_IN:
        level = level.groupBy(F.pmod("shard", F.lit(FAN_IN)).alias("shard")).agg(*parts)
    result = level.agg(*parts).first()
    if result is None or not result["n"]:
        raise ValueError("no rows to train on")
    return result["w"].toArray(), float(result["loss"]), float(result["n"])


def in_order(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The batches of a shard as one, by the first column."""
    table = pa.Table.from_batches(parts)
    return table.sort_by(table.column_names[0]).combine_chunks().to_batches()[0]


def train_round(
    shards: DataFrame,
    weights: np.ndarray,
    learn: Callable[[np.ndarray, pa.RecordBatch, np.random.Generator], tuple[np.ndarray, float, int]],
    seed: int,
) -> tuple[np.ndarray, float, float]:
    """One round. ``learn`` takes the local weights through all rows of a shard."""
    sent = shards.sparkSession.sparkContext.broadcast(weights)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        rng = np.random.default_rng([seed, shard])
        parts = [batch for batch in batches if batch.num_rows]
        if parts:
            local, loss, seen = learn(sent.value.copy(), in_order(parts), rng)
            yield pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array([shard], pa.int32()),
                    "n": pa.array([float(seen)]),
                    "loss": pa.array([loss]),
                    "w": pa.array([local.tolist()], pa.list_(pa.float64())),
                }
            )

    rows = shards.mapInArrow(work, "shard int, n double, loss double, w array<double>")
    result = average(rows, shards.rdd.getNumPartitions())
    sent.unpersist()
    return result


def minibatches(n: int, size: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    order = rng.permutation(n)
    for start in range(0, n, size):
        yield order[start : start + size]
