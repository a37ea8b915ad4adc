"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_ROWS = 512


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: texts differ in length by four orders of magnitude.

    Only the default of 10,000 rows is lowered; a setting of the user's own is kept.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean_text(name: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def in_fold(doc_id: str, parts: int, fold: int) -> Column:
    """crc32 of the id as text, modulo ``parts``, equals ``fold``; false for a null id."""
    folded = F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(parts)) == fold
    return F.coalesce(folded, F.lit(False))


def partitions_for(rows: int, rows_each: int, least: int = 1) -> int:
    """How many partitions hold ``rows`` at ``rows_each`` apiece."""
    return max(least, -(-rows // rows_each))


def complete_runs(
    batches: Iterator[pd.DataFrame], keys: list[str], at_least: int = 50_000
) -> Iterator[pd.DataFrame]:
    """Join sorted batches so that rows with equal ``keys`` are never parted.

    Runs must be bounded by the caller; what waits is one run and ``at_least`` rows.
    """
    held: list[pd.DataFrame] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows < at_least:
            continue
        frame = pd.concat(held, ignore_index=True)
        last = np.logical_and.reduce([(frame[k] == frame[k].iloc[-1]).to_numpy() for k in keys])
        cut = len(frame) - int(last[::-1].argmin() if not last.all() else len(last))
        if cut:
            yield frame.iloc[:cut]
        held, rows = [frame.iloc[cut:]], len(frame) - cut
    if rows:
        yield pd.concat(held, ignore_index=True)


def run_ends(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """For every row of a sorted frame, the place after the last row of its run."""
    change = np.zeros(len(frame), dtype=bool)
    for key in keys:
        values = frame[key].to_numpy()
        change[1:] |= values[1:] != values[:-1]
    borders = np.append(np.flatnonzero(change), len(frame))
    return borders[np.searchsorted(borders, np.arange(len(frame)), side="right")]


def pairs_in_runs(ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places within runs, by growing distance, as two arrays at a time."""
    left, lag = np.arange(len(ends)), 1
    while True:
        left = left[left + lag < ends[left]]
        if not len(left):
            return
        yield left, left + lag
        lag += 1


def local_labels(size: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest place reachable from every place over the given pairs."""
    label = np.arange(size)
    while len(left):
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        label = label[label]
        while (label != label[label]).any():
            label = label[label]
        apart = label[left] != label[right]
        left, right = left[apart], right[apart]
    return label


def deal_blocks(rows: DataFrame, keys: list[str], spread: Column, most: int) -> DataFrame:
    """Split the runs of ``keys`` into blocks of about ``most`` rows, for comparing pairs.

    Rows of a run above ``most`` get a share ``__own`` by ``spread`` and are repeated for
    every pair of shares ``(__low, __high)``: each two rows meet in one block at least.
    Pairs of one share meet in every block of that share; ``__low = __high`` is theirs.
    """
    large = rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > most)
    shares = large.select(*keys, F.ceil(F.col("__n") / most).cast("int").alias("__shares"))
    dealt = rows.join(shares, keys, "left").withColumn("__shares", F.coalesce("__shares", F.lit(1)))
    own = F.pmod(spread, F.col("__shares")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("__shares") - 1))
    dealt = dealt.withColumn("__own", own).withColumn("__other", other)
    return dealt.select(
        *rows.columns,
        "__own",
        F.least("__own", "__other").alias("__low"),
        F.greatest("__own", "__other").alias("__high"),
    )
