"""Stored vectors that grow: only texts not seen before are encoded.

A vector is kept under a digest of the encoder's name and the text, so a changed text, or
another encoder, is a new entry, and equal texts are one. An update looks its texts up by an
anti-join and appends the new ones as one batch. Batches belong to a generation; compaction
writes the next generation whole, and readers go over to it once it is complete, so a run
that ends half-way leaves the store as it was.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nascent.operators.panel import ID
from nascent.session import path_exists, settle

ENTRY = "entry binary, vector array<double>"


@dataclass(frozen=True)
class VectorStore:
    """Vectors below ``path``, made by ``encode`` from ``(entry, text)`` rows into ``(entry, vector)``."""

    path: str
    encoder: str
    encode: Callable[[DataFrame], DataFrame]
    #: Batches of a generation from which an update compacts.
    most_batches: int = 32

    def entry(self, text: Column) -> Column:
        """The digest under which a text's vector is kept; null texts have none."""
        return F.unhex(F.md5(F.concat(F.lit(f"{self.encoder}\u0000"), text)))

    def _batch(self, generation: int, batch: int) -> str:
        return f"{self.path}/generation={generation}/batch={batch}"

    def _complete(self, spark: SparkSession, generation: int, batch: int) -> bool:
        return path_exists(spark, f"{self._batch(generation, batch)}/_SUCCESS")

    def state(self, spark: SparkSession) -> tuple[int, int]:
        """The newest complete generation and how many batches it has."""
        generation = batches = 0
        while self._complete(spark, generation + 1, 0):
            generation += 1
        while self._complete(spark, generation, batches):
            batches += 1
        return generation, batches

    def entries(self, spark: SparkSession) -> DataFrame:
        generation, batches = self.state(spark)
        if not batches:
            return spark.createDataFrame([], ENTRY)
        return spark.read.schema(ENTRY).parquet(*[self._batch(generation, b) for b in range(batches)])

    def update(self, texts: DataFrame, text: str) -> int:
        """Encode and append the texts that the store does not hold; how many these were."""
        spark = texts.sparkSession
        wanted = texts.where(F.col(text).isNotNull()).select(self.entry(F.col(text)).alias("entry"), F.col(text).alias("text"))
        missing = wanted.join(self.entries(spark).select("entry"), "entry", "left_anti")
        # Copies of a text are summed up before they are shuffled.
        missing = settle(missing.groupBy("entry").agg(F.first("text").alias("text")))
        count = missing.count()
        if count:
            generation, batches = self.state(spark)
            self.encode(missing).select("entry", "vector").write.mode("overwrite").parquet(self._batch(generation, batches))
            if batches + 1 >= self.most_batches:
                self.compact(spark)
        return count

    def compact(self, spark: SparkSession) -> None:
        """Write all entries as the first batch of a new generation; the old one is left to be cleared."""
        generation, batches = self.state(spark)
        if batches > 1:
            self.entries(spark).write.mode("overwrite").parquet(self._batch(generation + 1, 0))

    def vectors(self, texts: DataFrame, text: str, id_column: str = ID) -> tuple[DataFrame, DataFrame]:
        """``(id, vector)`` of the texts that are stored, and a one-row table counting the others."""
        keyed = texts.select(id_column, self.entry(F.col(text)).alias("entry"))
        stored = self.entries(texts.sparkSession)
        found = keyed.join(stored, "entry").select(id_column, "vector")
        missing = keyed.join(stored.select("entry"), "entry", "left_anti").agg(F.count("*").alias("missing"))
        return found, missing
