"""The sequence model: training on settled trajectories and rebuilding all of them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from nascent.learning.kernels import Adam, SequenceAutoencoder
from nascent.learning.trainer import make_shards, minibatches, train_round
from nascent.operators.clusters import GLOBAL
from nascent.operators.trajectory import FEATURES


@dataclass(frozen=True)
class SequenceSettings:
    """Defaults of the full profile. ``batch`` sequences of equal length share a step."""

    hidden: int = 128
    latent: int = 48
    epochs: int = 400
    rate: float = 2e-3
    batch: int = 1
    seed: int = 31
    epochs_per_round: int = 100
    shards: int | None = None


SMALL = SequenceSettings(hidden=32, latent=16, epochs=60, batch=4, epochs_per_round=60)


def _by_length(sequences: list[list[list[float]]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and stacked values of the sequences of each length."""
    lengths = np.array([len(s) for s in sequences])
    groups = []
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        groups.append((rows, np.array([sequences[r] for r in rows], dtype=np.float64)))
    return groups


def train_sequences(
    sequences: DataFrame, settings: SequenceSettings = SequenceSettings()
) -> tuple[SequenceAutoencoder, np.ndarray, list[float]]:
    """``sequences`` has ``(global, sequence)``: one row per cluster, so a small table."""
    model = SequenceAutoencoder(len(FEATURES), settings.hidden, settings.latent)
    shards = make_shards(sequences.select(GLOBAL, "sequence"), GLOBAL, settings.shards)
    weights, losses, done = model.initial(settings.seed), [], 0
    while done < settings.epochs:
        epochs = min(settings.epochs_per_round, settings.epochs - done)

        def learn(local, batch, rng, epochs=epochs):
            groups = _by_length(batch.column("sequence").to_pylist())
            adam, total, rows = Adam(local.size, settings.rate), 0.0, batch.num_rows
            for _ in range(epochs):
                total = 0.0
                for _, x in groups:
                    for chosen in minibatches(len(x), settings.batch, rng):
                        loss, grad = model.loss_and_gradient(local, x[chosen])
                        adam.step(local, grad)
                        total += loss * len(chosen)
            return local, total / rows, rows

        weights, loss, _ = train_round(shards, weights, learn, settings.seed + done)
        losses.append(loss)
        done += epochs
    return model, weights, losses


def rebuild(sequences: DataFrame, model: SequenceAutoencoder, weights: np.ndarray) -> DataFrame:
    """Add ``rebuilt``, shaped like ``sequence``."""
    sent = sequences.sparkSession.sparkContext.broadcast(weights)
    nested = T.ArrayType(T.ArrayType(T.DoubleType()))
    schema = T.StructType([*sequences.schema.fields, T.StructField("rebuilt", nested)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            out: list = [None] * batch.num_rows
            for rows, x in _by_length(batch.column("sequence").to_pylist()):
                for row, values in zip(rows, model.rebuild(sent.value, x), strict=True):
                    out[row] = values.tolist()
            column = pa.array(out, pa.list_(pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "rebuilt"])

    return sequences.mapInArrow(work, schema)
