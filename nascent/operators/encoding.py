"""Text to vector."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nascent.functions.hashing import blake_buckets, signed_buckets
from nascent.functions.rows import explode_once
from nascent.functions.text import space_tokens
from nascent.operators.panel import ID


def _dense_from_codes(dim: int):
    """Arrow function: signed bucket codes of a whole batch to unit vectors at once."""

    @F.arrow_udf("array<double>")
    def dense(codes: pa.Array) -> pa.Array:
        codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
        rows = len(codes)
        lengths = np.asarray(codes.value_lengths().fill_null(0))
        flat = np.asarray(codes.flatten(), dtype=np.int64)
        row_of = np.repeat(np.arange(rows, dtype=np.int64), lengths)
        weights = 1.0 - 2.0 * (flat & 1)
        sums = np.bincount(row_of * dim + (flat >> 1), weights=weights, minlength=rows * dim)
        sums = sums.astype(np.float64, copy=False).reshape(rows, dim)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        np.divide(sums, norms, out=sums, where=norms > 0)
        offsets = np.arange(0, (rows + 1) * dim, dim, dtype=np.int32)
        return pa.ListArray.from_arrays(offsets, sums.reshape(-1))

    # Keeps filters on the vector above this call instead of repeating it below them.
    return dense.asNondeterministic()


def hashed_vector(text: Column, dim: int = 256, blake: bool = False) -> Column:
    """Signed hashed bag of words with unit length.

    Tokens are split and hashed in the JVM; the sum per bucket is one numpy call per
    Arrow batch. The row never leaves its partition, so there is no shuffle.
    """
    tokens = space_tokens(text)
    codes = blake_buckets(dim)(tokens) if blake else signed_buckets(tokens, dim)
    return _dense_from_codes(dim)(codes)


def hashed_buckets(df: DataFrame, text: Column, dim: int = 256, id_column: str = ID) -> DataFrame:
    """The same sums in sparse long form ``(id, bucket, weight)``, before normalising."""
    coded = explode_once(df, [id_column], signed_buckets(space_tokens(text), dim), "code")
    return coded.groupBy(id_column, F.expr("code div 2").cast("int").alias("bucket")).agg(
        F.sum(1 - 2 * (F.col("code") % 2)).alias("weight")
    )


def encode_hashed(
    df: DataFrame, text: Column, dim: int = 256, blake: bool = False, vector: str = "vector"
) -> DataFrame:
    return df.withColumn(vector, hashed_vector(text, dim, blake))


def encode_with(
    df: DataFrame,
    text: str,
    make_encoder: Callable[[], object],
    id_column: str = ID,
    vector: str = "vector",
) -> DataFrame:
    """Vectors from any object with ``encode(list of texts) -> matrix``.

    ``make_encoder`` runs once per task, so a model is loaded once and then applied
    to every Arrow batch of the task.
    """
    id_type = dict(df.dtypes)[id_column]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make_encoder()
        for batch in batches:
            matrix = np.asarray(encoder.encode(batch[text].tolist()), dtype=np.float64)
            yield pd.DataFrame({id_column: batch[id_column], vector: list(matrix)})

    return df.select(id_column, text).mapInPandas(run, f"{id_column} {id_type}, {vector} array<double>")


def describe_vectors(df: DataFrame, backend: str, vector: str = "vector") -> DataFrame:
    """One row of facts about a set of vectors."""
    return df.agg(
        F.lit(backend).alias("backend"),
        F.max(F.size(vector)).cast("int").alias("dim"),
        F.count("*").alias("n"),
    )
