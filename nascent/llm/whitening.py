"""Whitening of embeddings by blockwise QR and a bidiagonal qd solver.

Entries become integers on a grid, so that sums are exact. One pass sums them. A second pass
centres every row and reduces blocks of rows to a triangular factor R by QR; the factors of
all tasks are stacked and reduced again in a tree with a fixed fan-in, so no task and no
driver sees more than ``FAN_IN`` of them. ``R^T R`` equals the summed squares of the centred
rows, but is never formed: R is made bidiagonal, dqds finds its singular values and twisted
factorisations the directions (:mod:`nascent.llm.bidiagonal`). A last pass projects the rows.

Defined results: rows with a null or empty vector, or with null or non-finite entries, are
dropped; where lengths differ, the most frequent one (the longer among equals) is fitted and
rows of other lengths are dropped; entries beyond ``LARGEST`` count as that; null ids and
repeated rows are rows like others; the sign of a direction makes its largest entry positive.
A direction without variance, as of a constant column or of a single row, has a null
``whitened`` value and takes no part in ``identity_error``, which is null if none has any;
``explained`` is null if nothing varies; ``deviation`` is null where it does not fit a long.
An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nascent.llm.bidiagonal import EPS, leading_right_vectors
from nascent.session import settle

SCALE, OFFSET = 1024.0, 100_000
LARGEST = float(1 << 52)
FAN_IN = 16
QR_ROWS = 4096


def usable(rows: DataFrame, vector: str, id_column: str) -> DataFrame:
    """``(id, v)`` with doubles, of the rows that are fitted."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    clean = rows.select(F.col(id_column).alias("id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & ~bad)
    lengths = clean.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"))
    common = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    return clean.where(F.size("v") == (common["d"] if common else 0))


def _grid(column: pd.Series) -> np.ndarray:
    entries = np.stack(column.to_numpy()).astype(float)
    return np.floor(np.clip(entries, -LARGEST / SCALE, LARGEST / SCALE) * SCALE).astype(np.int64) + OFFSET


def exact_sums(vectors: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of rows and the sum of every dimension, as Python integers."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, low, high = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            if len(batch):
                x = _grid(batch["v"])
                n += len(x)
                low += (x & 0xFFFFFFFF).sum(axis=0)
                high += (x >> 32).sum(axis=0)
        if n:
            yield pd.DataFrame({"dim": np.arange(d), "n": n, "low": low, "high": high})

    parts = vectors.mapInPandas(sums, "dim int, n long, low long, high long")
    whole = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "low", "high")]
    found = sorted(parts.groupBy("dim").agg(*whole).collect())
    return (int(found[0]["n"]) if found else 0), [(int(r["high"]) << 32) + int(r["low"]) for r in found]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``x - S / n`` with the difference taken between integers."""
    whole = np.array([s // n for s in sums], np.int64)
    return (x - whole).astype(float) - np.array([(s % n) / n for s in sums])


def triangular_factor(vectors: DataFrame, d: int, n: int, sums: list[int]) -> np.ndarray:
    """R of the centred rows; one factor a task, merged ``FAN_IN`` at a time."""

    def reduce_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, held, rows = np.zeros((0, d)), [], 0
        for batch in batches:
            if len(batch):
                held.append(centred(_grid(batch["v"]), n, sums))
                rows += len(batch)
            if rows >= QR_ROWS:
                kept, held, rows = np.linalg.qr(np.vstack([kept, *held]), mode="r"), [], 0
        if rows or len(kept):
            factor = np.linalg.qr(np.vstack([kept, *held]), mode="r")
            yield pd.DataFrame({"r": [factor.ravel()]})

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        stack = np.vstack([np.reshape(r, (-1, d)) for r in group.sort_values("part")["r"]])
        return pd.DataFrame({"r": [np.linalg.qr(stack, mode="r").ravel()]})

    numbered = F.monotonically_increasing_id().alias("part")
    factors = settle(vectors.mapInPandas(reduce_rows, "r array<double>").select(numbered, "r"))
    while (count := factors.count()) > FAN_IN:
        # Numbers are spread over tasks; their remainder deals them to groups of about FAN_IN.
        groups = -(-count // FAN_IN)
        dealt = factors.withColumn("g", F.pmod(F.xxhash64("part"), F.lit(groups)))
        factors = settle(dealt.groupBy("g").applyInPandas(merge, "r array<double>").select(numbered, "r"))
    stack = np.vstack([np.reshape(r["r"], (-1, d)) for r in factors.orderBy("part").collect()])
    square = np.zeros((max(d, len(stack)), d))
    square[: len(stack)] = stack
    return np.linalg.qr(square, mode="r")


def whiten(rows: DataFrame, vector: str, id_column: str, components: int = 8) -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)``.

    One row for every usable row and each of the first ``components`` directions, counted
    from 1 by falling variance.
    """
    vectors = settle(usable(rows, vector, id_column))
    first = vectors.select(F.size("v")).first()
    if first is None:
        return _result(vectors.select("id", *_nothing()), [], None)
    d = first[0]
    n, sums = exact_sums(vectors, d)
    squares, directions = leading_right_vectors(triangular_factor(vectors, d, n, sums), components)
    flip = np.sign(directions[np.arange(len(directions)), np.abs(directions).argmax(axis=1)])
    directions = directions * flip[:, None]
    varies = squares[: len(directions)] > EPS * max(d, 1) * squares[0]
    spread = np.where(varies, np.sqrt(np.where(varies, squares[: len(directions)], 1.0) / n), np.nan)
    projected = settle(_project(vectors, n, sums, directions, spread))
    total = squares.sum()
    explained = [float(s / total) if total else None for s in squares[: len(directions)]]
    return _result(projected, explained, _identity_error(projected, np.flatnonzero(varies)))


def _nothing() -> list:
    return [F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("deviation"), F.array().cast("array<double>").alias("w")]


def _project(vectors: DataFrame, n: int, sums: list[int], directions: np.ndarray, spread: np.ndarray) -> DataFrame:
    scaled = (directions / spread[:, None]).T
    types = {field.name: field.dataType.simpleString() for field in vectors.schema}

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = _grid(batch["v"])
            out = batch[["id"]].copy()
            out["n"] = n
            out["deviation"] = pd.array(_deviations(x, n, sums), dtype="Int64")
            out["w"] = list(centred(x, n, sums) @ scaled)
            yield out

    # The id travels as text, as a null among integers would make them doubles.
    named = vectors.select(F.col("id").cast("string").alias("id"), "v")
    found = named.mapInPandas(project, "id string, n long, deviation long, w array<double>")
    return found.withColumn("id", F.col("id").cast(types["id"]))


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of ``(n * x - S) ** 2``, exactly."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], np.int64)
    apart = x - whole
    bound = (int(np.abs(apart).max()) + 1) * n
    if bound * bound * x.shape[1] < 1 << 63:
        return (((apart * n - rest) ** 2).sum(axis=1)).tolist()
    exact = ((apart.astype(object) * n - rest.astype(object)) ** 2).sum(axis=1)
    return [v if v < 1 << 63 else None for v in exact]


def _identity_error(projected: DataFrame, places: np.ndarray) -> float | None:
    """Largest entry of the covariance of the whitened values minus the identity."""
    if not len(places):
        return None
    w = [F.get("w", F.lit(int(i))) for i in places]
    pairs = [(i, j) for i in range(len(w)) for j in range(i, len(w))]
    found = projected.agg(*[F.covar_pop(w[i], w[j]) for i, j in pairs]).first()
    return max(abs(value - (i == j)) for value, (i, j) in zip(found, pairs))


def _result(projected: DataFrame, explained: list[float | None], error: float | None) -> DataFrame:
    share = F.get(F.array(*[F.lit(e).cast("double") for e in explained]).cast("array<double>"), F.col("place"))
    return projected.select("id", "n", "deviation", F.posexplode("w").alias("place", "value")).select(
        "id",
        (F.col("place") + 1).cast("int").alias("component"),
        "n",
        "deviation",
        F.nanvl("value", F.lit(None)).alias("whitened"),
        share.alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
