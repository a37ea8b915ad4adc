"""Approximate nearest neighbours on shifted Hilbert curves.

Every vector is rotated at random, and each curve orders all vectors along a Hilbert curve
through a few of the rotated axes, on a grid shifted by its own amount. Spark sorts the slim
keys of all curves by range and numbers them. A query looks at the rows up to ``window``
places before and after its own place on every curve. Rows lie in blocks of consecutive
places; a query is sent to the blocks its window touches and compares itself with their rows
by exact distances, and the best rows of all blocks and curves are merged.

How wide a window must be depends on the data. Up to ``trials`` queries are compared with
all rows in one pass; their true neighbours' distances along the nearest curve give the
width that holds the share ``recall`` of them. Clustered data need narrow windows; vectors
without structure need wide ones, and the operator then does about the work of a full
comparison. The width is found, not capped, so the recall holds at every size.

Equal vectors are one point. As ties go to smaller ids, a point's ``k + 1`` smallest ids are
all that an answer can hold of it, so a group of copies of any size is one row of the index.

Defined results: rows without an id, and vectors that are null, empty, zero or hold null or
non-finite entries, take no part; vectors of different lengths are not compared; an id that
stands at several rows is one neighbour, at its nearest vector, and never its own; a query id
with several vectors gets the nearest rows of any of them; with fewer than ``k`` candidates
all come back (``least`` is above ``k``); an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from nascent.operators.numbering import number_rows
from nascent.session import settle


@dataclass(frozen=True)
class CurveSettings:
    curves: int = 8
    axes: int = 8
    bits: int = 4
    #: Share of the true neighbours of the trial queries that the windows must hold.
    recall: float = 0.97
    #: Queries compared with all rows to find the width; the only sample taken.
    trials: int = 256
    #: Places on each side that every window has at least.
    least: int = 256
    #: Rows of a block, and queries that meet it in one task.
    block: int = 16_384
    meeting: int = 32_768
    #: A hot point's answers are repeated so often when they are handed to its query ids.
    salts: int = 16
    seed: int = 42


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of grid cells, one row each, after Skilling (2004)."""
    axes = [column.astype(np.int64) for column in cells.T]
    for level in range(bits - 1, -1, -1):
        half = 1 << level
        low = half - 1
        for axis in range(len(axes)):
            flipped = (axes[axis] & half) != 0
            swap = np.where(flipped, 0, (axes[0] ^ axes[axis]) & low)
            axes[0] = axes[0] ^ np.where(flipped, low, swap)
            if axis:
                axes[axis] = axes[axis] ^ swap
    for axis in range(1, len(axes)):
        axes[axis] = axes[axis] ^ axes[axis - 1]
    turn = np.zeros(len(cells), np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(axes[-1] & (1 << level), (1 << level) - 1, 0)
    keys = np.zeros(len(cells), np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            keys = (keys << 1) | (((axis ^ turn) >> level) & 1)
    return keys


@dataclass(frozen=True)
class Orderings:
    """Rotated axes and shifted grids of all curves, for vectors up to ``width`` entries."""

    width: int
    settings: CurveSettings

    def axes(self) -> np.ndarray:
        """Unit axes as columns; those of different curves are orthogonal while they last."""
        rng, turns = np.random.default_rng(self.settings.seed), []
        wanted = self.settings.curves * self.settings.axes
        while sum(t.shape[1] for t in turns) < wanted:
            turns.append(np.linalg.qr(rng.normal(size=(self.width, self.width)))[0])
        return np.hstack(turns)[:, :wanted]

    def projected(self, raw: pd.Series, dtype: str) -> np.ndarray:
        entries = np.zeros((len(raw), self.width))
        for row, value in zip(entries, raw):
            vector = np.frombuffer(value, dtype)
            row[: len(vector)] = vector
        return entries @ self.axes()

    def keys(self, projected: np.ndarray, mean: np.ndarray, deviation: np.ndarray) -> np.ndarray:
        """Keys of all curves, one column each. The grid spans five deviations and the shift."""
        s = self.settings
        shift = np.random.default_rng(s.seed + 1).uniform(0.0, 1.25, size=projected.shape[1])
        scaled = ((projected - mean) / deviation + 2.5 + shift) / 6.25
        cells = np.clip(scaled * (1 << s.bits), 0, (1 << s.bits) - 1).astype(np.int64)
        return np.stack([hilbert_keys(cells[:, c * s.axes : (c + 1) * s.axes], s.bits) for c in range(s.curves)], axis=1)


def usable(rows: DataFrame, vector: str, id_column: str) -> tuple[DataFrame, str]:
    """``(id, point, dim, raw)`` of the rows that take part, and the type of the raw entries.

    ``point`` is a digest of the entries as doubles; equal vectors share it.
    """
    element = rows.schema[vector].dataType.elementType
    dtype = "<f4" if isinstance(element, FloatType) else "<f8"
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    clean = rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    clean = clean.where(F.col("id").isNotNull() & v.isNotNull()).where((F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0.0))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from hashlib import md5

        for batch in batches:
            # Adding zero makes -0.0 equal 0.0.
            arrays = [np.asarray(value, dtype="<f8") + 0.0 for value in batch["v"]]
            yield pd.DataFrame(
                {
                    "id": batch["id"],
                    "point": [md5(a.tobytes()).digest() for a in arrays],
                    "dim": np.array([len(a) for a in arrays], dtype=np.int32),
                    "raw": [a.astype(dtype).tobytes() for a in arrays],
                }
            )

    return clean.mapInPandas(pack, "id long, point binary, dim int, raw binary"), dtype


def moments(points: DataFrame, orderings: Orderings, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of all points on every axis, from sums of all tasks."""
    axes = orderings.settings.curves * orderings.settings.axes

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, one, two = 0, np.zeros(axes), np.zeros(axes)
        for batch in batches:
            if len(batch):
                p = orderings.projected(batch["raw"], dtype)
                n, one, two = n + len(p), one + p.sum(axis=0), two + (p**2).sum(axis=0)
        if n:
            yield pd.DataFrame({"axis": np.arange(axes), "n": n, "one": one, "two": two})

    parts = points.select("raw").mapInPandas(sums, "axis int, n long, one double, two double")
    rows = sorted(parts.groupBy("axis").agg(F.sum("n"), F.sum("one"), F.sum("two")).collect())
    n, one, two = (np.array([r[i] for r in rows], dtype=float) for i in (1, 2, 3))
    mean = one / n
    deviation = np.sqrt(np.maximum(two / n - mean**2, 0.0))
    return mean, np.where(deviation > 0.0, deviation, 1.0)


def places_on_curves(points: DataFrame, orderings: Orderings, dtype: str, count: int) -> DataFrame:
    """``(curve, place, point, dim)``: the place of every point on every curve, from 0."""
    mean, deviation = moments(points, orderings, dtype)

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            keys = orderings.keys(orderings.projected(batch["raw"], dtype), mean, deviation)
            for curve in range(keys.shape[1]):
                yield pd.DataFrame({"curve": curve, "dim": batch["dim"], "key": keys[:, curve], "point": batch["point"]})

    keyed_rows = points.select("point", "dim", "raw").mapInPandas(keyed, "curve int, dim int, key long, point binary")
    placed = number_rows(keyed_rows, ["curve", "dim", "key", "point"], "number")
    return placed.select("curve", (F.col("number") - F.col("curve") * F.lit(count)).alias("place"), "point", "dim")


def _nearest(queries: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and exact distance of at least the ``k`` nearest rows of every query.

    Products choose the rows; everything within their rounding of the k-th is measured again.
    """
    found = []
    squares = (rows**2).sum(axis=1)
    step = max(1, (1 << 22) // max(1, len(rows)))
    for start in range(0, len(queries), step):
        q = queries[start : start + step]
        own = (q**2).sum(axis=1)
        near = squares[None, :] - 2.0 * (q @ rows.T) + own[:, None]
        last = min(k, len(rows)) - 1
        limit = np.partition(near, last, axis=1)[:, last] + 1e-12 * (own + squares.max(initial=0.0))
        which, row = np.nonzero(near <= limit[:, None])
        # Rows that tie with the k-th may be many; they are measured a part at a time.
        for part in range(0, len(which), 1 << 16):
            w, r = which[part : part + (1 << 16)], row[part : part + (1 << 16)]
            found.append((w + start, r, np.sqrt(((q[w] - rows[r]) ** 2).sum(axis=1))))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(parts) for parts in zip(*found))


def _best(which: np.ndarray, row: np.ndarray, distance: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` first rows of every query, by distance and then by smallest id."""
    order = np.lexsort((ids[row], distance, which))
    starts = np.searchsorted(which[order], which[order], side="left")
    return order[np.arange(len(order)) - starts < k]


def _unpacked(raw, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(raw), dtype).reshape(len(raw), -1).astype(float)


def first_k(pairs: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of every key. Spark keeps ``k`` a key and task before it shuffles."""
    ranked = pairs.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rank") <= k).drop("_rank")


def trial_neighbours(points: DataFrame, trials: DataFrame, dtype: str, k: int) -> pd.DataFrame:
    """The true nearest points ``(query, point)`` of at most ``trials`` queries, in one pass."""
    chosen = trials.select("point", "dim", "raw").toPandas()
    by_dim = {d: (own["point"].tolist(), _unpacked(own["raw"].tolist(), dtype)) for d, own in chosen.groupby("dim")}

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, own in batch.groupby("dim"):
                if dim not in by_dim:
                    continue
                asked, vectors = by_dim[dim]
                names = np.array(own["point"].tolist(), dtype=object)
                which, row, distance = _nearest(vectors, _unpacked(own["raw"].tolist(), dtype), k + 1)
                keep = _best(which, row, distance, own["low"].to_numpy(), k + 1)
                yield pd.DataFrame({"query": [asked[i] for i in which[keep]], "point": names[row[keep]], "distance": distance[keep]})

    pairs = points.select("point", "dim", "raw", "low").mapInPandas(compare, "query binary, point binary, distance double")
    others = pairs.where(F.col("query") != F.col("point"))
    return first_k(others, ["query"], [F.col("distance"), F.col("point")], k).select("query", "point").toPandas()


def window_width(places: DataFrame, neighbours: pd.DataFrame, settings: CurveSettings) -> int:
    """Places on each side that hold the wanted share of the given neighbours."""
    if not len(neighbours):
        return settings.least
    spark = places.sparkSession
    named = pd.unique(pd.concat([neighbours["query"], neighbours["point"]]))
    wanted = F.broadcast(spark.createDataFrame(pd.DataFrame({"point": named}), "point binary"))
    found = places.join(wanted, "point").select("point", "curve", "place").toPandas()
    found["point"] = found["point"].map(bytes)
    table = found.pivot(index="point", columns="curve", values="place")
    own = table.loc[neighbours["query"].map(bytes)].to_numpy()
    other = table.loc[neighbours["point"].map(bytes)].to_numpy()
    apart = np.abs(own - other).min(axis=1)
    return max(settings.least, int(np.quantile(apart, settings.recall, method="higher")))


def compare_windows(
    points: DataFrame, places: DataFrame, asked: DataFrame, width: int, count: int, dtype: str, k: int, s: CurveSettings
) -> DataFrame:
    """``(query, point, distance)``: the ``k`` nearest points in the windows of every query."""
    queries = asked.count()
    # Queries expected to meet a block decide into how many shares a block's queries go.
    expected = queries * min(1.0, (s.block + 2.0 * width) / max(1, count))
    shares = max(1, -(-int(expected) // s.meeting))
    raw = points.select("point", "raw", "low")
    rows = places.select(
        "curve", F.expr(f"place div {s.block}").alias("block"), "dim", F.lit(False).alias("asks"), "point",
        F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"),
    )
    first, last = F.greatest(F.col("place") - width, F.lit(0)), F.least(F.col("place") + width, F.lit(count - 1))
    lookers = places.join(asked.select("point"), "point", "left_semi").select(
        "curve", F.explode(F.sequence(F.expr("0L") + F.floor(first / s.block), F.floor(last / s.block))).alias("block"),
        "dim", F.lit(True).alias("asks"), "point", F.pmod(F.xxhash64("point"), F.lit(shares)).cast("int").alias("share"),
    )
    met = rows.unionByName(lookers).join(raw, "point")

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in block.groupby("dim"):
            asks = own["asks"].to_numpy()
            if not asks.any() or asks.all():
                continue
            names = np.array(own["point"].tolist(), dtype=object)
            vectors = _unpacked(own["raw"].tolist(), dtype)
            asked_names, row_names, lows = names[asks], names[~asks], own["low"].to_numpy()[~asks]
            which, row, distance = _nearest(vectors[asks], vectors[~asks], k + 1)
            other = asked_names[which] != row_names[row]
            which, row, distance = which[other], row[other], distance[other]
            keep = _best(which, row, distance, lows, k)
            found = {"query": asked_names[which[keep]], "point": row_names[row[keep]], "low": lows[row[keep]], "distance": distance[keep]}
            out.append(pd.DataFrame(found))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "point": [], "low": [], "distance": []})

    pairs = met.groupBy("curve", "block", "share").applyInPandas(compare, "query binary, point binary, low long, distance double")
    once = pairs.groupBy("query", "point", "low").agg(F.min("distance").alias("distance"))
    return first_k(once, ["query"], [F.col("distance"), F.col("low")], k).drop("low")


def nearest_neighbours(
    rows: DataFrame, vector: str, id_column: str, asks: Column, k: int = 10, settings: CurveSettings = CurveSettings()
) -> DataFrame:
    """``(query_id, rank, id, score)``: the ``k`` nearest ids found for every id that ``asks``.

    ``asks`` is a condition on the column ``id``. ``score`` is the Euclidean distance in doubles.
    """
    members, dtype = usable(rows, vector, id_column)
    members = settle(members)
    empty = members.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), "id", F.lit(0.0).alias("score"))
    points = settle(members.groupBy("point").agg(F.first("dim").alias("dim"), F.first("raw").alias("raw"), F.min("id").alias("low")))
    size = points.agg(F.count("*"), F.max("dim")).first()
    if not size[0]:
        return empty
    count, orderings = size[0], Orderings(size[1], settings)
    slim = members.select("id", "point").distinct()
    few = first_k(slim, ["point"], [F.col("id")], k + 1)
    holders = settle(few.groupBy("point").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    queries = settle(slim.where(asks))
    asked = settle(queries.select("point").distinct())
    places = settle(places_on_curves(points, orderings, dtype, count))
    trials = asked.orderBy("point").limit(settings.trials).join(points, "point")
    width = window_width(places, trial_neighbours(points, trials, dtype, k), settings)
    near = compare_windows(points, places, asked, width, count, dtype, k, settings)
    own = asked.select(F.col("point").alias("query"), "point", F.lit(0.0).alias("distance"))
    expanded = near.unionByName(own).join(holders, "point").select("query", "distance", F.explode("ids").alias("id"))
    answers = expanded.groupBy("query", "id").agg(F.min("distance").alias("distance"))
    answers = first_k(answers, ["query"], [F.col("distance"), F.col("id")], k + 1)
    listed = answers.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("distance", "id"))).alias("list"))
    # Many query ids may share a point; its list is repeated, and they are spread over the copies.
    salts = settings.salts
    copies = listed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = queries.select(
        F.col("id").alias("query_id"), F.col("point").alias("query"), F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt")
    )
    joined = spread.join(copies, ["query", "salt"]).select("query_id", F.explode("list").alias("x"))
    others = joined.select("query_id", "x.distance", "x.id").where(F.col("id") != F.col("query_id"))
    others = others.groupBy("query_id", "id").agg(F.min("distance").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "id")
    ranked = others.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score")
