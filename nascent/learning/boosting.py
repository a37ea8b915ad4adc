"""Boosted trees for all classes at once, on histograms of binned features.

Features are cut at quantiles into at most 255 bins. A round fits one tree a class to the
gradient of the softmax loss. A level of all trees of a round is one Spark job: every shard
adds up first and second derivatives per class, node, feature and bin, Spark sums the
shards' histograms, and the best split of each node is found where its sum is. What
reaches the driver is one row per open node of a class.

Rows keep their scores as of the last ``refresh`` rounds; a pass adds the trees since then.
Derivatives are rounded to 2**-30, so sums are exact up to millions of rows a node and do
not depend on how rows are dealt. Rows are sampled anew each round by a hash of their id.

Defined results: rows without label or vector, or with fewer features than others, do not train;
such a vector is predicted from the shares of the classes; a missing value of a feature goes to the lowest bin; equal gains
go to the first feature, then the lowest cut; with one class there are no trees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nascent.learning.trainer import FAN_IN, make_shards, matrix, shards_for
from nascent.session import fix_partitions

ALL_LEFT = 255
ROUNDING = 2.0**30


@dataclass(frozen=True)
class BoostSettings:
    trees: int = 120
    depth: int = 5
    rate: float = 0.08
    subsample: float = 0.8
    bins: int = 32
    l2: float = 1.0
    least_weight: float = 0.01
    refresh: int = 10
    seed: int = 17


@dataclass
class Tree:
    """Trees of one round: a row per class, nodes level by level."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def blank(cls, classes: int, depth: int) -> Tree:
        inner = (classes, 2**depth - 1)
        cut = np.full(inner, ALL_LEFT, dtype=np.uint8)
        return cls(np.zeros(inner, dtype=np.int64), cut, np.zeros((classes, 2**depth)), np.zeros(inner))

    def nodes(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node of every row and class after that many levels."""
        found = np.zeros((len(self.value), len(bins)), dtype=np.int64)
        flat, starts = bins.ravel(), np.arange(len(bins)) * bins.shape[1]
        for feature, cut, node in zip(self.feature, self.cut, found, strict=True):
            for level in range(levels):
                at = node + (2**level - 1)
                right = flat.take(starts + feature.take(at)) > cut.take(at)
                node *= 2
                node += right
        return found.T

    def scores(self, bins: np.ndarray) -> np.ndarray:
        depth = int(np.log2(self.value.shape[1]))
        return self.value[np.arange(len(self.value))[None, :], self.nodes(bins, depth)]


@dataclass
class Forest:
    classes: list
    base: np.ndarray
    edges: np.ndarray
    trees: list[Tree] = field(default_factory=list)

    def binned(self, values: np.ndarray) -> np.ndarray:
        """The bin of every value: how many edges of its feature lie below it."""
        bins = np.empty(values.shape, dtype=np.uint8)
        for i, edges in enumerate(self.edges):
            bins[:, i] = np.searchsorted(edges, np.nan_to_num(values[:, i], nan=-np.inf, posinf=np.inf, neginf=-np.inf))
        return bins

    def importance(self) -> list[tuple[int, float]]:
        """Total gain per feature, largest first."""
        total = np.zeros(len(self.edges))
        for tree in self.trees:
            np.add.at(total, tree.feature[tree.gain > 0], tree.gain[tree.gain > 0])
        order = np.lexsort((np.arange(len(total)), -total))
        return [(int(i), float(total[i])) for i in order if total[i] > 0]


def softmax(scores: np.ndarray) -> np.ndarray:
    grown = np.exp(scores - scores.max(axis=1, keepdims=True))
    return grown / grown.sum(axis=1, keepdims=True)


def derivatives(scores: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the softmax loss by every score."""
    share = softmax(scores)
    first = share.copy()
    first[np.arange(len(label)), label] -= 1
    rounded = [np.round(x * ROUNDING) / ROUNDING for x in (first, share * (1 - share))]
    return rounded[0], rounded[1]


def in_sample(keys: np.ndarray, number: int, settings: BoostSettings) -> np.ndarray:
    """Which rows take part in a round, by a mixed hash of key, seed and round."""
    mixed = keys.astype(np.uint64) ^ np.uint64((settings.seed * 1_000_003 + number) * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    mixed ^= mixed >> np.uint64(31)
    return mixed / 2.0**64 < settings.subsample


def histograms(
    columns: np.ndarray, node: np.ndarray, taken: np.ndarray, wanted: np.ndarray, values: tuple[np.ndarray, ...], bins: int
) -> np.ndarray:
    """Sums of ``values`` by wanted node, feature and bin (together) and value.

    A feature at a time, so that its bins and sums stay in the processor's cache. Rows of other
    nodes are left out if they are many, else they go to a place behind the wanted ones.
    """
    if 2 * taken.sum() < len(taken):
        columns, node, values = columns[:, taken], node[taken], tuple(v[taken] for v in values)
    place = np.full(int(node.max()) + 1, len(wanted))
    place[wanted] = np.arange(len(wanted))
    start, size = place[node] * bins, (len(wanted) + 1) * bins
    values = [np.ascontiguousarray(v) for v in values]
    sums, where = np.empty((len(wanted), len(columns), bins, len(values))), np.empty_like(start)
    for feature, column in enumerate(columns):
        np.add(start, column, out=where)
        for i, value in enumerate(values):
            sums[:, feature, :, i] = np.bincount(where, value, size).reshape(-1, bins)[:-1]
    return sums.reshape(len(wanted), -1, len(values))


def best_split(sums: np.ndarray, settings: BoostSettings) -> tuple[int, int, float, np.ndarray, np.ndarray]:
    """``(feature, cut, gain, left sums, all sums)`` of a histogram by feature, bin and derivative."""
    total = sums[0].sum(axis=0)
    left = sums.cumsum(axis=1)[:, :-1]
    right = total - left
    worth = lambda s: s[..., 0] ** 2 / (s[..., 1] + settings.l2)
    gain = worth(left) + worth(right) - worth(total)
    gain[np.minimum(left[..., 1], right[..., 1]) < settings.least_weight] = -np.inf
    feature, cut = np.unravel_index(int(gain.argmax()), gain.shape)
    return int(feature), int(cut), float(gain[feature, cut]), left[feature, cut], total


def bin_edges(rows: DataFrame, vector: str, width: int, bins: int) -> np.ndarray:
    """Quantiles of every feature, one row each; sketches are merged before the shuffle."""
    shares = F.array(*(F.lit(i / bins) for i in range(1, bins)))
    cells = rows.select(F.posexplode(vector).alias("feature", "value")).where(~F.isnan("value"))
    found = cells.groupBy("feature").agg(F.percentile_approx("value", shares, F.lit(100 * bins)).alias("edges")).collect()
    edges = np.full((width, bins - 1), np.inf)
    for row in found:
        edges[row["feature"]] = row["edges"]
    return edges


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    parts = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(parts).combine_chunks() if parts else None


def _bins_of(table: pa.Table, features: int) -> np.ndarray:
    joined = b"".join(table.column("bins").to_pylist())
    return np.frombuffer(joined, dtype=np.uint8).reshape(-1, features)


def _level(shards: DataFrame, count: int, pending: list[Tree], tree: Tree, open_: np.ndarray, level: int, number: int, settings: BoostSettings, features: int):
    """One row per open node: its best split from the histograms of all shards."""
    bins = settings.bins

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _whole(batches)
        if table is None:
            return
        table = table.filter(pa.array(in_sample(table.column("key").to_numpy(), number, settings)))
        if not table.num_rows:
            return
        cells, scores = _bins_of(table, features), matrix(table.column("scores"))
        for grown in pending:
            scores = scores + grown.scores(cells)
        first, second = derivatives(scores, table.column("y").to_numpy())
        nodes = tree.nodes(cells, level)
        columns = np.ascontiguousarray(cells.T, dtype=np.int64)
        shard = table.column("shard")[0].as_py()
        for label in range(len(open_)):
            node = np.ascontiguousarray(nodes[:, label])
            taken = open_[label][node]
            wanted = np.flatnonzero(np.bincount(node[taken], minlength=open_.shape[1]))
            if not len(wanted):
                continue
            sums = histograms(columns, node, taken, wanted, (first[:, label], second[:, label]), bins)
            yield _histograms(shard, label, list(zip(wanted, sums, strict=True)))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, label, node, sums in _added(batches, features):
            feature, cut, gain, left, whole = best_split(sums, settings)
            row = [label, node, feature, cut, gain, *left, *whole]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, FOUND, strict=True)], schema=FOUND)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, label, node, sums in _added(batches, features):
            yield _histograms(shard, label, [(node, sums.reshape(-1, 2))])

    kind = "shard int, class int, node int, sums binary"
    sums = shards.mapInArrow(add_up, kind)
    if count > FAN_IN:
        sums = sums.withColumn("shard", F.pmod("shard", F.lit(FAN_IN)))
        sums = _sorted_by(sums, "class", "node", "shard").mapInArrow(merge, kind)
    if count > 1:  # one shard's sums already are whole and in order
        sums = _sorted_by(sums.withColumn("shard", F.lit(0)), "class", "node")
    schema = "class int, node int, feature int, cut int, gain double, left_g double, left_h double, g double, h double"
    return sums.mapInArrow(split, schema).collect()


FOUND = pa.schema(
    [(name, pa.int32()) for name in ("class", "node", "feature", "cut")]
    + [(name, pa.float64()) for name in ("gain", "left_g", "left_h", "g", "h")]
)
SUMS = pa.schema([("shard", pa.int32()), ("class", pa.int32()), ("node", pa.int32()), ("sums", pa.binary())])


def _histograms(shard: int, label: int, found: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    nodes, sums = zip(*found, strict=True)
    columns = [[shard] * len(nodes), [label] * len(nodes), [int(n) for n in nodes], [s.tobytes() for s in sums]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SUMS, strict=True)], schema=SUMS)


def _sorted_by(sums: DataFrame, *keys: str) -> DataFrame:
    return sums.repartition(*keys).sortWithinPartitions(*keys)


def _added(batches: Iterator[pa.RecordBatch], features: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """Sums of the histograms of one key after another; holds one of them at a time."""
    held, total = None, None
    for batch in batches:
        for shard, label, node, sums in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            key, values = (shard, label, node), np.frombuffer(sums).reshape(features, -1, 2)
            if key == held:
                total = total + values
                continue
            if held is not None:
                yield (*held, total)
            held, total = key, values
    if held is not None:
        yield (*held, total)


def _grow(shards, count, classes, pending, number, settings, features) -> Tree | None:
    """The trees of one round; None if no node of any class is worth a split."""
    depth, tree = settings.depth, Tree.blank(classes, settings.depth)
    open_ = np.ones((classes, 1), dtype=bool)
    leaf = lambda s: -settings.rate * s[0] / (s[1] + settings.l2)
    for level in range(depth):
        following = np.zeros((classes, 2 ** (level + 1)), dtype=bool)
        for row in _level(shards, count, pending, tree, open_, level, number, settings, features):
            label, node = row["class"], row["node"]
            whole, left = np.array([row["g"], row["h"]]), np.array([row["left_g"], row["left_h"]])
            width = 2 ** (depth - level)
            if not row["gain"] > 1e-9:
                tree.value[label, node * width] = leaf(whole)
                continue
            at = 2**level - 1 + node
            tree.feature[label, at], tree.cut[label, at], tree.gain[label, at] = row["feature"], row["cut"], row["gain"]
            # A child that is not seen again, or not split, keeps this value.
            tree.value[label, node * width] = leaf(left)
            tree.value[label, node * width + width // 2] = leaf(whole - left)
            following[label, 2 * node : 2 * node + 2] = True
        if not following.any():
            break
        open_ = following
    return tree if tree.gain.any() else None


def train(rows: DataFrame, id_column: str, label: str, vector: str, settings: BoostSettings | None = None) -> Forest:
    """Trees for every class of ``label`` on the array column ``vector``."""
    settings = settings or BoostSettings()
    if not 2 <= settings.bins <= ALL_LEFT:
        raise ValueError(f"bins must be 2 to {ALL_LEFT}")
    kind, label_kind = (dict(rows.dtypes)[name] for name in (id_column, label))
    values = F.col(vector).cast("array<double>").alias("vector")
    rows = rows.select(F.col(id_column).alias("id"), F.col(label).alias("label"), values)
    rows = rows.where(F.col("label").isNotNull() & F.col("vector").isNotNull())
    width = rows.select(F.max(F.size("vector"))).first()[0] or 0
    rows = rows.where(F.size("vector") == width)
    counts = rows.groupBy("label").agg(F.count("*").alias("n")).orderBy("label").collect()
    if not counts:
        raise ValueError("no rows to train on")
    names = [r["label"] for r in counts]
    total = sum(r["n"] for r in counts)
    base = np.log(np.array([r["n"] / total for r in counts]))
    forest = Forest(names, base, bin_edges(rows, "vector", width, settings.bins))
    if len(names) < 2 or not width:
        return forest

    def to_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = forest.binned(matrix(batch.column("vector")))
            columns = {name: batch.column(name) for name in ("id", "key", "y")}
            columns["bins"] = pa.array([c.tobytes() for c in cells], pa.binary())
            columns["scores"] = pa.array([base.tolist()] * len(cells), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_pydict(columns)

    order = rows.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], f"label {label_kind}, y int")
    known = rows.join(F.broadcast(order), "label")  # one row a class
    known = known.select("id", F.xxhash64("id").alias("key"), "y", "vector")
    schema = f"id {kind}, key bigint, y int, bins binary, scores array<double>"
    count = shards_for(total)
    shards = make_shards(known.mapInArrow(to_bins, schema), "id", count)
    shards = shards.withColumn("shard", F.spark_partition_id())
    pending: list[Tree] = []
    for number in range(settings.trees):
        tree = _grow(shards, count, len(names), pending, number, settings, width)
        if tree is None:
            continue  # another sample may hold a split
        forest.trees.append(tree)
        pending.append(tree)
        if len(pending) == settings.refresh and number + 1 < settings.trees:
            shards, pending = _refreshed(shards, pending, width, f"{schema}, shard int"), []
    return forest


def _refreshed(shards: DataFrame, pending: list[Tree], features: int, schema: str) -> DataFrame:
    """Shards whose scores include the pending trees, written once."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cells, scores = _bins_of(pa.Table.from_batches([batch]), features), matrix(batch.column("scores"))
            for tree in pending:
                scores = scores + tree.scores(cells)
            columns = {name: batch.column(name) for name in batch.schema.names}
            columns["scores"] = pa.array(list(scores), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_pydict(columns)

    return fix_partitions(shards.mapInArrow(add, schema))


def predict(forest: Forest, rows: DataFrame, vector: str, *keep: str) -> DataFrame:
    """``keep`` columns, ``predicted`` (the class as text) and ``share`` (its probability); no shuffle.

    The trees are sent to the tasks; their size is classes times trees times 2**depth.
    """
    kinds = dict(rows.dtypes)
    sent = rows.sparkSession.sparkContext.broadcast(forest)
    width = len(forest.edges)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Forest = sent.value
        names = np.array([str(c) for c in model.classes], dtype=object)
        for batch in batches:
            if not batch.num_rows:
                continue
            scores = np.repeat(model.base[None, :], batch.num_rows, axis=0)
            vectors = batch.column("__vector")
            present = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
            if len(present) and model.trees:
                cells = model.binned(matrix(vectors.drop_null()))
                scores[present] += sum(tree.scores(cells) for tree in model.trees)
            share = softmax(scores)
            best = share.argmax(axis=1)
            columns = {name: batch.column(name) for name in keep}
            columns["predicted"] = pa.array(names[best].tolist(), pa.string())
            columns["share"] = pa.array(share[np.arange(len(best)), best])
            yield pa.RecordBatch.from_pydict(columns)

    fitting = F.when(F.size(vector) == width, F.col(vector).cast("array<double>")).alias("__vector")
    schema = ", ".join(f"`{name}` {kinds[name]}" for name in keep) + ", predicted string, share double"
    return rows.select(*keep, fitting).mapInArrow(place, schema)
