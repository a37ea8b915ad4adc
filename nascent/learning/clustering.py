"""Autoencoder, deep clustering of a window, and the rolling run over all windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nascent.learning.kernels import Adam, ClusteringModel, DenseAutoencoder, Tuner, sharpened
from nascent.learning.trainer import in_order, make_shards, matrix, minibatches, shards_for, train_round
from nascent.operators import quality, sampling
from nascent.operators.clusters import GLOBAL, LOCAL
from nascent.operators.linking import link_clusters
from nascent.operators.panel import ID, WINDOW
from nascent.session import path_exists, scratch_path


@dataclass(frozen=True)
class ClusterSettings:
    """Defaults of the full profile."""

    k: int = 24
    latent: int = 32
    hidden: tuple[int, ...] = (256, 128)
    pretrain_epochs: int = 60
    max_epochs: int = 8000
    refresh_every: int = 140
    tolerance: float = 0.001
    batch: int = 128
    rate: float = 1e-3
    epochs_per_window: int = 4
    replay: int = 0
    link_threshold: float = 0.5
    seed: int = 23
    # Epochs a shard runs on its own before the weights are averaged.
    epochs_per_round: int = 10
    kmeans_starts: int = 3
    kmeans_iterations: int = 20
    shards: int | None = None


# Steps of a single shard between two jobs: minutes that a lost executor costs.
JOB_STEPS = 200_000
TUNED = pa.schema(
    [("w", pa.list_(pa.float64())), ("before", pa.list_(pa.float64())), ("done", pa.int64())]
    + [("change", pa.float64()), ("loss", pa.float64()), ("ended", pa.bool_())]
)

SMALL = ClusterSettings(
    k=8, latent=16, hidden=(64, 32), pretrain_epochs=10, max_epochs=20, refresh_every=10,
    epochs_per_window=1, kmeans_starts=1,
)


def train_autoencoder(
    shards: DataFrame, network: DenseAutoencoder, settings: ClusterSettings, vector: str = "vector"
) -> tuple[np.ndarray, list[float]]:
    """Weights and the loss of every round."""
    weights, losses, done = network.initial(settings.seed), [], 0
    while done < settings.pretrain_epochs:
        epochs = min(settings.epochs_per_round, settings.pretrain_epochs - done)

        def learn(local, batch, rng, epochs=epochs):
            x = matrix(batch.column(vector))
            adam, loss = Adam(local.size, settings.rate), 0.0
            for _ in range(epochs):
                loss = 0.0
                for rows in minibatches(len(x), settings.batch, rng):
                    part, grad = network.loss_and_gradient(local, x[rows])
                    adam.step(local, grad)
                    loss += part * len(rows)
            return local, loss / len(x), len(x)

        weights, loss, _ = train_round(shards, weights, learn, settings.seed + done)
        losses.append(loss)
        done += epochs
    return weights, losses


def encode(df: DataFrame, network: DenseAutoencoder, weights: np.ndarray, vector: str = "vector", out: str = "latent") -> DataFrame:
    """Add the latent vector; weights are broadcast, rows stay where they are."""
    sent = df.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf("array<double>")
    def latent(column: pa.Array) -> pa.Array:
        return list_column(network.encode(sent.value, matrix(column)))

    return df.withColumn(out, latent(F.col(vector)))


def list_column(values: np.ndarray) -> pa.Array:
    rows, width = values.shape
    offsets = np.arange(0, (rows + 1) * width, width, dtype=np.int32) if rows else np.zeros(1, dtype=np.int32)
    return pa.ListArray.from_arrays(offsets, np.ascontiguousarray(values, dtype=np.float64).reshape(-1))


def initial_centroids(
    latents: DataFrame, k: int, starts: int, seed: int, column: str = "latent", iterations: int = 20
) -> np.ndarray:
    """Best of several k-means runs on the latent vectors."""
    latents_key = F.col(column)
    features = latents.select(column, array_to_vector(column).alias("features")).persist()
    try:
        # The library cannot seed more centres than there are different points.
        different = features.select(F.approx_count_distinct(F.xxhash64(latents_key))).first()[0]
        if different < 2 * k:
            different = features.select(latents_key).distinct().count()
        most = max(1, min(k, different))
        if most == 1:
            centre = features.select(Summarizer.mean(F.col("features"))).first()[0].toArray()
            return np.tile(centre, (k, 1))
        models = [
            KMeans(k=most, seed=seed + i, maxIter=iterations, featuresCol="features").fit(features)
            for i in range(starts)
        ]
    finally:
        features.unpersist()
    best = min(models, key=lambda m: m.summary.trainingCost)
    centres = np.array(best.clusterCenters())
    if len(centres) < k:
        # Fewer distinct points than clusters: repeat centres so that shapes agree.
        centres = np.resize(centres, (k, centres.shape[1]))
    return centres


def _frequencies(
    shards: DataFrame, model: ClusteringModel, now: np.ndarray, before: np.ndarray | None, vector: str
) -> tuple[np.ndarray, float]:
    """Cluster frequencies and the share of labels that changed since ``before``."""
    sent = shards.sparkSession.sparkContext.broadcast((now, before))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, previous = sent.value
        total, changed, n = np.zeros(model.k), 0, 0
        for batch in batches:
            x = matrix(batch.column(vector))
            if not len(x):
                continue
            q = model.assign(current, x)
            total += q.sum(axis=0)
            n += len(x)
            if previous is not None:
                changed += int((q.argmax(axis=1) != model.assign(previous, x).argmax(axis=1)).sum())
        if n:
            yield pa.RecordBatch.from_pydict(
                {"f": pa.array([total.tolist()], pa.list_(pa.float64())), "changed": [changed], "n": [n]}
            )

    row = (
        shards.mapInArrow(work, "f array<double>, changed long, n long")
        .agg(Summarizer.sum(array_to_vector("f")).alias("f"), F.sum("changed").alias("c"), F.sum("n").alias("n"))
        .first()
    )
    sent.unpersist()
    return row["f"].toArray(), (row["c"] / row["n"] if before is not None else 1.0)


def fine_tune(
    shards: DataFrame,
    model: ClusteringModel,
    weights: np.ndarray,
    settings: ClusterSettings,
    max_epochs: int,
    vector: str = "vector",
) -> tuple[np.ndarray, dict]:
    """Self-training: sharpen the assignments, pull encoder and centroids, repeat.

    The target needs one global number per cluster; each row's target is then computed
    on the fly from the weights at the last refresh, so no per-row state is stored.

    With several shards every round and every refresh is a job. A single shard has nothing to
    average with, so its task does the same steps without leaving, ``JOB_STEPS`` at a time.
    """
    way = _tune_alone if shards.rdd.getNumPartitions() == 1 else _tune_in_rounds
    return way(shards, model, weights, settings, max_epochs, vector)


def _epochs_on(
    model: ClusteringModel, weights: np.ndarray, x: np.ndarray, p: np.ndarray, epochs: int, settings: ClusterSettings, rng: np.random.Generator
) -> tuple[Tuner, float]:
    """One shard's steps and the mean loss of the last epoch."""
    tuner, total = model.tuner(weights, settings.rate), 0.0
    for epoch in range(epochs):
        for rows in minibatches(len(x), settings.batch, rng):
            total += tuner.step(x, p, rows, epoch == epochs - 1) * len(rows)
    return tuner, total / len(x)


def _tune_in_rounds(
    shards: DataFrame, model: ClusteringModel, weights: np.ndarray, settings: ClusterSettings, max_epochs: int, vector: str
) -> tuple[np.ndarray, dict]:
    before, done, change, loss = None, 0, 1.0, float("nan")
    context = shards.sparkSession.sparkContext
    while True:
        frequency, change = _frequencies(shards, model, weights, before, vector)
        if before is not None and change < settings.tolerance:
            break
        if done >= max_epochs:
            break
        before = weights
        target = context.broadcast((weights, frequency))
        until = min(done + settings.refresh_every, max_epochs)
        while done < until:
            epochs = min(settings.epochs_per_round, until - done)

            def learn(local, batch, rng, epochs=epochs, target=target):
                x = matrix(batch.column(vector))
                snapshot, f = target.value
                p = sharpened(model.assign(snapshot, x), f)
                tuner, part = _epochs_on(model, local, x, p, epochs, settings, rng)
                return tuner.weights(), part, len(x)

            weights, loss, _ = train_round(shards, weights, learn, settings.seed + 7919 + done)
            done += epochs
        target.unpersist()
    return weights, {"epochs": done, "label_change": change, "kl": loss}


def _tune_alone(
    shard: DataFrame, model: ClusteringModel, weights: np.ndarray, settings: ClusterSettings, max_epochs: int, vector: str
) -> tuple[np.ndarray, dict]:
    """As :func:`_tune_in_rounds`, equal to the last bit, in a job for many refreshes."""
    context = shard.sparkSession.sparkContext
    before, done, loss = None, 0, float("nan")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [batch for batch in batches if batch.num_rows]
        if not parts:
            return
        x = matrix(in_order(parts).column(vector))
        ends = np.cumsum([0, *(part.num_rows for part in parts)])
        pieces = [slice(start, end) for start, end in zip(ends[:-1], ends[1:], strict=True)]
        now, previous, done, loss = sent.value
        labels = None if previous is None else np.concatenate([model.assign(previous, x[rows]).argmax(axis=1) for rows in pieces])
        steps, change = 0, 1.0
        while True:
            shares = [model.assign(now, x[rows]) for rows in pieces]
            frequency = sum((q.sum(axis=0) for q in shares), np.zeros(model.k))
            found = np.concatenate([q.argmax(axis=1) for q in shares])
            if labels is not None:
                change = int((found != labels).sum()) / len(x)
            ended = (labels is not None and change < settings.tolerance) or done >= max_epochs
            if ended or steps >= JOB_STEPS:
                break
            labels, previous = found, now
            p = sharpened(model.assign(now, x), frequency)
            until = min(done + settings.refresh_every, max_epochs)
            while done < until:
                epochs = min(settings.epochs_per_round, until - done)
                rng = np.random.default_rng([settings.seed + 7919 + done, 0])
                tuner, loss = _epochs_on(model, now, x, p, epochs, settings, rng)
                # The mean of one shard, rounded as ``average`` rounds it.
                now, loss = len(x) * tuner.weights() / len(x), loss * len(x) / len(x)
                done += epochs
                steps += epochs * -(-len(x) // settings.batch)
        row = {"w": now, "before": previous, "done": done, "change": change, "loss": loss, "ended": ended}
        yield pa.RecordBatch.from_pylist([row], schema=TUNED)

    while True:
        sent = context.broadcast((weights, before, done, loss))
        rows = shard.mapInArrow(work, "w array<double>, before array<double>, done long, change double, loss double, ended boolean").collect()
        sent.unpersist()
        if not rows:
            raise ValueError("no rows to train on")
        row = rows[0]
        weights, done, loss = np.array(row["w"]), row["done"], row["loss"]
        before = None if row["before"] is None else np.array(row["before"])
        if row["ended"]:
            return weights, {"epochs": done, "label_change": row["change"], "kl": loss}


def assign_rows(shards: DataFrame, model: ClusteringModel, weights: np.ndarray, vector: str = "vector") -> DataFrame:
    """Rows with ``local_cluster`` and the autoencoder's error on the row."""
    sent = shards.sparkSession.sparkContext.broadcast(weights)
    keep = [f for f in shards.schema.fields if f.name != vector]
    schema = T.StructType(
        [*keep, T.StructField(LOCAL, T.IntegerType()), T.StructField("recon_error", T.DoubleType())]
    )
    names = [f.name for f in keep]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(vector))
            own, _ = model.split(sent.value)
            arrays = [batch.column(name) for name in names]
            arrays.append(pa.array(model.assign(sent.value, x).argmax(axis=1).astype(np.int32)))
            arrays.append(pa.array(model.network.row_errors(own, x)))
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, LOCAL, "recon_error"])

    return shards.mapInArrow(work, schema)


@dataclass
class WindowClusters:
    """Result of the rolling run."""

    assignments: DataFrame
    links: DataFrame
    summary: DataFrame
    rounds: list[dict]


def by_window(vectors: DataFrame) -> DataFrame:
    """The vectors written once, laid out by window, so that a window reads only itself.

    A window is split over several tasks by the hash of the id; a dominant window does
    not end up in one of them.
    """
    spark = vectors.sparkSession
    path = scratch_path(spark, "vectors")
    slices = F.pmod(F.xxhash64(ID), F.lit(32))
    vectors.repartition(WINDOW, slices).write.partitionBy(WINDOW).parquet(path)
    return spark.read.schema(vectors.schema).parquet(path)


def cluster_step(
    training: DataFrame, n: int, model: ClusteringModel, weights: np.ndarray | None, settings: ClusterSettings
) -> tuple[np.ndarray, dict]:
    """One window: a full start without weights, otherwise a short warm start."""
    if weights is None:
        start, _ = train_autoencoder(training, model.network, settings)
        latents = encode(training, model.network, start)
        first = initial_centroids(
            latents, settings.k, settings.kmeans_starts, settings.seed, iterations=settings.kmeans_iterations
        )
        return fine_tune(
            training, model, np.concatenate([start, first.ravel()]), settings, settings.max_epochs
        )
    limit = max(10, settings.epochs_per_window * (n // settings.batch + 1))
    return fine_tune(training, model, weights, settings, limit)


class WindowStates:
    """Weights, reservoir and facts of trained windows below a folder.

    A state is named by a digest over the settings and over all rows that led to it, window
    by window, so whoever has the same windows up to some point finds the state of that point:
    a run that starts again, or one with a later end.
    """

    def __init__(self, spark: SparkSession, folder: str, start: object):
        self.spark, self.folder = spark, folder
        self.name = self._digest(repr(start))

    @staticmethod
    def _digest(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def go_on(self, window: str, rows: int, content: object) -> None:
        self.name = self._digest(f"{self.name}|{window}|{rows}|{content}")

    def _path(self, kind: str) -> str:
        return f"{self.folder}/{self.name}/{kind}"

    def load(self) -> tuple[np.ndarray, dict] | None:
        if not path_exists(self.spark, f"{self._path('weights')}/_SUCCESS"):
            return None
        row = self.spark.read.parquet(self._path("weights")).first()
        return np.array(row["w"]), {k: row[k] for k in ("epochs", "label_change", "kl")}

    def reservoir(self, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self._path("reservoir"))

    def save(self, weights: np.ndarray, facts: dict, reservoir: DataFrame | None) -> None:
        """The weights come last: they tell that a state is whole."""
        if reservoir is not None:
            reservoir.write.mode("overwrite").parquet(self._path("reservoir"))
        row = (weights.tolist(), int(facts["epochs"]), float(facts["label_change"]), float(facts["kl"]))
        kind = "w array<double>, epochs int, label_change double, kl double"
        self.spark.createDataFrame([row], kind).write.mode("overwrite").parquet(self._path("weights"))


def merged_reservoir(before: DataFrame | None, own: DataFrame, settings: ClusterSettings) -> DataFrame:
    """The ``replay`` rows with the smallest hashes of all windows so far.

    Those of the earlier windows and the new window hold them, so a window adds one pass over
    its own rows and a table of that size, whatever came before.
    """
    rows = own if before is None else before.unionByName(own)
    return sampling.random_sample(rows, settings.replay, settings.seed, unique_ids=False)


def cluster_windows(
    vectors: DataFrame, settings: ClusterSettings = ClusterSettings(), states: str | None = None
) -> WindowClusters:
    """Cluster every window in time order, each starting from the one before it.

    ``vectors`` has ``(id, window, vector)``. A window with fewer rows than clusters does
    not train: its rows are assigned with the weights of the window before it, or, if it
    comes before all trained ones, with the first weights there are. If every window is
    that small, the largest one trains. Assignments go to the shared folder window by window.

    ``states`` is a folder for :class:`WindowStates`. Windows whose state is there do not
    train again; without a folder every run has its own.
    """
    spark = vectors.sparkSession
    stored = by_window(vectors.select(ID, WINDOW, "vector"))
    content = F.sum(F.xxhash64(ID, "vector").cast("decimal(38,0)")).alias("content")
    sizes = stored.groupBy(WINDOW).agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d"), content)
    plan = sizes.where(F.col(WINDOW).isNotNull()).orderBy(WINDOW).collect()
    if not plan:
        raise ValueError("no rows to cluster")
    enough = min(settings.k, max(r["n"] for r in plan))
    network = DenseAutoencoder(plan[0]["d"], settings.hidden, settings.latent)
    model = ClusteringModel(network, settings.k)
    path, centre_path = scratch_path(spark, "assignments"), scratch_path(spark, "centres")
    kept = WindowStates(spark, states or scratch_path(spark, "states"), (settings, enough, plan[0]["d"]))
    weights, rounds, waiting, reservoir = None, [], [], None

    def place(window: str, rows: DataFrame, facts: dict) -> None:
        assign_rows(rows, model, weights).write.mode("append").parquet(path)
        rounds.append({WINDOW: window, **facts})
        centres = [(window, local, [float(v) for v in centre]) for local, centre in enumerate(model.split(weights)[1])]
        centres = spark.createDataFrame(centres, f"{WINDOW} string, {LOCAL} int, centroid array<double>")
        centres.write.mode("append").parquet(centre_path)

    for row in plan:
        window, n = row[WINDOW], row["n"]
        shards = shards_for(n, settings.shards)
        rows = stored.where(F.col(WINDOW) == window)
        if n < enough:
            own = make_shards(rows, ID, shards)
            if weights is None:
                waiting.append((window, own))
            else:
                place(window, own, {"trained": False})
            continue
        kept.go_on(window, n, row["content"])
        known = kept.load()
        own = make_shards(rows, ID, shards)
        if known is not None:
            weights, facts = known
        else:
            training = own if reservoir is None else make_shards(own.unionByName(reservoir), ID, shards)
            weights, facts = cluster_step(training, n, model, weights, settings)
            kept.save(weights, facts, merged_reservoir(reservoir, own, settings) if settings.replay else None)
        if settings.replay:
            reservoir = kept.reservoir(own.schema)
        for earlier_window, held in waiting:
            place(earlier_window, held, {"trained": False})
        waiting = []
        place(window, own, {"trained": True, **facts})
    found = spark.read.schema(f"{WINDOW} string, {LOCAL} int, centroid array<double>").parquet(centre_path)
    links = link_clusters(found, settings.link_threshold)
    assigned = spark.read.schema(f"{ID} {_type_of(vectors, ID)}, {WINDOW} string, {LOCAL} int, recon_error double").parquet(path)
    linked = assigned.join(links.select(WINDOW, LOCAL, GLOBAL), [WINDOW, LOCAL])
    assignments = linked.select(ID, WINDOW, LOCAL, GLOBAL, "recon_error")
    trained = spark.createDataFrame([(r[WINDOW], r["trained"]) for r in rounds], f"{WINDOW} string, trained boolean")
    summary = window_summary(assignments, links, stored).join(trained, WINDOW)
    return WindowClusters(assignments, links, summary, rounds)


def _type_of(df: DataFrame, column: str) -> str:
    return dict(df.dtypes)[column]


def window_summary(assignments: DataFrame, links: DataFrame, stored: DataFrame) -> DataFrame:
    """One row per window: size, map of ids, cluster sizes, silhouette, reconstruction loss."""
    counts = assignments.groupBy(WINDOW, LOCAL).agg(
        F.count("*").alias("n"), F.sum("recon_error").alias("e")
    )
    slots = links.select(WINDOW, LOCAL, GLOBAL).join(counts, [WINDOW, LOCAL], "left")
    rows = slots.groupBy(WINDOW).agg(
        F.sum(F.coalesce("n", F.lit(0))).alias("n_points"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(LOCAL, GLOBAL)))).alias("local_to_global"),
        F.transform(
            F.sort_array(F.collect_list(F.struct(LOCAL, F.coalesce("n", F.lit(0)).alias("n")))), lambda s: s["n"]
        ).alias("cluster_sizes"),
        (F.sum("e") / F.sum("n")).alias("recon_loss"),
    )
    placed = stored.select(ID, WINDOW, "vector").join(assignments.select(ID, WINDOW, LOCAL), [ID, WINDOW])
    return rows.join(quality.silhouette(placed).select(WINDOW, "silhouette_sq"), WINDOW, "left")
