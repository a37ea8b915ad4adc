"""Continuous forms of panel building, volume, novelty and window clustering.

Every micro-batch writes to a path named after its id and replaces what is there, so a
batch that is run again after a failure leaves the same result. State lives in parquet
below the given folder; nothing is kept on the driver between batches.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nascent.functions import text
from nascent.learning import clustering
from nascent.learning.kernels import ClusteringModel, DenseAutoencoder
from nascent.learning.trainer import make_shards
from nascent.operators import novelty, panel
from nascent.operators.clusters import LOCAL
from nascent.operators.linking import link_clusters
from nascent.operators.numbering import number_rows
from nascent.operators.panel import ID, NARRATIVE, WINDOW
from nascent.session import attach_small, path_exists, settle

BATCH = "batch"


def _start(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], folder: str, mode: str = "append"
) -> StreamingQuery:
    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{folder}/progress")
        .foreachBatch(handle)
        .trigger(availableNow=True)
        .start()
    )


def ingest(stream: DataFrame, folder: str, window: str = "M", min_words: int = 10) -> StreamingQuery:
    """Append to the panel and count what came in and what was kept, in one pass."""

    def handle(batch: DataFrame, number: int) -> None:
        seen = Observation()
        watched = batch.observe(
            seen,
            F.count(F.lit(1)).alias("raw"),
            F.count(F.when(text.is_present(F.col(NARRATIVE)), 1)).alias("kept"),
        )
        built = panel.build_panel(watched, window, min_words)
        built.write.mode("overwrite").parquet(f"{folder}/panel/{BATCH}={number}")
        counts = seen.get
        row = batch.sparkSession.createDataFrame([(counts["raw"], counts["kept"])], "raw long, kept long")
        row.write.mode("overwrite").parquet(f"{folder}/counts/{BATCH}={number}")

    return _start(stream, handle, folder)


def ingest_totals(spark: SparkSession, folder: str) -> DataFrame:
    """One row: rows seen and rows with a narrative so far."""
    return spark.read.parquet(f"{folder}/counts").agg(F.sum("raw").alias("raw"), F.sum("kept").alias("kept"))


def volume(
    stream: DataFrame, folder: str, time: str, keys: list[str], span: str = "1 day", lateness: str = "40 days"
) -> StreamingQuery:
    """Counts per tumbling window; rows later than the watermark are dropped.

    The changed counts of every batch are stored under its number; the newest of each
    window is the current one (see :func:`current_volume`).
    """
    timed = stream.withColumn(time, F.col(time).cast("timestamp"))
    counts = (
        timed.withWatermark(time, lateness)
        .groupBy(F.window(time, span).alias("w"), *keys)
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), *keys, "n")
    )

    def handle(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/volume/{BATCH}={number}")

    return _start(counts, handle, folder, "update")


def current_volume(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    stored = spark.read.parquet(f"{folder}/volume")
    return stored.groupBy("window_start", *keys).agg(F.max_by("n", BATCH).alias("n"))


# --- live novelty ---------------------------------------------------------------------------

_NUMBERED = "Emergent Cluster #"
_SEPARATOR = "\u0001"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _once(spark: SparkSession, path: str, write: Callable[[], None]) -> None:
    """Write unless an earlier try of this batch has done so completely."""
    if not path_exists(spark, f"{path}/_SUCCESS"):
        write()


def score_stream(
    stream: DataFrame, clusters: DataFrame, folder: str, threshold: float = novelty.NOVEL_AT
) -> StreamingQuery:
    """Score a stream of texts against a fixed set of clusters, into ``folder/scored``."""

    def handle(batch: DataFrame, number: int) -> None:
        path = f"{folder}/scored/{BATCH}={number}"
        scored = lambda: novelty.score_novelty(settle(batch), clusters, threshold)
        _once(batch.sparkSession, path, lambda: scored().write.mode("overwrite").parquet(path))

    return _start(stream, handle, folder)


def start_clusters(clusters: DataFrame, folder: str) -> None:
    """Store the known clusters ``(id, label, count, keywords)`` a live run starts from."""
    clusters.select("id", "label", "count", "keywords").write.mode("overwrite").parquet(f"{folder}/clusters")


def place_texts(stream: DataFrame, folder: str, threshold: float = novelty.NOVEL_AT, id_column: str = ID) -> StreamingQuery:
    """Judge each text by the clusters the run started from; call :func:`start_clusters` first.

    Familiar texts go to their cluster. Novel ones are summed per set of keywords and kind of
    label for :func:`grow_clusters`, so that a set with very many texts is one row a batch.
    Texts without an id are left out.
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        placed, novel = f"{folder}/placed/{BATCH}={number}", f"{folder}/novel/{BATCH}={number}"

        def place() -> None:
            known = spark.read.parquet(f"{folder}/clusters")
            scored = novelty.score_novelty(settle(batch.where(F.col(id_column).isNotNull())), known, threshold)
            named = F.concat(F.lit("Emergent: "), F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("Novel Fraud Pattern")))
            scored.select(
                id_column,
                "is_novel",
                F.col("assigned_cluster").cast("int").alias("cluster_id"),
                "spawn_keywords",
                F.array_join(F.array_sort("spawn_keywords"), _SEPARATOR).alias("_set"),
                F.when(F.col("has_emerging_term"), named).otherwise(_NUMBERED).alias("_kind"),
            ).write.mode("overwrite").parquet(placed)

        def sum_up() -> None:
            fresh = spark.read.parquet(placed).where("is_novel")
            fresh.groupBy("_set", "_kind").agg(
                F.min(id_column).alias("first"), F.count("*").alias("texts"), F.min_by("spawn_keywords", id_column).alias("keywords")
            ).write.mode("overwrite").parquet(novel)

        _once(spark, placed, place)
        _once(spark, novel, sum_up)

    return _start(stream, handle, folder)


def grow_clusters(spark: SparkSession, folder: str) -> StreamingQuery:
    """Open and grow clusters of novel texts, one state for each set of keywords and kind.

    A state has the first text's id, its batch and keywords, and how many texts there are. It
    is kept and merged on the JVM, without a call to Python for each cluster. Only the clusters
    that a batch touches are written. The state lives in the checkpoint below ``folder``, so a
    run that starts again goes on from it. RocksDB holds it, whatever the session's own choice is.
    """
    placed = spark.read.parquet(f"{folder}/novel")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.drop(BATCH).schema)
    novel = spark.readStream.schema(f"{fields}, {BATCH} long").parquet(f"{folder}/novel")
    head = F.min(F.struct("first", BATCH, "keywords")).alias("_head")
    grown = novel.groupBy("_set", "_kind").agg(head, F.sum("texts").alias("texts"))
    grown = grown.select("_set", "_kind", "_head.first", "texts", "_head.keywords")

    def handle(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/grown/{BATCH}={number}")

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, _ROCKS)
    try:
        # A query keeps the settings it is started with.
        return _start(grown, handle, f"{folder}/growth", "update")
    finally:
        spark.conf.set(provider, before)


def live_clusters(stream: DataFrame, folder: str, threshold: float = novelty.NOVEL_AT) -> None:
    """Place all texts that are there, then grow the clusters of the novel ones."""
    place_texts(stream, folder, threshold).awaitTermination()
    grow_clusters(stream.sparkSession, folder).awaitTermination()


def _homes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The clusters the run started from, and all others ``(_set, _kind, cluster_id, opened, ...)``.

    Numbers go on from those at the start, in order of each cluster's first text. Novel texts
    with the keywords and label of a cluster known at the start belong to that one.
    """
    known = spark.read.parquet(f"{folder}/clusters")
    kind = F.when(F.col("label").startswith(_NUMBERED), F.lit(_NUMBERED)).otherwise(F.col("label"))
    same = known.select(F.array_join(F.array_sort("keywords"), _SEPARATOR).alias("_set"), kind.alias("_kind"), "id")
    same = same.groupBy("_set", "_kind").agg(F.min("id").cast("int").alias("_old"))
    now = F.max_by(F.struct("first", "texts", "keywords"), BATCH).alias("now")
    groups = spark.read.parquet(f"{folder}/grown").groupBy("_set", "_kind").agg(now).select("_set", "_kind", "now.*")
    groups = settle(groups.join(same, ["_set", "_kind"], "left"))
    opened = number_rows(groups.where("_old is null"), ["first"], "_new", known.count())
    old = groups.where("_old is not null").withColumn("cluster_id", F.col("_old"))
    both = opened.withColumn("cluster_id", F.col("_new").cast("int")).drop("_new").unionByName(old)
    return known, settle(both)


def live_state(spark: SparkSession, folder: str) -> DataFrame:
    """``(id, label, count, keywords)`` of all clusters, known and opened."""
    known, homes = _homes(spark, folder)
    label = F.when(F.col("_kind") == _NUMBERED, F.concat("_kind", (F.col("cluster_id") + 1).cast("string"))).otherwise(F.col("_kind"))
    opened = homes.where("_old is null").select(F.col("cluster_id").alias("id"), label.alias("label"), F.col("texts").alias("count"), "keywords")
    familiar = spark.read.parquet(f"{folder}/placed").where(~F.col("is_novel")).groupBy(F.col("cluster_id").alias("id"))
    more = familiar.agg(F.count("*").alias("n")).unionByName(
        homes.where("_old is not null").select(F.col("_old").alias("id"), F.col("texts").alias("n"))
    )
    more = more.groupBy("id").agg(F.sum("n").alias("_more"))
    total = F.col("count") + F.coalesce("_more", F.lit(0))
    grown = known.withColumn("id", F.col("id").cast("int")).join(more, "id", "left").select("id", "label", total.alias("count"), "keywords")
    return grown.unionByName(opened)


def live_places(spark: SparkSession, folder: str, id_column: str = ID) -> DataFrame:
    """``(id, cluster_id, is_novel)`` of all texts seen."""
    _, homes = _homes(spark, folder)
    placed = spark.read.parquet(f"{folder}/placed")
    familiar = placed.where(~F.col("is_novel")).select(id_column, "cluster_id", "is_novel")
    fresh = placed.where("is_novel").drop("cluster_id")
    found = attach_small(fresh, homes.select("_set", "_kind", "cluster_id"), ["_set", "_kind"], spread=id_column)
    return familiar.unionByName(found.select(id_column, "cluster_id", "is_novel"))


# --- window-by-window clustering -------------------------------------------------------------------


EVENT_TIME, WINDOW_END = "event_time", "window_end"


def cluster_closed_windows(
    stream: DataFrame, folder: str, dim: int, settings: clustering.ClusterSettings, lateness: str = "0 seconds"
) -> StreamingQuery:
    """Cluster each window once event time has passed its end, starting from the last weights.

    ``stream`` has ``(id, window, vector, event_time, window_end)``. The watermark is the
    largest event time of all batches so far less ``lateness``; it never goes back. Rows that
    come out of order train their window as long as the watermark has not passed its end, in
    whatever batch they come. Rows that come later are placed with the window's own weights.
    Rows without an event time do not move the watermark; a window without an end closes
    with the stream. Vectors are kept by batch and window, so a closed window reads only its
    own files.
    """
    model = ClusteringModel(DenseAutoencoder(dim, settings.hidden, settings.latent), settings.k)

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(ID, WINDOW, "vector", WINDOW_END, EVENT_TIME)
        rows.write.mode("overwrite").partitionBy(WINDOW).parquet(f"{folder}/vectors/{BATCH}={number}")
        written = spark.read.schema(rows.schema).option("basePath", f"{folder}/vectors/{BATCH}={number}").parquet(f"{folder}/vectors/{BATCH}={number}")
        written.agg(F.max(EVENT_TIME).alias("latest")).write.mode("overwrite").parquet(f"{folder}/times/{BATCH}={number}")
        _advance(spark, folder, model, settings, number, lateness)

    return _start(stream, handle, folder)


def watermark(spark: SparkSession, folder: str, lateness: str, number: int):
    """The largest event time up to a batch less ``lateness``; None before any."""
    times = spark.read.parquet(f"{folder}/times").where(F.col(BATCH) <= number)
    return times.agg(F.max("latest") - F.expr(f"INTERVAL {lateness}")).first()[0]


def flush_windows(
    spark: SparkSession, folder: str, dim: int, settings: clustering.ClusterSettings, number: int = 1 << 40
) -> None:
    """Treat every stored window as closed, at the end of a stream."""
    model = ClusteringModel(DenseAutoencoder(dim, settings.hidden, settings.latent), settings.k)
    _advance(spark, folder, model, settings, number, None)


def _advance(spark, folder, model, settings, number, lateness) -> None:
    """Cluster the windows that the watermark has passed, and place this batch's late rows.

    A window with fewer rows than clusters takes the weights of the one before it, or waits
    for the first weights; at the end of a stream, without a ``lateness``, the largest window
    that waits trains.
    """
    stored = spark.read.parquet(f"{folder}/vectors").where(F.col(BATCH) <= number)
    finished = _finished(spark, folder, number)
    weights = _weights(spark, folder, finished[-1]) if finished else None
    late = stored.where((F.col(BATCH) == number) & F.col(WINDOW).isin(finished)) if finished else stored.limit(0)
    for (window,) in late.select(WINDOW).distinct().orderBy(WINDOW).collect():
        rows = late.where(F.col(WINDOW) == window).select(ID, WINDOW, "vector")
        _place(rows, model, _weights(spark, folder, window), folder, window, number)
    sizes = stored.where(~F.col(WINDOW).isin(finished)).groupBy(WINDOW).agg(F.count("*").alias("n"), F.max(WINDOW_END).alias("end"))
    if lateness is not None:
        reached = watermark(spark, folder, lateness, number)
        sizes = sizes.where(F.col("end") <= F.lit(reached)) if reached is not None else sizes.limit(0)
    closed = sizes.orderBy(WINDOW).collect()
    enough = settings.k
    if lateness is None and weights is None and closed:
        enough = min(enough, max(r["n"] for r in closed))
    waiting = []
    for row in closed:
        window, n = row[WINDOW], row["n"]
        rows = stored.where(F.col(WINDOW) == window).select(ID, WINDOW, "vector")
        if n < enough:
            waiting.append((window, rows))
        else:
            shards = make_shards(rows, ID, clustering.shards_for(n, settings.shards))
            weights, _ = clustering.cluster_step(shards, n, model, weights, settings)
            waiting.append((window, shards))
        if weights is not None:
            for name, own in waiting:
                _place(own, model, weights, folder, name, number)
                _keep(spark, folder, model, name, number, weights)
            waiting = []


def _keep(spark, folder, model, window, number, weights) -> None:
    """The centres of a finished window as rows, and then its weights, which mark it finished."""
    centres = [(window, local, [float(v) for v in centre]) for local, centre in enumerate(model.split(weights)[1])]
    rows = spark.createDataFrame(centres, f"{WINDOW} string, {LOCAL} int, centroid array<double>")
    rows.write.mode("overwrite").parquet(f"{folder}/centres/of={window}")
    state = spark.createDataFrame([(window, number, weights.tolist())], f"{WINDOW} string, number long, w array<double>")
    state.write.mode("overwrite").parquet(f"{folder}/weights/of={window}")


def _place(rows, model, weights, folder, window, number) -> None:
    """The clusters of a window's rows; a batch that is run again replaces its own part."""
    clustering.assign_rows(rows, model, weights).drop(WINDOW).write.mode("overwrite").parquet(
        f"{folder}/assigned/{WINDOW}={window}/part={number}"
    )


def _finished(spark: SparkSession, folder: str, number: int) -> list[str]:
    """Windows finished by earlier batches, in order."""
    if not path_exists(spark, f"{folder}/weights"):
        return []
    stored = spark.read.parquet(f"{folder}/weights").where(F.col("number") < number)
    return [r[0] for r in stored.select(WINDOW).orderBy(WINDOW).collect()]


def _weights(spark: SparkSession, folder: str, window: str) -> np.ndarray:
    return np.array(spark.read.parquet(f"{folder}/weights").where(F.col(WINDOW) == window).select("w").first()[0])


def streamed_assignments(spark: SparkSession, folder: str, settings: clustering.ClusterSettings) -> DataFrame:
    """``(id, window, local, global)`` of all windows clustered so far."""
    centres = spark.read.parquet(f"{folder}/centres").select(WINDOW, LOCAL, "centroid")
    links = link_clusters(centres, settings.link_threshold).drop("linked")
    assigned = spark.read.option("partitionOverwriteMode", "static").parquet(f"{folder}/assigned")
    return assigned.join(links, [WINDOW, LOCAL]).select(ID, WINDOW, LOCAL, "global_cluster")
