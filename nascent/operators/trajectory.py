"""One time series of four features per global cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nascent.functions import vectors
from nascent.operators.clusters import GLOBAL, LOCAL, centroids, mean_distances
from nascent.operators.panel import WINDOW
from nascent.session import settle

# Fixed order of the features.
FEATURES = ("centroid_shift", "volume", "volume_share", "mean_dist")
MIN_STEPS = 3


def build_trajectories(assigned: DataFrame, links: DataFrame) -> DataFrame:
    """``(global, window, members, step, length, first_window, features...)``.

    ``assigned`` is read twice: once for the centroids, once for the mean distances.
    All the rest runs on one row per (window, cluster).
    """
    found = settle(centroids(assigned))
    spread = mean_distances(assigned, found)
    per_window = (
        found.join(links.select(WINDOW, LOCAL, GLOBAL), [WINDOW, LOCAL])
        .join(spread, [WINDOW, LOCAL])
    )
    history = Window.partitionBy(GLOBAL).orderBy(WINDOW)
    whole = Window.partitionBy(GLOBAL)
    previous = F.lag("centroid").over(history)
    return per_window.withColumn("_previous", previous).select(
        GLOBAL,
        WINDOW,
        "members",
        F.row_number().over(history).alias("step"),
        F.count("*").over(whole).cast("int").alias("length"),
        F.min(WINDOW).over(whole).alias("first_window"),
        F.coalesce(vectors.distance(F.col("centroid"), F.col("_previous")), F.lit(0.0)).alias(
            "centroid_shift"
        ),
        F.log1p(F.col("members").cast("double")).alias("volume"),
        (F.col("members") / F.sum("members").over(Window.partitionBy(WINDOW))).alias("volume_share"),
        "mean_dist",
    )


def padded_sequences(trajectories: DataFrame, max_steps: int | None = None) -> DataFrame:
    """``(global, first_window, length, sequence)`` ready for the sequence model.

    All steps are gathered, or the last ``max_steps`` ones. A shorter series than three
    steps repeats its first step in front and keeps the others.
    """
    recent = trajectories
    if max_steps is not None:
        from_end = Window.partitionBy(GLOBAL).orderBy(F.desc(WINDOW))
        recent = recent.withColumn("_back", F.row_number().over(from_end)).where(F.col("_back") <= max_steps)
    row = F.struct(F.col("step"), F.array(*[F.col(f).cast("double") for f in FEATURES]).alias("x"))
    gathered = recent.groupBy(GLOBAL, "first_window", "length").agg(
        F.transform(F.sort_array(F.collect_list(row)), lambda s: s["x"]).alias("_steps")
    )
    missing = F.greatest(F.lit(MIN_STEPS) - F.size("_steps"), F.lit(0))
    return gathered.select(
        GLOBAL,
        "first_window",
        "length",
        F.concat(F.array_repeat(F.get("_steps", F.lit(0)), missing), F.col("_steps")).alias("sequence"),
    )


def settled_clusters(trajectories: DataFrame, min_length: int = 3) -> DataFrame:
    """Ids of the clusters to train on: those seen in at least ``min_length`` windows.

    If there are none, the first half in id order (at least one).
    """
    clusters = trajectories.groupBy(GLOBAL).agg(F.max("length").alias("length"))
    everything = Window.partitionBy()
    ranked = clusters.select(
        GLOBAL,
        "length",
        F.sum((F.col("length") >= min_length).cast("int")).over(everything).alias("_settled"),
        F.row_number().over(Window.orderBy(GLOBAL)).alias("_place"),
        F.count("*").over(everything).alias("_all"),
    )
    half = F.greatest(F.lit(1), F.expr("_all div 2"))
    keep = F.when(F.col("_settled") > 0, F.col("length") >= min_length).otherwise(
        F.col("_place") <= half
    )
    return ranked.where(keep).select(GLOBAL, "length")
