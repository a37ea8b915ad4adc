"""Cluster statistics and Student-t assignment.

A table of clustered vectors has one row per complaint: id, window, local cluster
and ``vector array<double>``. A table of centroids has one row per (window, local
cluster); its size is windows x clusters, independent of the number of complaints.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nascent.functions import vectors
from nascent.operators.panel import ID, WINDOW
from nascent.session import attach_small

LOCAL = "local_cluster"
GLOBAL = "global_cluster"


def cluster_sizes(assigned: DataFrame, k: int) -> DataFrame:
    """Members per window and local cluster, zero where a cluster is empty."""
    counts = assigned.groupBy(WINDOW, LOCAL).agg(F.count("*").alias("size"))
    slots = (
        counts.select(WINDOW)
        .distinct()
        .select(WINDOW, F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias(LOCAL))
    )
    return slots.join(counts, [WINDOW, LOCAL], "left").select(
        WINDOW, LOCAL, F.coalesce("size", F.lit(0).cast("long")).alias("size")
    )


def mean_vector(vector: Column) -> Column:
    """Aggregate: element-wise mean, combined on the map side."""
    return vector_to_array(Summarizer.mean(array_to_vector(vector)))


def centroids(assigned: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``(keys..., members, centroid)``: mean member vector."""
    keys = keys or [WINDOW, LOCAL]
    return assigned.groupBy(*keys).agg(
        F.count("*").alias("members"), mean_vector(F.col("vector")).alias("centroid")
    )


def full_centroids(assigned: DataFrame, k: int) -> DataFrame:
    """Centroids with a zero vector for every empty cluster of a window."""
    found = centroids(assigned)
    sized = found.withColumn("dim", F.max(F.size("centroid")).over(Window.partitionBy(WINDOW)))
    slots = (
        sized.select(WINDOW, "dim")
        .distinct()
        .select(WINDOW, "dim", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias(LOCAL))
    )
    return slots.join(found, [WINDOW, LOCAL], "left").select(
        WINDOW,
        LOCAL,
        F.coalesce("members", F.lit(0).cast("long")).alias("members"),
        F.coalesce("centroid", F.array_repeat(F.lit(0.0), F.col("dim"))).alias("centroid"),
    )


def mean_distances(assigned: DataFrame, found: DataFrame) -> DataFrame:
    """``(window, local, mean_dist)``: mean distance of members to their centroid.

    Members and centroids are both divided by the square root of the dimension.
    """
    damp = F.greatest(F.lit(1.0), F.sqrt(F.size("vector")))
    joined = attach_small(
        assigned, found.select(WINDOW, LOCAL, "centroid"), [WINDOW, LOCAL], spread=ID, row_bytes=8192
    )
    return joined.groupBy(WINDOW, LOCAL).agg(
        F.avg(vectors.distance(F.col("vector"), F.col("centroid")) / damp).alias("mean_dist")
    )


def centroid_matrices(found: DataFrame) -> DataFrame:
    """``(window, matrix)``: the centroids of a window as one array in cluster order."""
    return found.groupBy(WINDOW).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct(LOCAL, "centroid"))), lambda c: c["centroid"]
        ).alias("matrix")
    )


def soft_assign(points: DataFrame, found: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Add ``q array<double>``: Student-t weights of the centroids of the row's window."""
    joined = attach_small(points, centroid_matrices(found), [WINDOW], spread=ID, row_bytes=262_144)
    weights = F.transform(
        F.col("matrix"),
        lambda c: 1.0 / (1.0 + vectors.squared_distance(F.col("vector"), c) / alpha),
    )
    shares = vectors.let(weights, vectors.normalised)
    exponent = (alpha + 1.0) / 2.0
    if exponent != 1.0:
        shares = F.transform(shares, lambda q: F.pow(q, F.lit(exponent)))
    return joined.withColumn("q", shares).drop("matrix")


def hard_assign(soft: DataFrame) -> DataFrame:
    return soft.withColumn(LOCAL, vectors.argmax(F.col("q")))


def target_distribution(soft: DataFrame) -> DataFrame:
    """Add ``p array<double>``: squared assignments divided by cluster frequency, per row.

    Cluster frequencies are one map-side combined sum per window.
    """
    frequency = soft.groupBy(WINDOW).agg(
        vector_to_array(Summarizer.sum(array_to_vector(F.col("q")))).alias("_f")
    )
    joined = attach_small(soft, frequency, [WINDOW], spread=ID, row_bytes=4096)
    raw = F.zip_with("q", "_f", lambda q, f: q * q / f)
    return joined.withColumn("p", vectors.let(raw, vectors.normalised)).drop("_f")


def label_change(before: DataFrame, after: DataFrame, id_column: str = ID) -> DataFrame:
    """One row: share of ids whose local cluster differs between two assignments."""
    joined = before.select(id_column, F.col(LOCAL).alias("_before")).join(
        after.select(id_column, F.col(LOCAL).alias("_after")), id_column
    )
    return joined.agg(
        F.count("*").alias("n_points"),
        F.avg((F.col("_before") != F.col("_after")).cast("double")).alias("label_change"),
    )
