"""Quality of clusters and classifiers."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nascent.functions import vectors
from nascent.operators.clusters import LOCAL, centroids, mean_vector
from nascent.operators.panel import ID, WINDOW
from nascent.session import attach_small, settle


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(
        F.count("*").alias("n")
    )


def per_class_metrics(counts: DataFrame) -> DataFrame:
    """``(label, support, predicted, precision, recall, f1)`` from a confusion table.

    Metrics are tied to the class by name. Labels seen only in the predictions count.
    """
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = counts.select(
        F.explode(
            F.array(
                F.struct(
                    F.col("truth").alias("label"),
                    F.col("n").alias("support"),
                    F.lit(0).cast("long").alias("predicted"),
                    hit.cast("long").alias("tp"),
                ),
                F.struct(
                    F.col("predicted").alias("label"),
                    F.lit(0).cast("long").alias("support"),
                    F.col("n").alias("predicted"),
                    F.lit(0).cast("long").alias("tp"),
                ),
            )
        ).alias("s")
    ).select("s.*")
    summed = sides.groupBy("label").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp")
    )
    zero = F.lit(0.0)
    return summed.select(
        "label",
        "support",
        "predicted",
        F.coalesce(F.try_divide("tp", "predicted"), zero).alias("precision"),
        F.coalesce(F.try_divide("tp", "support"), zero).alias("recall"),
        F.coalesce(F.try_divide(2 * F.col("tp"), F.col("support") + F.col("predicted")), zero).alias("f1"),
        "tp",
    )


def overall_metrics(per_class: DataFrame) -> DataFrame:
    """One row: accuracy, macro and weighted F1 over the classes."""
    return per_class.agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
        F.sum("support").alias("n_test"),
        F.count("*").alias("n_classes"),
    )


def majority_class(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """``(cluster, majority)``: the most frequent class of each cluster, ties by name."""
    counts = df.groupBy(cluster, label).agg(F.count("*").alias("n"))
    order = Window.partitionBy(cluster).orderBy(F.desc("n"), F.col(label))
    return (
        counts.withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") == 1)
        .select(cluster, F.col(label).alias("majority"))
    )


def cluster_class_agreement(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """Overall metrics when every cluster predicts its majority class."""
    table = df.groupBy(cluster, label).agg(F.count("*").alias("n"))
    counts = (
        table.join(majority_class(df, cluster, label), cluster)
        .groupBy(F.col(label).alias("truth"), F.col("majority").alias("predicted"))
        .agg(F.sum("n").alias("n"))
    )
    return overall_metrics(per_class_metrics(counts))


def cluster_moments(assigned: DataFrame) -> DataFrame:
    """``(window, local, n, centroid, mean_square)`` in one pass."""
    return assigned.groupBy(WINDOW, LOCAL).agg(
        F.count("*").alias("n"),
        mean_vector(F.col("vector")).alias("centroid"),
        F.avg(vectors.dot(F.col("vector"), F.col("vector"))).alias("mean_square"),
    )


def silhouette(assigned: DataFrame) -> DataFrame:
    """``(window, n_points, n_clusters, silhouette_sq)`` with squared Euclidean distance.

    The mean squared distance of a point to a cluster follows from the cluster's mean
    and mean square, so no pair of points is ever formed. Null where a window has fewer
    than two clusters or as many clusters as points.
    """
    moments = settle(cluster_moments(assigned))
    per_window = moments.groupBy(WINDOW).agg(
        F.collect_list(F.struct(LOCAL, "n", "centroid", "mean_square")).alias("_clusters")
    )
    joined = attach_small(assigned, per_window, [WINDOW], spread=ID, row_bytes=262_144)
    square = vectors.dot(F.col("vector"), F.col("vector"))
    away = vectors.let(
        square,
        lambda own_square: F.transform(
            "_clusters",
            lambda c: F.struct(
                c[LOCAL].alias("cluster"),
                c["n"].alias("n"),
                (own_square + c["mean_square"] - 2 * vectors.dot(F.col("vector"), c["centroid"])).alias("d"),
            ),
        ),
    )
    measured = joined.select(WINDOW, LOCAL, away.alias("_away"))
    own = F.get(F.filter("_away", lambda c: c["cluster"] == F.col(LOCAL)), F.lit(0))
    other = F.array_min(
        F.transform(F.filter("_away", lambda c: c["cluster"] != F.col(LOCAL)), lambda c: c["d"])
    )
    parts = measured.select(
        WINDOW,
        own["n"].alias("n"),
        (own["d"] * F.try_divide(own["n"], own["n"] - 1)).alias("a"),
        other.alias("b"),
    )
    score = F.when(F.col("n") == 1, 0.0).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    )
    scored = parts.groupBy(WINDOW).agg(F.avg(score).alias("mean_score"))
    shape = moments.groupBy(WINDOW).agg(F.sum("n").alias("n_points"), F.count("*").alias("n_clusters"))
    usable = (F.col("n_clusters") >= 2) & (F.col("n_clusters") < F.col("n_points"))
    return shape.join(scored, WINDOW).select(
        WINDOW,
        "n_points",
        "n_clusters",
        F.when(usable, F.col("mean_score")).alias("silhouette_sq"),
    )


def davies_bouldin(assigned: DataFrame) -> DataFrame:
    """``(window, n_clusters, davies_bouldin)``; pairs are pairs of centroids only."""
    found = settle(centroids(assigned))
    joined = attach_small(
        assigned, found.select(WINDOW, LOCAL, "centroid"), [WINDOW, LOCAL], spread=ID, row_bytes=8192
    )
    spread = joined.groupBy(WINDOW, LOCAL).agg(
        F.avg(vectors.distance(F.col("vector"), F.col("centroid"))).alias("s")
    )
    left = settle(found.join(spread, [WINDOW, LOCAL]).select(WINDOW, LOCAL, "centroid", "s"))
    right = left.select(
        WINDOW, F.col(LOCAL).alias("_other"), F.col("centroid").alias("_c"), F.col("s").alias("_s")
    )
    pairs = left.join(right, WINDOW).where(F.col(LOCAL) != F.col("_other"))
    gap = vectors.distance(F.col("centroid"), F.col("_c"))
    worst = (
        pairs.withColumn("ratio", F.coalesce(F.try_divide(F.col("s") + F.col("_s"), gap), F.lit(0.0)))
        .groupBy(WINDOW, LOCAL)
        .agg(F.max("ratio").alias("ratio"))
    )
    return worst.groupBy(WINDOW).agg(
        F.count("*").alias("n_clusters"), F.avg("ratio").alias("davies_bouldin")
    )


def calinski_harabasz(assigned: DataFrame) -> DataFrame:
    """``(window, n_points, n_clusters, calinski_harabasz)`` from cluster moments alone."""
    moments = settle(cluster_moments(assigned))
    weighted = Summarizer.metrics("mean").summary(
        array_to_vector(F.col("centroid")), F.col("n").cast("double")
    )
    whole = moments.groupBy(WINDOW).agg(
        vector_to_array(weighted.getField("mean")).alias("_centre"),
        F.sum("n").alias("n_points"),
        F.count("*").alias("n_clusters"),
    )
    sums = (
        moments.join(whole, WINDOW)
        .groupBy(WINDOW, "n_points", "n_clusters")
        .agg(
            F.sum(F.col("n") * vectors.squared_distance(F.col("centroid"), F.col("_centre"))).alias("between"),
            F.sum(
                F.col("n")
                * (F.col("mean_square") - vectors.dot(F.col("centroid"), F.col("centroid")))
            ).alias("within"),
        )
    )
    ratio = F.try_divide(
        F.col("between") * (F.col("n_points") - F.col("n_clusters")),
        F.col("within") * (F.col("n_clusters") - 1),
    )
    return sums.select(WINDOW, "n_points", "n_clusters", ratio.alias("calinski_harabasz"))


def error_gap(ranked: DataFrame) -> DataFrame:
    """One row: mean error of flagged and other clusters and their ratio."""
    flagged = F.avg(F.when(F.col("alert"), F.col("error")))
    normal = F.avg(F.when(~F.col("alert"), F.col("error")))
    return ranked.agg(
        F.sum(F.col("alert").cast("long")).alias("flagged"),
        F.sum((~F.col("alert")).cast("long")).alias("normal"),
        flagged.alias("flagged_error"),
        normal.alias("normal_error"),
        F.try_divide(flagged, normal).alias("error_ratio"),
    )


def precision_at_k(ranked: DataFrame, relevant: DataFrame, key: str, k: int) -> DataFrame:
    """One row: share of the ``k`` best-ranked clusters that are relevant."""
    best = ranked.where(F.col("rank") <= k)
    marked = best.join(relevant.select(key).distinct().withColumn("_hit", F.lit(1)), key, "left")
    return marked.agg(
        F.count("*").alias("ranked"),
        F.count("_hit").alias("hits"),
        F.try_divide(F.count("_hit"), F.count("*")).alias("precision_at_k"),
    )
