"""Reconstruction error, threshold, alerts and ranking.

One row per trajectory step or per trajectory: model-sized tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nascent.operators.clusters import GLOBAL
from nascent.operators.panel import WINDOW
from nascent.operators.trajectory import FEATURES


def mean_reconstruction(trajectories: DataFrame) -> DataFrame:
    """Every step rebuilt as the cluster's own mean: the simplest reference model."""
    whole = Window.partitionBy(GLOBAL)
    return trajectories.select(
        GLOBAL, WINDOW, *[F.avg(f).over(whole).alias(f) for f in FEATURES]
    )


def reconstruction_errors(actual: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """``(global, first_window, length, error, four feature errors)``."""
    other = rebuilt.select(GLOBAL, WINDOW, *[F.col(f).alias(f"_{f}") for f in FEATURES])
    squared = [F.avg(F.pow(F.col(f) - F.col(f"_{f}"), 2)).alias(f"{f}_error") for f in FEATURES]
    errors = actual.join(other, [GLOBAL, WINDOW]).groupBy(GLOBAL, "first_window", "length").agg(*squared)
    overall = sum((F.col(f"{f}_error") for f in FEATURES), F.lit(0.0)) / len(FEATURES)
    return errors.withColumn("error", overall)


def sequence_errors(rebuilt: DataFrame) -> DataFrame:
    """The same from arrays: columns ``sequence`` and ``rebuilt`` of equal shape."""

    def feature(i: int):
        squares = F.zip_with(
            "sequence", "rebuilt", lambda x, y: F.pow(F.get(x, F.lit(i)) - F.get(y, F.lit(i)), 2)
        )
        return F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x) / F.size("sequence")

    errors = rebuilt.select(
        GLOBAL, "first_window", "length", *[feature(i).alias(f"{f}_error") for i, f in enumerate(FEATURES)]
    )
    overall = sum((F.col(f"{f}_error") for f in FEATURES), F.lit(0.0)) / len(FEATURES)
    return errors.withColumn("error", overall)


def choose_threshold(training_errors: DataFrame, quantile: float = 0.95, margin: float = 0.05) -> DataFrame:
    """One row: exact interpolated quantile of the training errors plus a margin."""
    return training_errors.agg(
        (F.percentile("error", quantile) * (1.0 + margin)).alias("threshold"),
        F.count("*").alias("n_training"),
    )


def rank_clusters(errors: DataFrame, threshold: DataFrame) -> DataFrame:
    """All clusters by falling error, with the alert flag and per-feature errors."""
    order = Window.orderBy(F.desc("error"), F.col(GLOBAL))
    flagged = errors.withColumn("_one", F.lit(1)).join(
        threshold.select("threshold", F.lit(1).alias("_one")), "_one"
    )
    return flagged.select(
        F.row_number().over(order).alias("rank"),
        GLOBAL,
        "first_window",
        "error",
        F.struct(*[F.round(f"{f}_error", 6).alias(f) for f in FEATURES]).alias("per_feature"),
        (F.col("error") > F.col("threshold")).alias("alert"),
    )


def alerts(ranked: DataFrame) -> DataFrame:
    """Alerts only, with the feature errors as a map."""
    pairs = [part for f in FEATURES for part in (F.lit(f), F.col(f"per_feature.{f}"))]
    return ranked.where("alert").select(
        GLOBAL, "first_window", "error", F.create_map(*pairs).alias("per_feature")
    )


def sensitivity_sweep(errors: DataFrame, training: DataFrame, quantiles: list[float], margins: list[float]) -> DataFrame:
    """``(quantile, margin, threshold, alerts)`` for every parameter pair.

    The parameter grid is a literal array on the one-row quantile table, and each
    trajectory is compared with all grid points in one pass.
    """
    cuts = training.agg(
        F.percentile("error", F.array(*[F.lit(q) for q in quantiles])).alias("cuts")
    ).select(
        F.explode(
            F.flatten(
                F.array(
                    *[
                        F.array(
                            *[
                                F.struct(
                                    F.lit(q).alias("quantile"),
                                    F.lit(m).alias("margin"),
                                    (F.get("cuts", F.lit(i)) * (1.0 + m)).alias("threshold"),
                                )
                                for m in margins
                            ]
                        )
                        for i, q in enumerate(quantiles)
                    ]
                )
            )
        ).alias("g")
    ).select("g.*", F.lit(1).alias("_one"))
    return (
        errors.select("error", F.lit(1).alias("_one"))
        .join(F.broadcast(cuts), "_one")
        .groupBy("quantile", "margin", "threshold")
        .agg(F.sum((F.col("error") > F.col("threshold")).cast("int")).alias("alerts"))
    )
