"""Trained models on the supplied tables; no SQL can follow these."""

from __future__ import annotations

from pyspark.sql import functions as F

from nascent.learning import classify, clustering, sequences
from nascent.learning.kernels import DenseAutoencoder
from nascent.learning.trainer import make_shards
from nascent.operators import quality
from nascent.operators.clusters import GLOBAL, LOCAL
from nascent.operators.panel import ID, WINDOW
from nascent.plans import cluster_queries, end_to_end, views
from nascent.plans.registry import r6, register
from nascent.session import settle

SETTINGS = clustering.SMALL


def _shards(spark, sf_dir):
    vectors = views.clustered(spark, sf_dir).select(ID, WINDOW, "vector")
    return make_shards(vectors, ID)


@register("kmeans_init")
def kmeans_init(spark, sf_dir):
    df = views.clustered(spark, sf_dir)
    centres = clustering.initial_centroids(df, views.CLUSTERS, 2, 23, "vector")
    rows = [(i, [float(v) for v in c]) for i, c in enumerate(centres)]
    return spark.createDataFrame(rows, f"{LOCAL} int, centroid array<double>")


@register("autoencoder")
def autoencoder(spark, sf_dir):
    shards = _shards(spark, sf_dir)
    network = DenseAutoencoder(64, SETTINGS.hidden, SETTINGS.latent)
    weights, _ = clustering.train_autoencoder(shards, network, SETTINGS)
    return clustering.encode(shards, network, weights).select(ID, WINDOW, "latent")


@register("dec_windows")
def dec_windows(spark, sf_dir):
    found = clustering.cluster_windows(views.clustered(spark, sf_dir).drop(LOCAL), SETTINGS)
    return found.assignments


@register("dec_summary")
def dec_summary(spark, sf_dir):
    # Quarters instead of months: fewer, larger windows.
    quarter = F.ceil(F.substring(WINDOW, 6, 2).cast("int") / 3).cast("string")
    points = views.clustered(spark, sf_dir).withColumn(WINDOW, F.concat(F.lit("2024Q"), quarter))
    return clustering.cluster_windows(points.drop(LOCAL), SETTINGS).summary


@register("quality_gain")
def quality_gain(spark, sf_dir):
    """Silhouette of the k-means start and after self-training, on the latent vectors."""
    import numpy as np

    shards = _shards(spark, sf_dir)
    network = DenseAutoencoder(64, SETTINGS.hidden, SETTINGS.latent)
    model = clustering.ClusteringModel(network, SETTINGS.k)
    start, _ = clustering.train_autoencoder(shards, network, SETTINGS)
    latents = clustering.encode(shards, network, start)
    centres = clustering.initial_centroids(latents, SETTINGS.k, 1, SETTINGS.seed)
    before = np.concatenate([start, centres.ravel()])
    after, _ = clustering.fine_tune(shards, model, before, SETTINGS, SETTINGS.max_epochs)
    stages = []
    for stage, weights in (("start", before), ("tuned", after)):
        own, _ = model.split(weights)
        placed = clustering.assign_rows(shards, model, weights).select(ID, LOCAL)
        coded = clustering.encode(shards, network, own).select(
            ID, F.lit("all").alias(WINDOW), F.col("latent").alias("vector")
        )
        scored = quality.silhouette(settle(coded.join(placed, ID)))
        stages.append(scored.select(F.lit(stage).alias("stage"), "n_points", "n_clusters", "silhouette_sq"))
    return stages[0].unionByName(stages[1])


@register("emergence_score")
def emergence_score(spark, sf_dir):
    built = settle(cluster_queries.trajectories(spark, sf_dir))
    settings = end_to_end.RunSettings(sequence=sequences.SMALL)
    _, _, ranked = end_to_end.score(built, settings)
    return ranked.select("rank", GLOBAL, "first_window", r6("error").alias("error"), "per_feature.*", "alert")


def _labelled(spark, sf_dir):
    df = views.clustered(spark, sf_dir).select(ID, F.col(LOCAL).cast("string").alias("label"), "vector")
    return classify.split(df, "label")


@register("mlp_classifier")
def mlp_classifier(spark, sf_dir):
    return classify.train_mlp(_labelled(spark, sf_dir), "label", hidden=(64, 32), iterations=(20, 40))


@register("boosted_fused")
def boosted_fused(spark, sf_dir):
    return classify.train_boosted(_labelled(spark, sf_dir), "label", trees=100, depth=5, fold=8)


@register("model_table")
def model_table(spark, sf_dir):
    return classify.compare(
        _labelled(spark, sf_dir),
        "label",
        {
            "mlp": lambda parts: classify.train_mlp(parts, "label", hidden=(64, 32)),
            "filtered mlp": lambda parts: classify.train_filtered_mlp(parts, "label", hidden=(32,)),
            "boosted trees": lambda parts: classify.train_boosted(parts, "label", trees=5, depth=3, fold=8),
        },
    )


@register("backtest")
def backtest(spark, sf_dir):
    raw = views.complaints(spark, sf_dir, spread=True)
    # Every benchmark passage is a case; all are recognised within the data's time span.
    cases = views.cases(spark, sf_dir).withColumn("recognition_date", F.lit("2022-03-01"))
    settings = end_to_end.RunSettings(window="Q", dim=64, cluster=SETTINGS, sequence=sequences.SMALL)
    return end_to_end.backtest(raw, cases, settings)
