"""Product classifiers and their comparison: MLlib networks and boosted trees on histograms."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nascent.learning import boosting
from nascent.operators import features, quality, sampling
from nascent.operators.panel import ID
from nascent.session import settle


def _with_features(df: DataFrame, vector: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(vector))


def _fit(train: DataFrame, label: str, classifier) -> object:
    """Index the label in name order, fit, and turn predictions back into names."""
    indexer = StringIndexer(
        inputCol=label, outputCol="_y", stringOrderType="alphabetAsc", handleInvalid="error"
    ).fit(train)
    back = IndexToString(inputCol="_predicted", outputCol="predicted", labels=list(indexer.labels))
    return Pipeline(stages=[indexer, classifier, back]).fit(train)


def _predict(model, df: DataFrame, label: str) -> DataFrame:
    return model.transform(df).select(ID, F.col(label).cast("string").alias("truth"), "predicted")


def train_mlp(
    parts: DataFrame,
    label: str,
    vector: str = "vector",
    hidden: tuple[int, ...] = (512, 256, 128),
    iterations: tuple[int, ...] = (40,),
    seed: int = 17,
) -> DataFrame:
    """Test predictions of a feed-forward network.

    ``parts`` carries the split in ``part``. The number of iterations is chosen on the
    validation part; the test part is only predicted.
    """
    data = _with_features(parts, vector).persist()
    try:
        train = data.where("part = 'train'")
        dim = train.select(F.max(F.size(vector))).first()[0]
        classes = train.select(label).distinct().count()
        best = None
        for steps in iterations:
            network = MultilayerPerceptronClassifier(
                layers=[dim, *hidden, classes], maxIter=steps, seed=seed, labelCol="_y", predictionCol="_predicted"
            )
            model = _fit(train, label, network)
            if len(iterations) == 1:
                return _predict(model, data.where("part = 'test'"), label)
            checked = _predict(model, data.where("part = 'validation'"), label)
            score = evaluate(checked).first()["macro_f1"]
            if best is None or score > best[0]:
                best = (score, model)
        return _predict(best[1], data.where("part = 'test'"), label)
    finally:
        data.unpersist()


def train_boosted(
    parts: DataFrame,
    label: str,
    vector: str = "vector",
    trees: int = 120,
    depth: int = 5,
    rate: float = 0.08,
    subsample: float = 0.8,
    fold: int | None = 12,
    seed: int = 17,
) -> DataFrame:
    """Test predictions of boosted trees for all classes on the fused vector."""
    if fold:
        parts = features.sequence_fold_features(parts, fold, vector)
        vector = "fused"
    data = settle(parts.select(ID, F.col(label).cast("string").alias("truth"), "part", vector))
    settings = boosting.BoostSettings(trees, depth, rate, subsample, seed=seed)
    forest = boosting.train(data.where("part <> 'test'"), ID, "truth", vector, settings)
    return boosting.predict(forest, data.where("part = 'test'"), vector, ID, "truth").drop("share")


def train_filtered_mlp(parts: DataFrame, label: str, vector: str = "vector", **options) -> DataFrame:
    """The network on multi-width filter features."""
    return train_mlp(features.filter_features(parts, vector), label, "filtered", **options)


def evaluate(predictions: DataFrame) -> DataFrame:
    return quality.overall_metrics(
        quality.per_class_metrics(quality.confusion(predictions, "truth", "predicted"))
    )


def compare(parts: DataFrame, label: str, runs: dict) -> DataFrame:
    """One row per model: quality on the test part and the seconds it took.

    ``runs`` maps a name to a function from the split data to test predictions.
    """
    rows = []
    for name, run in runs.items():
        start = time.perf_counter()
        predictions = run(parts)
        trained = time.perf_counter()
        metrics = settle(evaluate(predictions))
        done = time.perf_counter()
        rows.append(
            metrics.select(
                F.lit(name).alias("model"),
                "*",
                F.lit(round(trained - start, 2)).alias("train_seconds"),
                F.lit(round(done - trained, 4)).alias("inference_seconds"),
            )
        )
    return reduce(lambda a, b: a.unionByName(b), rows)


def split(df: DataFrame, label: str, seed: int = 17) -> DataFrame:
    return settle(sampling.three_way_split(df, label, seed))
