"""Tables behind the dashboard: points, clusters, metrics, filters and selections."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nascent.functions import text
from nascent.operators import products
from nascent.operators.numbering import renumber_by_size
from nascent.operators.panel import DATE, ID, NARRATIVE, WINDOW, WORDS
from nascent.operators.terms import DEFAULT_KEYWORDS, export_keywords
from nascent.session import attach_small

SNIPPET_LENGTH = 280

# Display colours in cluster order.
PALETTE = [
    "#3B82F6", "#10B981", "#F59E0B", "#8B5CF6", "#EC4899", "#06B6D4",
    "#F97316", "#14B8A6", "#E11D48", "#6366F1", "#84CC16",
]


def project_2d(df: DataFrame, vector: str = "vector") -> DataFrame:
    """Add ``pca_x`` and ``pca_y``: the first two principal components, rounded.

    Vectors are centred first; the sign of a component makes its largest loading
    positive. The components come from a d x d covariance summed up by the executors.
    """
    prepared = df.withColumn("_v", array_to_vector(vector))
    centre = prepared.select(Summarizer.mean(F.col("_v")).alias("m")).first()["m"].toArray()
    loadings = PCA(k=2, inputCol="_v", outputCol="_p").fit(prepared).pc.toArray()
    coordinates = []
    for axis in range(2):
        direction = loadings[:, axis]
        if direction[abs(direction).argmax()] < 0:
            direction = -direction
        weights = F.array(*[F.lit(float(x)) for x in direction])
        offset = float(centre @ direction)
        coordinates.append(
            F.round(
                F.aggregate(
                    F.zip_with(vector, weights, lambda x, w: x * w), F.lit(-offset), lambda a, x: a + x
                ),
                3,
            )
        )
    return (
        df.withColumn("pca_x", coordinates[0]).withColumn("pca_y", coordinates[1])
    )


def harmonic_projection(x: Column, y: Column) -> tuple[Column, Column]:
    """Closed-form non-linear layout of the two principal components."""
    return (
        F.round(x * 1.1 + F.sin(y * 2.5) * 0.25, 3),
        F.round(y * 1.1 + F.cos(x * 2.5) * 0.25, 3),
    )


def with_confidence(points: DataFrame, cluster: str = "cluster_id", id_column: str = ID) -> DataFrame:
    """Add ``confidence``: nearness to the cluster's mean position, 0.71 to 0.99."""
    centres = points.groupBy(cluster).agg(F.avg("x").alias("_cx"), F.avg("y").alias("_cy"))
    placed = attach_small(points, centres, [cluster], spread=id_column)
    away = placed.withColumn("_d", F.sqrt(F.pow(F.col("x") - F.col("_cx"), 2) + F.pow(F.col("y") - F.col("_cy"), 2)))
    farthest = away.groupBy(cluster).agg(F.max("_d").alias("_max"))
    return attach_small(away, farthest, [cluster], spread=id_column).withColumn(
        "confidence",
        F.round(0.99 - F.col("_d") / F.when(F.col("_max") > 0, F.col("_max")).otherwise(1.0) * 0.28, 3),
    ).drop("_cx", "_cy", "_d", "_max")


def cluster_table(panel: DataFrame, label: str = "label") -> DataFrame:
    """``(id, label, color, count, keywords)`` of the product clusters in ``panel``."""
    sizes = renumber_by_size(panel, label, "id")
    keywords = (
        export_keywords(panel, label, F.col(NARRATIVE))
        .groupBy(label)
        .agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("_k"))
        .select(label, F.transform("_k", lambda k: k["term"]).alias("keywords"))
    )
    palette = F.array(*[F.lit(c) for c in PALETTE])
    fallback = F.array(*[F.lit(k) for k in DEFAULT_KEYWORDS])
    return sizes.join(keywords, label, "left").select(
        "id",
        label,
        F.get(palette, F.col("id") % len(PALETTE)).alias("color"),
        "count",
        F.coalesce("keywords", fallback).alias("keywords"),
    )


def labelled_by_product(panel: DataFrame) -> DataFrame:
    """Panel with the display product as cluster ``label``."""
    return panel.withColumn("label", products.display_product(F.col("product")))


def points_table(panel: DataFrame, coordinates: DataFrame, clusters: DataFrame) -> DataFrame:
    """Nested points: position, cluster, confidence and metadata.

    ``coordinates`` has ``(id, pca_x, pca_y)``; rows are aligned by id.
    """
    x, y = harmonic_projection(F.col("pca_x"), F.col("pca_y"))
    numbered = attach_small(
        panel, clusters.select("label", F.col("id").alias("cluster_id")), ["label"], spread=ID
    )
    placed = numbered.join(coordinates, ID).withColumn("x", x).withColumn("y", y)
    clean = text.redact(F.coalesce(F.col(NARRATIVE), F.lit("")))
    title = F.concat(
        text.strip(F.split_part(F.coalesce("product", F.lit("Financial Product")), F.lit(","), F.lit(1))),
        F.lit(" Dispute"),
    )
    return with_confidence(placed).select(
        F.col(ID).cast("string").alias("id"),
        "x",
        "y",
        "pca_x",
        "pca_y",
        "cluster_id",
        "confidence",
        WINDOW,
        F.struct(
            title.alias("title"),
            F.coalesce("issue", F.lit("Account inquiry")).alias("issue"),
            F.coalesce("sub_issue", F.lit("Disputed account details")).alias("sub_issue"),
            text.snippet(clean, SNIPPET_LENGTH).alias("snippet"),
            clean.alias("full_snippet"),
            F.col(WORDS).alias("word_count"),
            F.substring(F.col(DATE).cast("string"), 1, 10).alias("timestamp"),
        ).alias("metadata"),
    )


def filter_points(
    points: DataFrame,
    clusters: list[int] | None = None,
    ids: DataFrame | None = None,
    query: str = "",
) -> DataFrame:
    """Visible clusters, an optional set of ids and a text search, all of them together."""
    out = points
    if clusters is not None:
        out = out.where(F.col("cluster_id").isin(*clusters))
    needle = query.strip().lower()
    if needle:
        fields = ["title", "snippet", "issue", "sub_issue"]
        hits = [F.contains(F.lower(F.col(f"metadata.{f}")), F.lit(needle)) for f in fields]
        out = out.where(F.coalesce(hits[0], F.lit(False)) | F.coalesce(hits[1], F.lit(False))
                        | F.coalesce(hits[2], F.lit(False)) | F.coalesce(hits[3], F.lit(False)))
    if ids is not None:
        out = out.join(ids.select("id"), "id", "left_semi")
    return out


def select_box(points: DataFrame, x: str, y: str, x_range: tuple, y_range: tuple) -> DataFrame:
    """Ids of the points inside a rectangle of the chosen projection."""
    return points.where(F.col(x).between(*x_range) & F.col(y).between(*y_range)).select("id")


def search_clusters(clusters: DataFrame, query: str) -> DataFrame:
    """Clusters whose label or any keyword contains the query."""
    needle = F.lit(query.lower())
    return clusters.where(
        F.contains(F.lower("label"), needle)
        | F.exists("keywords", lambda k: F.contains(F.lower(k), needle))
    )


def distribution(clusters: DataFrame) -> DataFrame:
    """Clusters from the smallest up, with their keywords."""
    return clusters.select("label", "count", "keywords").orderBy("count", "label")


def scatter_series(points: DataFrame, projection: str = "harmonic") -> DataFrame:
    """``(cluster_id, cx, cy, confidence, id)`` for the chosen projection.

    Long form on purpose: a series can be as large as the data, so it is written
    partitioned by cluster instead of being gathered into one row.
    """
    if projection == "pca":
        cx, cy = F.coalesce("pca_x", "x"), F.coalesce("pca_y", "y")
    else:
        cx, cy = F.col("x"), F.col("y")
    return points.select("cluster_id", cx.alias("cx"), cy.alias("cy"), "confidence", "id")


def first_rows(points: DataFrame, n: int = 100) -> DataFrame:
    """The first rows of the data table, in id order."""
    return points.orderBy("id").limit(n)


def dataset_metrics(points: DataFrame, clusters: DataFrame, quality: DataFrame) -> DataFrame:
    """One row: computed quality numbers and totals."""
    one = F.lit(1).alias("_one")
    totals = points.agg(F.count("*").alias("total_points"), one)
    count = clusters.agg(F.count("*").alias("total_clusters"), one)
    return (
        quality.withColumn("_one", F.lit(1))
        .join(totals, "_one")
        .join(count, "_one")
        .withColumn("noise_count", F.lit(0))
        .drop("_one")
    )


