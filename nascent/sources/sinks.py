"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nascent.operators.panel import DATE, ID, WINDOW


def write_panel(panel: DataFrame, path: str, slices: int = 32) -> None:
    """Parquet by window, each file in date order.

    Rows are spread by window and a hash of the id, so a dominant window is written by
    several tasks; sorting happens inside the tasks only.
    """
    (
        panel.repartition(WINDOW, F.pmod(F.xxhash64(ID), F.lit(slices)))
        .sortWithinPartitions(WINDOW, DATE)
        .write.mode("overwrite")
        .partitionBy(WINDOW)
        .parquet(path)
    )


def write_csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """CSV with a header; quotes inside quoted text are doubled, line breaks are kept."""
    out = df.orderBy(*order) if order else df
    out.write.mode("overwrite").options(header="true", quote='"', escape='"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per line with keys in name order, nested columns included."""
    flat = df.select(*sorted(df.columns))
    flat.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_dashboard(
    points: DataFrame, clusters: DataFrame, metrics: DataFrame, path: str
) -> None:
    """The three dashboard tables as JSON lines; points are laid out by cluster."""
    points.write.mode("overwrite").partitionBy("cluster_id").json(f"{path}/points")
    clusters.orderBy("id").write.mode("overwrite").json(f"{path}/clusters")
    metrics.write.mode("overwrite").json(f"{path}/metrics")


def write_ranked(ranked: DataFrame, threshold: DataFrame, path: str) -> None:
    """Ranked clusters and the threshold they were judged by."""
    write_json(ranked.orderBy("rank"), f"{path}/ranked_clusters")
    write_json(threshold, f"{path}/threshold")
