"""The report: ranked clusters with a label, examples and feature errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nascent.functions import text
from nascent.operators.clusters import GLOBAL
from nascent.operators.panel import NARRATIVE

EXAMPLE_LENGTH = 600
NO_LABEL = "(no narratives available)"


def joined_terms(labels: DataFrame, cluster: str = GLOBAL) -> DataFrame:
    """``(cluster, label)``: the ranked terms of a cluster as one text."""
    gathered = F.transform(
        F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda t: t["term"]
    )
    return labels.groupBy(cluster).agg(F.array_join(gathered, ", ").alias("label"))


def report_table(
    ranked: DataFrame, labels: DataFrame, narratives: DataFrame, cluster: str = GLOBAL
) -> DataFrame:
    """``narratives`` holds the few examples per cluster chosen before."""
    examples = narratives.groupBy(cluster).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("place", text.snippet(F.col(NARRATIVE), EXAMPLE_LENGTH).alias("x")))),
            lambda e: e["x"],
        ).alias("examples")
    )
    return (
        ranked.join(joined_terms(labels, cluster), cluster, "left")
        .join(examples, cluster, "left")
        .select(
            "rank",
            cluster,
            "first_window",
            "error",
            "alert",
            "per_feature",
            F.coalesce("label", F.lit(NO_LABEL)).alias("label"),
            F.coalesce("examples", F.array().cast("array<string>")).alias("examples"),
        )
    )
