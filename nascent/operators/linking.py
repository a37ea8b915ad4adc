"""Global cluster ids that persist across windows.

Works on the centroid table only: windows x clusters rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nascent.functions import vectors
from nascent.operators.clusters import GLOBAL, LOCAL
from nascent.operators.panel import WINDOW
from nascent.session import settle


def best_matches(found: DataFrame) -> DataFrame:
    """``(window, local, prev_window, prev_local, similarity)`` for consecutive windows.

    Joined on the position of the window, so each centroid meets only the centroids
    of the window before it.
    """
    placed = found.select(
        WINDOW, LOCAL, "centroid", F.dense_rank().over(Window.orderBy(WINDOW)).alias("seq")
    )
    before = placed.select(
        (F.col("seq") + 1).alias("seq"),
        F.col(WINDOW).alias("prev_window"),
        F.col(LOCAL).alias("prev_local"),
        F.col("centroid").alias("_prev"),
    )
    scored = placed.join(before, "seq").withColumn(
        "similarity", vectors.cosine(F.col("centroid"), F.col("_prev"))
    )
    best = Window.partitionBy(WINDOW, LOCAL).orderBy(F.desc("similarity"), F.col("prev_local"))
    return (
        scored.withColumn("_rank", F.row_number().over(best))
        .where(F.col("_rank") == 1)
        .select(WINDOW, LOCAL, "prev_window", "prev_local", "similarity")
    )


def link_clusters(found: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``(window, local, global, linked)``.

    A cluster continues its best match in the previous window when they are similar
    enough and no earlier cluster of its window claimed that match; there is no second
    choice. Every other cluster starts a new id, numbered in window and cluster order.
    Ids then travel along the links by pointer doubling: each round follows twice as
    many links, so the number of rounds is the logarithm of the number of windows.
    """
    found = settle(found.select(WINDOW, LOCAL, "centroid"))
    claim = Window.partitionBy(WINDOW, "prev_local").orderBy(LOCAL)
    links = (
        best_matches(found)
        .where(F.col("similarity") >= threshold)
        .withColumn("_claim", F.row_number().over(claim))
        .where(F.col("_claim") == 1)
        .select(WINDOW, LOCAL, "prev_window", "prev_local")
    )
    nodes = found.select(WINDOW, LOCAL).join(links, [WINDOW, LOCAL], "left")
    is_root = F.col("prev_window").isNull()
    numbering = Window.partitionBy("_root").orderBy(WINDOW, LOCAL)
    # Pointers of a root lead to the root itself; its id is known from the start.
    state = settle(
        nodes.withColumn("_root", is_root)
        .withColumn(GLOBAL, F.when(F.col("_root"), F.row_number().over(numbering) - 1))
        .select(
            WINDOW,
            LOCAL,
            (~F.col("_root")).alias("linked"),
            F.coalesce("prev_window", WINDOW).alias("to_window"),
            F.coalesce("prev_local", LOCAL).alias("to_local"),
        GLOBAL,
        )
    )
    windows = state.select(WINDOW).distinct().count()
    for _ in range(math.ceil(math.log2(max(windows, 2)))):
        target = state.select(
            F.col(WINDOW).alias("to_window"),
            F.col(LOCAL).alias("to_local"),
            F.col("to_window").alias("_next_window"),
            F.col("to_local").alias("_next_local"),
            F.col(GLOBAL).alias("_found"),
        )
        state = settle(
            state.join(target, ["to_window", "to_local"]).select(
                WINDOW,
                LOCAL,
                "linked",
                F.col("_next_window").alias("to_window"),
                F.col("_next_local").alias("to_local"),
                F.coalesce(GLOBAL, "_found").alias(GLOBAL),
            )
        )
    return state.select(WINDOW, LOCAL, F.col(GLOBAL).cast("int").alias(GLOBAL), "linked")
