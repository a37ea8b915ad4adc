"""Connected components of a table of links, by alternating large and small stars.

After Kiveris et al. (2014). Large star: every node links its larger neighbours to its
smallest one. Small star: every node links itself and its smaller neighbours to the
smallest of them. The rounds end when the links no longer change; each node then has one
link, to the smallest node of its component. A round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nascent.session import settle


def _state(links: DataFrame) -> tuple:
    hashed = F.xxhash64("hi", "lo").cast("decimal(38,0)")
    return tuple(links.agg(F.count("*"), F.sum(hashed)).first())


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """``(node, component)`` for every node with a link to another; integer ids."""
    high, low = F.greatest(left, right), F.least(left, right)
    current = links.select(high.alias("hi"), low.alias("lo")).where("hi > lo").distinct()
    current = settle(current)
    state = _state(current)
    while True:
        both = current.unionByName(current.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        nearest = both.groupBy("hi").agg(F.min("lo").alias("m"))
        nearest = nearest.select("hi", F.least("hi", "m").alias("m"))
        large = both.join(nearest, "hi").where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        large = large.where("hi > lo").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(least, "hi")
        small = joined.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi > lo")
        current = settle(small.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct())
        before, state = state, _state(current)
        if state == before:
            return current.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        if state[0] == 0:
            return current.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
