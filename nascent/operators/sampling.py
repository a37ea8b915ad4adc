"""Sampling and splitting by hash order.

Rows are ordered by a hash of (seed, id), so a sample does not depend on how the
data is partitioned. Nothing here sorts a whole group in one task: the cut-off key
of a group is found from a histogram of hash prefixes, and only the one prefix
cell that holds the cut is ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nascent.functions import dates, text
from nascent.functions.hashing import rank_key
from nascent.operators.panel import DATE, ID, NARRATIVE, with_narratives
from nascent.session import attach_small, settle


def cut_keys(
    keyed: DataFrame, groups: list[str], key: str, quota: Column, prefix: int = 4
) -> DataFrame:
    """The largest key each group keeps when it keeps its ``quota`` smallest keys.

    ``quota`` is an expression over the group columns and ``group_rows``, the size
    of the group. Returns ``groups + [cut_key]``; groups that keep nothing are
    absent. Keys must be hexadecimal and unique within a group.
    """
    cells = settle(
        keyed.groupBy(*groups, F.substring(key, 1, prefix).alias("_cell")).agg(
            F.count("*").alias("_n"), F.max(key).alias("_last")
        )
    )
    running = Window.partitionBy(*groups).orderBy("_cell")
    placed = cells.select(
        "*",
        F.sum("_n").over(running).alias("_upto"),
        F.sum("_n").over(Window.partitionBy(*groups)).alias("group_rows"),
    ).withColumn("_quota", F.least(quota.cast("long"), F.col("group_rows")))
    holding = placed.where(
        (F.col("_quota") > F.col("_upto") - F.col("_n")) & (F.col("_quota") <= F.col("_upto"))
    ).withColumn("_need", F.col("_quota") - F.col("_upto") + F.col("_n"))
    # A cell kept to its last row needs no ranking.
    whole = holding.where(F.col("_need") == F.col("_n")).select(*groups, F.col("_last").alias("cut_key"))
    split = holding.where(F.col("_need") < F.col("_n")).select(*groups, "_cell", "_need")
    ranked = attach_small(
        keyed.select(*groups, key).withColumn("_cell", F.substring(key, 1, prefix)),
        split,
        [*groups, "_cell"],
        spread=key,
        null_safe=True,
    ).withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*groups, "_cell").orderBy(key))
    )
    inside = ranked.where(F.col("_rank") == F.col("_need")).select(*groups, F.col(key).alias("cut_key"))
    return whole.unionByName(inside)


def flag_smallest(
    df: DataFrame, groups: list[str], key: str, quota: Column, flag: str, slim: bool = False
) -> DataFrame:
    """Mark the rows that are among the ``quota`` smallest keys of their group.

    Finding the cut reads the groups and keys twice, so these are written out once and
    the wide rows are read only for the result. ``slim`` says that ``df`` is such a
    table already.
    """
    if not groups:
        df, groups, added = df.withColumn("_all", F.lit(1)), ["_all"], ["_all"]
    else:
        added = []
    cuts = cut_keys(df if slim else settle(df.select(*groups, key)), groups, key, quota)
    joined = attach_small(df, cuts, groups, spread=key, how="left", null_safe=True)
    return joined.withColumn(
        flag, F.coalesce(F.col(key) <= F.col("cut_key"), F.lit(False))
    ).drop("cut_key", *added)


def systematic_sample(df: DataFrame, step: int = 10, seed: int = 42, id_column: str = ID) -> DataFrame:
    """About one row in ``step``, chosen by hash; a pure filter on the scan."""
    position = F.conv(F.substring(rank_key(seed, F.col(id_column)), 1, 8), 16, 10).cast("long")
    return df.where(position % step == 0)


def random_sample(
    df: DataFrame, n: int, seed: int = 42, id_column: str = ID, unique_ids: bool = True
) -> DataFrame:
    """Exactly ``min(n, rows)`` rows.

    Where ids repeat, pass ``unique_ids=False``: a hash of the whole row then decides among
    rows of one id, at the price of reading all columns for the cut.
    """
    key = rank_key(seed, F.col(id_column))
    if not unique_ids:
        key = F.concat(key, F.lower(F.lpad(F.hex(F.xxhash64(*df.columns)), 16, "0")))
    keyed = df.withColumn("_key", key)
    return flag_smallest(keyed, [], "_key", F.lit(n), "_in").where("_in").drop("_key", "_in")


def stratified_flags(
    candidates: DataFrame,
    strata: list[str],
    target: int,
    seed: int = 42,
    id_column: str = ID,
) -> DataFrame:
    """``(id, strata..., sampled)``: an exact-size sample spread over ``strata``.

    Works on ids and strata only, written out once; the candidates themselves are read a
    single time. Each stratum first gets the larger of an even share and its proportional share.
    If that is more than the target, a random part of it stays; if it is less, random
    rows from the remainder join.
    """
    # The number of the row decides among rows of one id; it is fixed by being written.
    number = F.lower(F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0"))
    keyed = settle(
        candidates.select(
            id_column, *strata, number.alias("_number"), F.concat(rank_key(seed, F.col(id_column)), number).alias("_key")
        )
    )
    sizes = keyed.groupBy(*strata).agg(F.count("*").alias("n"))
    available, n_groups = sizes.agg(F.sum("n"), F.count("*")).first()
    if not available or available <= target:
        return keyed.drop("_key", "_number").withColumn("sampled", F.lit(True))
    even = max(1, target // n_groups)
    share = F.expr(f"group_rows * {target} div {available}")
    first = flag_smallest(keyed, strata, "_key", F.greatest(F.lit(even), share), "_first", slim=True)
    # Rows of the first pass sort before all others; the target cuts that one order.
    first = settle(
        first.select(
            id_column,
            *strata,
            F.concat(
                F.when(F.col("_first"), "0").otherwise("1"), rank_key(f"{seed}:fill", F.col(id_column)), F.col("_number")
            ).alias("_order"),
        )
    )
    return flag_smallest(first, [], "_order", F.lit(target), "sampled", slim=True).drop("_order")


def sample_raw(
    raw: DataFrame, target: int = 20_000, min_words: int = 10, seed: int = 42, step: int | None = None
) -> DataFrame:
    """Stratified sample of raw complaints over (month, product).

    ``step`` optionally thins the input first. Order by date is left to the sink.
    """
    pool = with_narratives(raw, min_words, strict=True).drop("narrative_word_count")
    if step:
        pool = systematic_sample(pool, step, seed)
    pool = pool.withColumn("_month", dates.window_label(F.col(DATE), "M")).withColumn(
        "_product", text.strip(F.coalesce(F.col("product"), F.lit("Unknown")))
    )
    chosen = settle(stratified_flags(pool, ["_month", "_product"], target, seed).where("sampled").select(ID))
    return pool.join(chosen, ID, "left_semi").drop("_month", "_product")


def complement(df: DataFrame, sample: DataFrame, id_column: str = ID) -> DataFrame:
    """Rows of ``df`` that are not in ``sample``."""
    return df.join(sample.select(id_column), id_column, "left_anti")


def stratified_split(
    df: DataFrame, label: str, test_share: float = 0.2, seed: int = 17, id_column: str = ID
) -> DataFrame:
    """Add ``is_test``: the same share of every class, rounded per class."""
    keyed = df.withColumn("_key", rank_key(seed, F.col(id_column)))
    quota = F.round(F.col("group_rows") * F.lit(test_share))
    return flag_smallest(keyed, [label], "_key", quota, "is_test").drop("_key")


def three_way_split(df: DataFrame, label: str, seed: int = 17, id_column: str = ID) -> DataFrame:
    """Column ``part``: train, validation or test, 64/16/20 per class."""
    outer = stratified_split(df, label, 0.2, seed, id_column)
    rest = stratified_split(
        outer.where(~F.col("is_test")).drop("is_test"), label, 0.2, seed + 1, id_column
    ).withColumn("part", F.when(F.col("is_test"), "validation").otherwise("train"))
    test = outer.where("is_test").withColumn("part", F.lit("test"))
    return rest.drop("is_test").unionByName(test.drop("is_test"))


__all__ = [
    "NARRATIVE",
    "complement",
    "cut_keys",
    "flag_smallest",
    "random_sample",
    "sample_raw",
    "stratified_flags",
    "stratified_split",
    "systematic_sample",
    "three_way_split",
]
