"""Known cases: their vocabulary, the clusters that match them, lead time, false alarms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nascent.functions import dates
from nascent.functions.rows import explode_once
from nascent.operators.clusters import GLOBAL
from nascent.operators.containment import contained
from nascent.operators.panel import DATE, ID, NARRATIVE
from nascent.operators.topk import top_per_group
from nascent.session import settle

# Words that say nothing about a case.
CASE_STOP_WORDS = ["with", "other", "loan", "consumer"]
MIN_TERM = 4

# The two registered cases.
DEFAULT_CASES = (
    {
        "name": "buy-now-pay-later",
        "product": "Buy Now, Pay Later (BNPL)",
        "sub_issue": None,
        "recognition_date": "2022-03-01",
        "recognition_basis": "CFPB BNPL market inquiry announced Dec 2021; "
        "first CFPB BNPL report Sep 2022",
    },
    {
        "name": "earned-wage-access",
        "product": "Earned Wage Access",
        "sub_issue": None,
        "recognition_date": "2023-06-01",
        "recognition_basis": "CFPB EWA product-specific guidance activity in 2023",
    },
)


def case_terms(cases: DataFrame) -> DataFrame:
    """Add ``terms``: the distinct longer words of product and sub-issue, sorted."""
    words = F.split(
        F.lower(F.concat_ws(" ", F.coalesce("product", F.lit("")), F.coalesce("sub_issue", F.lit("")))),
        "[^a-z]+",
    )
    longer = F.filter(words, lambda w: F.length(w) >= MIN_TERM)
    stops = F.array(*[F.lit(w) for w in CASE_STOP_WORDS])
    return cases.withColumn("terms", F.array_sort(F.array_except(F.array_distinct(longer), stops)))


def cluster_narratives(
    assigned: DataFrame, panel: DataFrame, n: int | None, cluster: str = GLOBAL
) -> DataFrame:
    """``(cluster, id, narrative, place)``: the first ``n`` narratives by date and id.

    ``n=None`` gives every narrative, unranked.
    """
    joined = assigned.select(ID, cluster).join(
        panel.select(ID, DATE, NARRATIVE).where(F.col(NARRATIVE).isNotNull()), ID
    )
    if n is None:
        return joined.select(cluster, ID, NARRATIVE)
    # Narratives stay out of the ranking shuffle; only the winners fetch theirs.
    slim = assigned.select(ID, cluster).join(
        panel.where(F.col(NARRATIVE).isNotNull()).select(ID, DATE), ID
    )
    first = top_per_group(slim, [cluster], [F.col(DATE), F.col(ID)], n, spread=ID, rank="place")
    return first.drop(DATE).join(panel.select(ID, NARRATIVE), ID).select(cluster, ID, NARRATIVE, "place")


def match_cases(
    cases: DataFrame,
    ranked: DataFrame,
    narratives: DataFrame,
    alerts_only: bool = False,
    cluster: str = GLOBAL,
) -> DataFrame:
    """``(name, n_terms, matched, matched_cluster, hits)`` per case.

    A cluster matches when at least half of the case's terms (rounded down, at least
    one) occur in its narratives, also inside longer words; the best-ranked matching
    cluster wins. A term is all letters, so it can only occur inside a run of letters:
    the distinct runs and the terms meet by their four-letter pieces (see
    :mod:`nascent.operators.containment`), instead of testing every term against every text.
    """
    known = case_terms(cases).select("name", "terms")
    probes = known.select("name", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))
    runs = explode_once(
        narratives,
        [cluster],
        F.array_distinct(
            F.regexp_extract_all(F.lower(NARRATIVE), F.lit(f"[a-z]{{{MIN_TERM},}}"), F.lit(0))
        ),
        "run",
    ).distinct()
    runs = settle(runs)
    # Every distinct run is looked at once, however many clusters it occurs in.
    pieces = contained(runs.select("run").distinct(), "run", F.col("run"), probes, "term")
    pieces = pieces.withColumnRenamed("pattern", "term")
    pieces = runs.join(pieces, "run").select(cluster, "term").distinct()
    hits = (
        probes.join(pieces, "term")
        .groupBy("name", "n_terms", cluster)
        .agg(F.count("*").alias("hits"))
        .where(F.col("hits") >= F.greatest(F.lit(1), F.expr("n_terms div 2")))
    )
    order = ranked.where("alert") if alerts_only else ranked
    best = (
        hits.join(order.select(cluster, "rank"), cluster)
        .groupBy("name")
        .agg(
            F.min_by(cluster, "rank").alias("matched_cluster"),
            F.min_by("hits", "rank").alias("hits"),
        )
    )
    return known.select("name", F.size("terms").alias("n_terms")).join(best, "name", "left").select(
        "name",
        "n_terms",
        F.col("matched_cluster").isNotNull().alias("matched"),
        "matched_cluster",
        "hits",
    )


def lead_times(cases: DataFrame, matches: DataFrame, ranked: DataFrame, cluster: str = GLOBAL) -> DataFrame:
    """One result row per case.

    The lead is counted in months from the matched cluster's own first window to the
    recognition date; positive means early.
    """
    firsts = ranked.select(F.col(cluster).alias("matched_cluster"), "first_window")
    joined = (
        cases.select("name", "recognition_date", "recognition_basis")
        .join(matches.select("name", "matched", "matched_cluster"), "name")
        .join(firsts, "matched_cluster", "left")
    )
    lead = dates.month_index(F.col("recognition_date")) - dates.month_index(F.col("first_window"))
    return joined.select(
        "name",
        F.col("recognition_date").cast("string").alias("recognition_date"),
        "recognition_basis",
        "matched",
        F.col("first_window").alias("first_alert_window"),
        lead.cast("double").alias("lead_time_months"),
        "matched_cluster",
        F.when(F.col("matched"), "").otherwise("no flagged cluster matched case vocabulary").alias("notes"),
    )


def false_alarm_rate(
    ranked: DataFrame, labels: DataFrame, cases: DataFrame, cluster: str = GLOBAL
) -> DataFrame:
    """One row: alerts whose top terms share no word with any case's vocabulary."""
    vocabulary = case_terms(cases).select(F.explode("terms").alias("term")).distinct()
    explained = labels.join(vocabulary, "term", "left_semi").select(cluster).distinct()
    flagged = ranked.where("alert").select(cluster)
    marked = flagged.join(explained.withColumn("_known", F.lit(1)), cluster, "left")
    return marked.agg(
        F.count("*").alias("alerts_total"),
        F.count(F.when(F.col("_known").isNull(), 1)).alias("candidate_false_alarms"),
        F.round(
            F.count(F.when(F.col("_known").isNull(), 1)) / F.greatest(F.count("*"), F.lit(1)), 3
        ).alias("rate"),
    )


def default_cases(spark) -> DataFrame:
    return spark.createDataFrame(
        [tuple(case.values()) for case in DEFAULT_CASES],
        "name string, product string, sub_issue string, recognition_date string, recognition_basis string",
    )


__all__ = [
    "DEFAULT_CASES",
    "case_terms",
    "cluster_narratives",
    "default_cases",
    "false_alarm_rate",
    "lead_times",
    "match_cases",
]
