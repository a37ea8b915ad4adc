"""The whole run: panel, vectors, windows, trajectories, scores, alerts; and its backtest."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nascent.functions import text
from nascent.learning import clustering, sequences
from nascent.operators import casework, encoding, panel, scoring, terms, trajectory
from nascent.operators.clusters import GLOBAL
from nascent.operators.panel import ID, NARRATIVE, WINDOW
from nascent.session import scratch_path, settle
from nascent.sources.raw import standard_columns


@dataclass(frozen=True)
class RunSettings:
    window: str = "M"
    min_words: int = 10
    dim: int = 256
    quantile: float = 0.95
    margin: float = 0.05
    cluster: clustering.ClusterSettings = field(default_factory=clustering.ClusterSettings)
    sequence: sequences.SequenceSettings = field(default_factory=sequences.SequenceSettings)


@dataclass
class RunResult:
    panel: DataFrame
    vectors: DataFrame
    clusters: clustering.WindowClusters
    trajectories: DataFrame
    errors: DataFrame
    threshold: DataFrame
    ranked: DataFrame


def score(trajectories: DataFrame, settings: RunSettings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Errors of all trajectories, the threshold from the settled ones, and the ranking."""
    padded = settle(trajectory.padded_sequences(trajectories))
    settled = settle(trajectory.settled_clusters(trajectories).select(GLOBAL))
    model, weights, _ = sequences.train_sequences(padded.join(settled, GLOBAL, "left_semi"), settings.sequence)
    errors = settle(scoring.sequence_errors(sequences.rebuild(padded, model, weights)))
    training = errors.join(settled, GLOBAL, "left_semi")
    threshold = settle(scoring.choose_threshold(training, settings.quantile, settings.margin))
    return errors, threshold, settle(scoring.rank_clusters(errors, threshold))


def run(raw: DataFrame, settings: RunSettings = RunSettings(), make_encoder=None, states: str | None = None) -> RunResult:
    """Everything from raw complaints to ranked clusters.

    With a folder of ``states``, windows that an earlier run has trained on the same rows, and
    after the same windows, do not train again.

    ``make_encoder`` gives an encoder of one's own; without it texts are hashed.
    """
    complaints = panel.build_panel(standard_columns(raw), settings.window, settings.min_words)
    issue = F.col("issue") if "issue" in complaints.columns else F.lit(None).cast("string")
    has_issue = "issue" in complaints.columns
    encoder_text = text.enrich(issue, F.col(NARRATIVE)) if has_issue else F.col(NARRATIVE)
    if make_encoder is None:
        vectors = encoding.encode_hashed(complaints, encoder_text, settings.dim).select(ID, WINDOW, "vector")
    else:
        prepared = complaints.withColumn("_text", encoder_text)
        vectors = encoding.encode_with(prepared, "_text", make_encoder).join(complaints.select(ID, WINDOW), ID)
    vectors = clustering.by_window(vectors.select(ID, WINDOW, "vector"))
    found = clustering.cluster_windows(vectors, settings.cluster, states)
    assigned = vectors.join(found.assignments.select(ID, WINDOW, "local_cluster"), [ID, WINDOW])
    trajectories = settle(trajectory.build_trajectories(assigned, found.links))
    errors, threshold, ranked = score(trajectories, settings)
    return RunResult(complaints, vectors, found, trajectories, errors, threshold, ranked)


def backtest(
    raw: DataFrame,
    cases: DataFrame,
    settings: RunSettings = RunSettings(),
    examples: int | None = None,
    states: str | None = None,
) -> DataFrame:
    """One row per case. Cases that share a recognition date share a run.

    For each date the input is cut off before anything is computed, so nothing later can
    leak in; only clusters that raised an alert can match. Windows that end before a date are
    the same rows for all later dates, so their trained states are kept in ``states`` and
    serve them all: the dates cost one chain of windows, and each one its own cut window.
    """
    raw = panel.with_dates(standard_columns(raw))
    dates = [r[0] for r in cases.select(F.col("recognition_date").cast("string")).distinct().sort("recognition_date").collect()]
    results, states = [], states or scratch_path(raw.sparkSession, "states")
    for date in dates:
        own = cases.where(F.col("recognition_date").cast("string") == date)
        before = raw.where(F.to_date(F.col(panel.DATE)) < F.to_date(F.lit(date)))
        if panel.build_panel(before, settings.window, settings.min_words).isEmpty():
            results.append(_no_data(own))
            continue
        done = run(before, settings, states=states)
        narratives = casework.cluster_narratives(done.clusters.assignments, done.panel, examples)
        matches = casework.match_cases(own, done.ranked, narratives, alerts_only=True)
        results.append(settle(casework.lead_times(own, matches, done.ranked)))
    return reduce(lambda a, b: a.unionByName(b), results) if results else _no_data(cases.limit(0))


def _no_data(cases: DataFrame) -> DataFrame:
    return cases.select(
        "name",
        F.col("recognition_date").cast("string").alias("recognition_date"),
        "recognition_basis",
        F.lit(False).alias("matched"),
        F.lit(None).cast("string").alias("first_alert_window"),
        F.lit(None).cast("double").alias("lead_time_months"),
        F.lit(None).cast("int").alias("matched_cluster"),
        F.lit("no pre-recognition data after filtering").alias("notes"),
    )


def label_clusters(done: RunResult, k: int = 6) -> DataFrame:
    """TF-IDF terms of every global cluster of a run."""
    docs = done.clusters.assignments.select(ID, GLOBAL).join(done.panel.select(ID, NARRATIVE), ID)
    return terms.top_terms(docs, GLOBAL, F.col(NARRATIVE), k)
