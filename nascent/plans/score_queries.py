"""Scores, alerts, cases and the report, over the trajectories of the clustered vectors.

The reconstruction used here is each cluster's own mean, so that SQL can follow; the
trained sequence model goes through the same functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from nascent.operators import casework, clusters, quality, report, scoring, terms, trajectory
from nascent.operators.panel import ID, NARRATIVE
from nascent.plans import cluster_queries, views
from nascent.plans.registry import r6, register
from nascent.plans.text_queries import quoted
from nascent.plans.views import using
from nascent.session import settle

GLOBAL, LOCAL, WINDOW = clusters.GLOBAL, clusters.LOCAL, cluster_queries.WINDOW
FEATURES = trajectory.FEATURES

_ERRORS = """SELECT t.global_cluster, t.first_window, max(t.length) AS length, avg((centroid_shift - m0) ** 2) AS e0,
  avg((volume - m1) ** 2) AS e1, avg((volume_share - m2) ** 2) AS e2, avg((mean_dist - m3) ** 2) AS e3
FROM {traj} t JOIN (SELECT global_cluster, avg(centroid_shift) AS m0, avg(volume) AS m1, avg(volume_share) AS m2,
  avg(mean_dist) AS m3 FROM {traj} GROUP BY 1) m ON t.global_cluster = m.global_cluster GROUP BY 1, 2"""
views.define("raw_errors", ["traj"], _ERRORS.format(traj="traj"))
views.define("errors", ["raw_errors"], "SELECT *, (e0 + e1 + e2 + e3) / 4 AS error FROM raw_errors")
views.define(
    "threshold",
    ["errors", "settled"],
    """SELECT quantile_cont(error, 0.95) * 1.05 AS threshold, count(*) AS n_training
FROM errors WHERE global_cluster IN (SELECT global_cluster FROM settled)""",
)
views.define(
    "ranked",
    ["errors", "threshold"],
    """SELECT CAST(row_number() OVER (ORDER BY error DESC, global_cluster) AS INTEGER) AS rank, errors.*,
  error > (SELECT threshold FROM threshold) AS alert FROM errors""",
)


def _errors(spark, sf_dir):
    built = settle(cluster_queries.trajectories(spark, sf_dir))
    errors = settle(scoring.reconstruction_errors(built, scoring.mean_reconstruction(built)))
    return built, errors


def _training(built, errors):
    return errors.join(trajectory.settled_clusters(built).select(GLOBAL), GLOBAL, "left_semi")


def _ranked(spark, sf_dir):
    built, errors = _errors(spark, sf_dir)
    return settle(scoring.rank_clusters(errors, scoring.choose_threshold(_training(built, errors))))


@register(
    "reconstruction_errors",
    using(
        "errors",
        select="""SELECT global_cluster, first_window, length, round(e0, 6) AS centroid_shift_error, round(e1, 6) AS volume_error,
  round(e2, 6) AS volume_share_error, round(e3, 6) AS mean_dist_error, round(error, 6) AS error FROM errors""",
    ),
)
def reconstruction_errors(spark, sf_dir):
    _, errors = _errors(spark, sf_dir)
    return errors.select(
        GLOBAL, "first_window", "length", *[r6(f"{f}_error").alias(f"{f}_error") for f in FEATURES], r6("error").alias("error")
    )


@register(
    "threshold",
    using("threshold", select="SELECT round(threshold, 6) AS threshold, n_training FROM threshold"),
)
def threshold(spark, sf_dir):
    built, errors = _errors(spark, sf_dir)
    return scoring.choose_threshold(_training(built, errors)).select(r6("threshold").alias("threshold"), "n_training")


@register(
    "ranked_clusters",
    using(
        "ranked",
        select="""SELECT rank, global_cluster, first_window, round(error, 6) AS error, round(e0, 6) AS centroid_shift, round(e1, 6) AS volume,
  round(e2, 6) AS volume_share, round(e3, 6) AS mean_dist, alert FROM ranked""",
    ),
)
def ranked_clusters(spark, sf_dir):
    return _ranked(spark, sf_dir).select(
        "rank", GLOBAL, "first_window", r6("error").alias("error"), "per_feature.*", "alert"
    )


@register(
    "alerts",
    using(
        "ranked",
        select=" UNION ALL ".join(
            f"""SELECT global_cluster, first_window, round(error, 6) AS error, '{f}' AS feature, round(e{i}, 6) AS value
FROM ranked WHERE alert"""
            for i, f in enumerate(FEATURES)
        ),
    ),
)
def alerts(spark, sf_dir):
    flagged = scoring.alerts(_ranked(spark, sf_dir))
    return flagged.select(
        GLOBAL, "first_window", r6("error").alias("error"), F.explode("per_feature").alias("feature", "value")
    )


@register(
    "error_gap",
    using(
        "ranked",
        select="""SELECT CAST(sum(CAST(alert AS INTEGER)) AS BIGINT) AS flagged, CAST(sum(CAST(NOT alert AS INTEGER)) AS BIGINT) AS normal,
  round(avg(error) FILTER (alert), 6) AS flagged_error, round(avg(error) FILTER (NOT alert), 6) AS normal_error,
  round(avg(error) FILTER (alert) / avg(error) FILTER (NOT alert), 4) AS error_ratio FROM ranked""",
    ),
)
def error_gap(spark, sf_dir):
    gap = quality.error_gap(_ranked(spark, sf_dir))
    return gap.select(
        "flagged",
        "normal",
        r6("flagged_error").alias("flagged_error"),
        r6("normal_error").alias("normal_error"),
        F.round("error_ratio", 4).alias("error_ratio"),
    )


_QUANTILES, _MARGINS, _LINKS, _SPANS = [0.8, 0.9, 0.95], [0.0, 0.05, 0.1], [0.3, 0.5], [1, 3]


def _sweep_sql() -> str:
    names = [
        "clustered", "coords", "cents", "seqd", "best_links", "links", "roots", "chain", "linked", "traj",
        "raw_errors", "errors", "settled",
    ]
    ctes, parts = [], []
    for a, link in enumerate(_LINKS):
        for b, span in enumerate(_SPANS):
            tag = f"_{a}{b}"
            for name in names:
                sql = views.SQL[name]
                if name == "clustered":
                    sql = sql.replace("(vec_id % 12 + 1", f"(vec_id % 12 // {span} * {span} + 1")
                if name == "links":
                    sql = sql.replace("sim >= 0.5", f"sim >= {link}")
                for other in sorted(names, key=len, reverse=True):
                    for lead in ("FROM ", "JOIN "):
                        for tail in (" ", ")", "\n"):
                            sql = (sql + "\n").replace(f"{lead}{other}{tail}", f"{lead}{other}{tag}{tail}").rstrip("\n")
                ctes.append(f"{name}{tag} AS ({sql})")
            for q in _QUANTILES:
                for m in _MARGINS:
                    cut = (
                        f"(SELECT (1 + {m}) * quantile_cont(error, {q}) FROM errors{tag} "
                        f"WHERE global_cluster IN (SELECT global_cluster FROM settled{tag}))"
                    )
                    parts.append(
                        f"SELECT {link}::DOUBLE AS link_threshold, {span} AS window_months, {q}::DOUBLE AS quantile, "
                        f"{m}::DOUBLE AS margin, round({cut}, 6) AS threshold, "
                        f"(SELECT count(*) FROM errors{tag} WHERE error > {cut}) AS alerts"
                    )
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + "\nUNION ALL ".join(parts)


@register("sensitivity_sweep", _sweep_sql())
def sensitivity_sweep(spark, sf_dir):
    """Window length x link threshold x quantile x margin.

    The first two change the trajectories, so each of their pairs is one run; the other
    two are compared in one pass over its errors.
    """
    from nascent.operators import linking

    points = views.clustered(spark, sf_dir)
    month = F.substring(WINDOW, 6, 2).cast("int") - 1
    runs = []
    for span in _SPANS:
        start = (F.expr(f"{span}") * F.floor(month / span) + 1).cast("string")
        spanned = points.withColumn(WINDOW, F.concat(F.lit("2024-"), F.lpad(start, 2, "0")))
        found = settle(clusters.centroids(spanned))
        for link in _LINKS:
            built = settle(trajectory.build_trajectories(spanned, linking.link_clusters(found, link)))
            errors = settle(scoring.reconstruction_errors(built, scoring.mean_reconstruction(built)))
            swept = scoring.sensitivity_sweep(errors, _training(built, errors), _QUANTILES, _MARGINS)
            runs.append(
                swept.select(
                    F.lit(link).alias("link_threshold"),
                    F.lit(span).alias("window_months"),
                    "quantile",
                    "margin",
                    r6("threshold").alias("threshold"),
                    "alerts",
                )
            )
    return reduce(lambda a, b: a.unionByName(b), runs)


# --- cases --------------------------------------------------------------------------------------
_STOPS = quoted(casework.CASE_STOP_WORDS)
views.define(
    "case_words",
    ["cases"],
    f"""SELECT name, term FROM (SELECT DISTINCT name, unnest(regexp_extract_all(lower(product), '[a-z]+')) AS term FROM cases)
WHERE length(term) >= 4 AND term NOT IN ({_STOPS})""",
)
views.define(
    "members",
    ["clustered_texts", "linked", "panel"],
    """SELECT global_cluster, complaint_id, consumer_complaint_narrative,
  row_number() OVER (PARTITION BY global_cluster ORDER BY date_received, complaint_id) AS place
FROM clustered_texts JOIN linked USING (window_id, local_cluster) JOIN (SELECT complaint_id, date_received, consumer_complaint_narrative FROM panel)
  USING (complaint_id)""",
)


def _match_sql(limit: str) -> str:
    return f"""SELECT name, n_terms, arg_min(global_cluster, rank) AS matched_cluster, arg_min(hits, rank) AS hits FROM (
  SELECT name, n_terms, rank, r.global_cluster, count(*) AS hits
  FROM (SELECT name, term, count(*) OVER (PARTITION BY name) AS n_terms FROM case_words) w
    JOIN (SELECT global_cluster, string_agg(lower(consumer_complaint_narrative), ' ') AS joined FROM members {limit} GROUP BY 1) t
      ON contains(joined, term) JOIN ranked r ON r.global_cluster = t.global_cluster GROUP BY 1, 2, 3, 4)
WHERE hits >= greatest(1, n_terms // 2) GROUP BY 1, 2"""


views.define("matched", ["case_words", "members", "ranked"], _match_sql(""))
_MATCH_OUT = """SELECT c.name, CAST(n_terms AS INTEGER) AS n_terms, matched_cluster IS NOT NULL AS matched, matched_cluster, hits
FROM (SELECT name, count(*) AS n_terms FROM case_words GROUP BY 1) c LEFT JOIN (SELECT name, matched_cluster, hits FROM {m}) m
  ON m.name = c.name"""


def _assigned(spark, sf_dir):
    """All documents with their global cluster."""
    links = cluster_queries._links(spark, sf_dir)
    slim = views.clustered_texts(spark, sf_dir).select(ID, WINDOW, LOCAL)
    return slim.join(links.select(WINDOW, LOCAL, GLOBAL), [WINDOW, LOCAL]).select(ID, WINDOW, LOCAL, GLOBAL)


def _matches(spark, sf_dir, n, ranked=None):
    ranked = ranked if ranked is not None else _ranked(spark, sf_dir)
    narratives = casework.cluster_narratives(_assigned(spark, sf_dir), views.panel(spark, sf_dir, spread=True), n)
    return casework.match_cases(views.cases(spark, sf_dir), ranked, narratives)


@register(
    "case_terms",
    using("case_words", select="SELECT name, string_agg(term, ' ' ORDER BY term) AS terms FROM case_words GROUP BY 1"),
)
def case_terms(spark, sf_dir):
    return casework.case_terms(views.cases(spark, sf_dir)).select("name", F.array_join("terms", " ").alias("terms"))


@register("case_match", using("matched", "case_words", select=_MATCH_OUT.format(m="matched")))
def case_match(spark, sf_dir):
    return _matches(spark, sf_dir, None)


@register("case_match_all_members", using("matched", "case_words", select=_MATCH_OUT.format(m="matched")))
def case_match_all_members(spark, sf_dir):
    return _matches(spark, sf_dir, None)


@register(
    "lead_time",
    using(
        "matched",
        "cases",
        "ranked",
        select="""SELECT name, recognition_date, recognition_basis, matched_cluster IS NOT NULL AS matched, first_window AS first_alert_window,
  CAST(CAST(substr(recognition_date, 1, 4) AS INTEGER) * 12 + CAST(substr(recognition_date, 6, 2) AS INTEGER)
    - CAST(substr(first_window, 1, 4) AS INTEGER) * 12 - CAST(substr(first_window, 6, 2) AS INTEGER) AS DOUBLE) AS lead_time_months,
  matched_cluster, CASE WHEN matched_cluster IS NULL THEN 'no flagged cluster matched case vocabulary' ELSE '' END AS notes
FROM cases LEFT JOIN matched USING (name) LEFT JOIN ranked ON global_cluster = matched_cluster""",
    ),
)
def lead_time(spark, sf_dir):
    ranked = _ranked(spark, sf_dir)
    return casework.lead_times(views.cases(spark, sf_dir), _matches(spark, sf_dir, None, ranked), ranked)


@register(
    "precision_at_k",
    using(
        "matched",
        "ranked",
        select="""SELECT count(*) AS ranked, count(*) FILTER (global_cluster IN (SELECT matched_cluster FROM matched)) AS hits,
  count(*) FILTER (global_cluster IN (SELECT matched_cluster FROM matched)) / count(*) AS precision_at_k FROM ranked WHERE rank <= 10""",
    ),
)
def precision_at_k(spark, sf_dir):
    ranked = _ranked(spark, sf_dir)
    relevant = (
        _matches(spark, sf_dir, None, ranked).where("matched").select(F.col("matched_cluster").alias(GLOBAL))
    )
    return quality.precision_at_k(ranked, relevant, GLOBAL, 10)


# --- labels, examples, report --------------------------------------------------------------------------
views.define(
    "member_tf",
    ["members"],
    rf"""SELECT complaint_id, global_cluster AS grp, term, count(*) AS tf FROM (
  SELECT complaint_id, global_cluster, unnest(regexp_extract_all(lower(consumer_complaint_narrative), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term
  FROM members) WHERE term NOT IN ({quoted(terms.ENGLISH_STOP_WORDS)}) GROUP BY 1, 2, 3""",
)
views.define(
    "member_vocab",
    ["member_tf", "members"],
    views.SQL["term_vocab"].replace("term_tf", "member_tf").replace(
        "(SELECT product AS grp, count(*) AS n FROM panel GROUP BY 1)",
        "(SELECT global_cluster AS grp, count(*) AS n FROM members GROUP BY 1)",
    ),
)
views.define(
    "member_scores",
    ["member_tf", "member_vocab"],
    views.SQL["term_scores"].replace("term_tf", "member_tf").replace("term_vocab", "member_vocab"),
)
views.define("member_terms", ["member_scores"], views.SQL["label_terms"].replace("term_scores", "member_scores"))


def _labels(spark, sf_dir):
    docs = _assigned(spark, sf_dir).select(ID, GLOBAL).join(
        views.panel(spark, sf_dir, spread=True).select(ID, NARRATIVE), ID
    )
    return terms.top_terms(docs, GLOBAL, F.col(NARRATIVE))


@register(
    "false_alarm",
    using(
        "ranked",
        "member_terms",
        "case_words",
        select="""SELECT count(*) AS alerts_total, count(*) FILTER (NOT known) AS candidate_false_alarms,
  round(count(*) FILTER (NOT known) / greatest(count(*), 1), 3) AS rate
FROM (SELECT global_cluster IN (SELECT grp FROM member_terms WHERE term IN (SELECT term FROM case_words)) AS known FROM ranked WHERE alert)""",
    ),
)
def false_alarm(spark, sf_dir):
    return casework.false_alarm_rate(_ranked(spark, sf_dir), _labels(spark, sf_dir), views.cases(spark, sf_dir))


@register(
    "cluster_examples",
    using(
        "members",
        select="""SELECT global_cluster, complaint_id, consumer_complaint_narrative, CAST(place AS INTEGER) AS place
FROM members WHERE place <= 5""",
    ),
)
def cluster_examples(spark, sf_dir):
    return casework.cluster_narratives(_assigned(spark, sf_dir), views.panel(spark, sf_dir, spread=True), 5)


@register(
    "report_table",
    using(
        "ranked",
        "member_terms",
        "members",
        select="""SELECT rank, ranked.global_cluster, first_window, round(error, 6) AS error, alert, round(e0, 6) AS centroid_shift,
  coalesce(label, '(no narratives available)') AS label, coalesce(examples, '') AS examples
FROM ranked LEFT JOIN (SELECT grp, string_agg(term, ', ' ORDER BY rank) AS label FROM member_terms GROUP BY 1) l ON grp = ranked.global_cluster
LEFT JOIN (SELECT global_cluster, string_agg(CASE WHEN length(consumer_complaint_narrative) > 600
      THEN substr(consumer_complaint_narrative, 1, 600) || '...' ELSE consumer_complaint_narrative END, ' | ' ORDER BY place) AS examples
  FROM members WHERE place <= 5 GROUP BY 1) x ON x.global_cluster = ranked.global_cluster""",
    ),
)
def report_table(spark, sf_dir):
    examples = casework.cluster_narratives(_assigned(spark, sf_dir), views.panel(spark, sf_dir, spread=True), 5)
    table = report.report_table(_ranked(spark, sf_dir), _labels(spark, sf_dir), examples)
    return table.select(
        "rank",
        GLOBAL,
        "first_window",
        r6("error").alias("error"),
        "alert",
        F.col("per_feature.centroid_shift").alias("centroid_shift"),
        "label",
        F.array_join("examples", " | ").alias("examples"),
    )

