"""Dashboard tables and live novelty, in batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from nascent.operators import dashboard, novelty
from nascent.operators.panel import ID, NARRATIVE, WINDOW
from nascent.plans import text_queries, views  # noqa: F401  (defines shared views)
from nascent.plans.registry import register
from nascent.plans.views import quoted, using
from nascent.session import settle

# The first two vector entries play the two principal components here, so that SQL can
# follow; ``pca_2d`` runs the fitted projection.
views.define(
    "board_clusters",
    ["labelled", "keyword_terms"],
    f"""SELECT CAST(row_number() OVER (ORDER BY n DESC, label) - 1 AS INTEGER) AS id, label, n,
  coalesce(keywords, [{quoted(dashboard.DEFAULT_KEYWORDS)}]) AS keywords
FROM (SELECT label, count(*) AS n FROM labelled GROUP BY 1)
LEFT JOIN (SELECT grp AS label, list(term ORDER BY rank) AS keywords FROM keyword_terms WHERE rank <= 4 GROUP BY 1) USING (label)""",
)
views.define(
    "placed",
    ["labelled", "clustered_texts", "board_clusters"],
    """SELECT p.*, c.id AS cluster_id, round(v.vector[1], 3) AS pca_x, round(v.vector[2], 3) AS pca_y,
  round(round(v.vector[1], 3) * 1.1 + sin(round(v.vector[2], 3) * 2.5) * 0.25, 3) AS x,
  round(round(v.vector[2], 3) * 1.1 + cos(round(v.vector[1], 3) * 2.5) * 0.25, 3) AS y
FROM labelled p JOIN board_clusters c ON c.label = p.label JOIN (SELECT complaint_id, vector FROM clustered_texts) v
  ON v.complaint_id = p.complaint_id""",
)
views.define(
    "points",
    ["placed"],
    """SELECT *, round(0.99 - d / CASE WHEN far > 0 THEN far ELSE 1 END * 0.28, 3) AS confidence FROM (
  SELECT *, max(d) OVER (PARTITION BY cluster_id) AS far FROM (
    SELECT *, sqrt((x - cx) ** 2 + (y - cy) ** 2) AS d FROM (
      SELECT *, avg(x) OVER (PARTITION BY cluster_id) AS cx, avg(y) OVER (PARTITION BY cluster_id) AS cy FROM placed)))""",
)
views.define(
    "point_rows",
    ["points"],
    """SELECT CAST(complaint_id AS VARCHAR) AS id, x, y, pca_x, pca_y, cluster_id, confidence, window_id,
  trim(split_part(product, ',', 1)) || ' Dispute' AS title, issue, sub_issue,
  CASE WHEN length(t) > 280 THEN substr(t, 1, 280) || '...' ELSE t END AS snippet, t AS full_snippet,
  narrative_word_count AS word_count, CAST(date_received AS VARCHAR) AS timestamp
FROM (SELECT *, regexp_replace(consumer_complaint_narrative, 'X{2,}', '[Redacted]', 'g') AS t FROM points)""",
)


def _clusters(spark, sf_dir):
    labelled = dashboard.labelled_by_product(views.panel(spark, sf_dir, spread=True))
    return dashboard.cluster_table(labelled)


def _points(spark, sf_dir):
    labelled = dashboard.labelled_by_product(views.panel(spark, sf_dir))
    ids = dashboard.renumber_by_size(labelled, "label", "id")
    flat = views.clustered_texts(spark, sf_dir).select(
        ID,
        F.round(F.get("vector", F.lit(0)), 3).alias("pca_x"),
        F.round(F.get("vector", F.lit(1)), 3).alias("pca_y"),
    )
    return dashboard.points_table(labelled, flat, ids)


def _flat(points):
    return points.select(
        "id", "x", "y", "pca_x", "pca_y", "cluster_id", "confidence", WINDOW, "metadata.*"
    )


@register("dashboard_points", using("point_rows", select="SELECT * FROM point_rows"))
def dashboard_points(spark, sf_dir):
    return _flat(_points(spark, sf_dir))


@register(
    "dashboard_clusters",
    using(
        "board_clusters",
        select=f"""SELECT id, label, [{quoted(dashboard.PALETTE)}][1 + id % {len(dashboard.PALETTE)}] AS color, n AS count,
  array_to_string(keywords, ', ') AS keywords FROM board_clusters""",
    ),
)
def dashboard_clusters(spark, sf_dir):
    return _clusters(spark, sf_dir).withColumn("keywords", F.array_join("keywords", ", "))


@register(
    "point_filter",
    using(
        "point_rows",
        select="""SELECT id, cluster_id, title FROM point_rows WHERE cluster_id IN (0, 1, 2, 3, 4, 5)
  AND (contains(lower(title), 'tion') OR contains(lower(snippet), 'tion') OR contains(lower(issue), 'tion') OR contains(lower(sub_issue), 'tion'))
  AND id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE quality = 1)""",
    ),
)
def point_filter(spark, sf_dir):
    wanted = (
        views.table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("id"))
    )
    kept = dashboard.filter_points(_points(spark, sf_dir), [0, 1, 2, 3, 4, 5], wanted, " Tion ")
    return kept.select("id", "cluster_id", F.col("metadata.title").alias("title"))


@register(
    "box_select",
    using("point_rows", select="SELECT id FROM point_rows WHERE pca_x BETWEEN -0.1 AND 0.2 AND pca_y BETWEEN -0.15 AND 0.1"),
)
def box_select(spark, sf_dir):
    return dashboard.select_box(_points(spark, sf_dir), "pca_x", "pca_y", (-0.1, 0.2), (-0.15, 0.1))


@register(
    "cluster_search",
    using(
        "board_clusters",
        select="""SELECT id, label FROM board_clusters WHERE contains(lower(label), 'loan')
  OR len(list_filter(keywords, lambda k: contains(lower(k), 'loan'))) > 0""",
    ),
)
def cluster_search(spark, sf_dir):
    return dashboard.search_clusters(_clusters(spark, sf_dir), "Loan").select("id", "label")


@register(
    "distribution",
    using(
        "board_clusters",
        select="SELECT label, n AS count, array_to_string(keywords, ', ') AS keywords FROM board_clusters ORDER BY n, label",
    ),
)
def distribution(spark, sf_dir):
    return dashboard.distribution(_clusters(spark, sf_dir)).withColumn(
        "keywords", F.array_join("keywords", ", ")
    )


@register(
    "scatter_series",
    using("point_rows", select="SELECT cluster_id, pca_x AS cx, pca_y AS cy, confidence, id FROM point_rows"),
)
def scatter_series(spark, sf_dir):
    return dashboard.scatter_series(_points(spark, sf_dir), "pca")


@register(
    "table_strip",
    using("point_rows", select="SELECT id, title, issue, confidence FROM point_rows ORDER BY id LIMIT 100"),
)
def table_strip(spark, sf_dir):
    return dashboard.first_rows(_points(spark, sf_dir)).select(
        "id", F.col("metadata.title").alias("title"), F.col("metadata.issue").alias("issue"), "confidence"
    )


@register("pca_2d")
def pca_2d(spark, sf_dir):
    placed = dashboard.project_2d(views.clustered(spark, sf_dir))
    x, y = dashboard.harmonic_projection(F.col("pca_x"), F.col("pca_y"))
    return placed.select(ID, "pca_x", "pca_y", x.alias("x"), y.alias("y"))


# --- novelty ---------------------------------------------------------------------------------------
_EMERGING = quoted(novelty.EMERGING_TERMS)
views.define(
    "affinity",
    ["labelled", "board_clusters"],
    r"""SELECT complaint_id, cid, exp(least(8.0, 0.7 * score)) AS w, score, words, tokens FROM (
  SELECT t.complaint_id, c.id AS cid, words, tokens,
    list_sum(list_transform(c.keywords, lambda k: CASE WHEN list_contains(words, lower(k)) THEN 3.0 WHEN contains(low, lower(k)) THEN 1.5 ELSE 0.0 END))
      + CASE WHEN contains(low, lower(c.label)) OR contains(lower(c.label), lower(t.label)) THEN 5.0 ELSE 0.0 END AS score
  FROM (SELECT complaint_id, label, lower(consumer_complaint_narrative) AS low, tokens,
      list_filter(tokens, lambda w: regexp_full_match(w, '[a-zA-Z]{3,}')) AS words
    FROM (SELECT *, regexp_extract_all(lower(consumer_complaint_narrative), '[\p{L}\p{N}_]+') AS tokens FROM labelled)) t, board_clusters c)""",
)
views.define(
    "probable",
    ["affinity"],
    """SELECT *, round(w / sum(w) OVER (PARTITION BY complaint_id), 3) AS p, max(score) OVER (PARTITION BY complaint_id) AS best FROM affinity""",
)


def _novelty_input(spark, sf_dir):
    texts = dashboard.labelled_by_product(views.panel(spark, sf_dir, spread=True)).select(
        ID, NARRATIVE, F.col("label").alias("category")
    )
    return settle(texts), settle(_clusters(spark, sf_dir))


@register(
    "live_novelty",
    using(
        "probable",
        select=f"""SELECT complaint_id, assigned_cluster, probability, novelty_score, novelty_score >= 0.55 AS is_novel,
  floor((least(980, CAST(round(probability * 1000) AS INTEGER) + 450) + 5) / 10) / 100 AS familiar_confidence, spawn_keywords
FROM (SELECT *, CASE WHEN emerging THEN 0.88 WHEN best >= 3 THEN greatest(0.12, round(1 - best / (best + 4), 3)) ELSE 0.65 END AS novelty_score
  FROM (SELECT complaint_id, arg_min(cid, cid - p * 1000000) AS assigned_cluster, max(p) AS probability, CAST(max(best) AS DOUBLE) AS best,
    list_has_any(any_value(tokens), [{_EMERGING}]) AS emerging,
    array_to_string(CASE WHEN len(list_filter(any_value(words), lambda w: length(w) > 4 AND NOT list_contains([{quoted(novelty.SPAWN_STOP_WORDS)}], w))) > 0
      THEN list_filter(any_value(words), lambda w: length(w) > 4 AND NOT list_contains([{quoted(novelty.SPAWN_STOP_WORDS)}], w))[1:4]
      ELSE [{quoted(novelty.SPAWN_KEYWORDS)}] END, ' ') AS spawn_keywords
  FROM probable GROUP BY 1))""",
    ),
)
def live_novelty(spark, sf_dir):
    return novelty.score_novelty(*_novelty_input(spark, sf_dir)).select(
        ID,
        "assigned_cluster",
        "probability",
        "novelty_score",
        "is_novel",
        "familiar_confidence",
        F.array_join("spawn_keywords", " ").alias("spawn_keywords"),
    )


@register(
    "top3_assignments",
    using(
        "probable",
        select="""SELECT complaint_id, CAST(place AS INTEGER) AS place, cid AS cluster, p AS probability FROM (
  SELECT *, row_number() OVER (PARTITION BY complaint_id ORDER BY p DESC, cid) AS place FROM probable) WHERE place <= 3""",
    ),
)
def top3_assignments(spark, sf_dir):
    return novelty.top_assignments(*_novelty_input(spark, sf_dir), 3)
