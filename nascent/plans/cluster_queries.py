"""Clustered vectors: statistics, assignment, linking, trajectories, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from nascent.operators import clusters, features, linking, quality, trajectory
from nascent.operators.panel import ID, WINDOW
from nascent.plans import views
from nascent.plans.registry import r6, register
from nascent.plans.views import CLUSTERS, using

LOCAL, GLOBAL = clusters.LOCAL, clusters.GLOBAL


@register(
    "cluster_sizes",
    using(
        "clustered",
        select=f"""SELECT window_id, CAST(c AS INTEGER) AS local_cluster, count(complaint_id) AS size
FROM (SELECT DISTINCT window_id, unnest(range(0, {CLUSTERS})) AS c FROM clustered)
LEFT JOIN clustered USING (window_id) WHERE local_cluster = c GROUP BY 1, 2
UNION ALL SELECT window_id, CAST(c AS INTEGER), 0 FROM (SELECT DISTINCT window_id, unnest(range(0, {CLUSTERS})) AS c FROM clustered) s
WHERE NOT EXISTS (SELECT 1 FROM clustered x WHERE x.window_id = s.window_id AND x.local_cluster = s.c)""",
    ),
)
def cluster_sizes(spark, sf_dir):
    return clusters.cluster_sizes(views.clustered(spark, sf_dir), CLUSTERS)


@register(
    "centroids",
    using(
        "coords",
        select="""SELECT window_id, local_cluster, CAST(dim - 1 AS INTEGER) AS dim, count(*) AS members, round(avg(x), 6) AS value
FROM coords GROUP BY 1, 2, 3""",
    ),
)
def centroids(spark, sf_dir):
    found = clusters.full_centroids(views.clustered(spark, sf_dir), CLUSTERS).where("members > 0")
    return found.select(WINDOW, LOCAL, "members", F.posexplode("centroid").alias("dim", "x")).select(
        WINDOW, LOCAL, "dim", "members", r6("x").alias("value")
    )


views.define(
    "soft",
    ["clustered", "cents"],
    """SELECT complaint_id, window_id, label, cluster, w / sum(w) OVER (PARTITION BY complaint_id) AS q FROM (
  SELECT p.complaint_id, p.window_id, p.local_cluster AS label, c.local_cluster AS cluster,
    1 / (1 + list_distance(p.vector, c.centroid) * list_distance(p.vector, c.centroid)) AS w
  FROM clustered p JOIN cents c ON p.window_id = c.window_id)""",
)


def _soft(spark, sf_dir):
    points = views.clustered(spark, sf_dir).withColumnRenamed(LOCAL, "label")
    found = clusters.centroids(views.clustered(spark, sf_dir))
    return clusters.soft_assign(points, found), found


@register(
    "soft_assign",
    using("soft", select="SELECT complaint_id, window_id, cluster, round(q, 6) AS q FROM soft"),
)
def soft_assign(spark, sf_dir):
    soft, found = _soft(spark, sf_dir)
    return _long(soft, found, "q")


def _long(df, found, column):
    """Array position back to the cluster id of the window."""
    ids = found.groupBy(WINDOW).agg(F.sort_array(F.collect_list(LOCAL)).alias("ids"))
    return df.join(ids, WINDOW).select(
        ID, WINDOW, F.posexplode(F.arrays_zip("ids", column)).alias("pos", "z")
    ).select(ID, WINDOW, F.col("z.ids").alias("cluster"), r6(f"z.{column}").alias(column))


@register(
    "target_distribution",
    using(
        "soft",
        select="""SELECT complaint_id, window_id, cluster, round(r / sum(r) OVER (PARTITION BY complaint_id), 6) AS p
FROM (SELECT *, q * q / sum(q) OVER (PARTITION BY window_id, cluster) AS r FROM soft)""",
    ),
)
def target_distribution(spark, sf_dir):
    soft, found = _soft(spark, sf_dir)
    return _long(clusters.target_distribution(soft), found, "p")


views.define(
    "hard",
    ["soft"],
    """SELECT complaint_id, window_id, any_value(label) AS label,
  arg_max(cluster, q) AS local_cluster FROM soft GROUP BY 1, 2""",
)


def _hard(spark, sf_dir):
    soft, found = _soft(spark, sf_dir)
    ids = found.groupBy(WINDOW).agg(F.sort_array(F.collect_list(LOCAL)).alias("ids"))
    placed = clusters.hard_assign(soft)
    return placed.join(ids, WINDOW).select(
        ID, WINDOW, "label", F.get("ids", F.col(LOCAL)).alias(LOCAL)
    )


@register("hard_assign", using("hard", select="SELECT complaint_id, window_id, label, local_cluster FROM hard"))
def hard_assign(spark, sf_dir):
    return _hard(spark, sf_dir)


@register(
    "label_change",
    using(
        "hard",
        select="SELECT count(*) AS n_points, round(avg(CAST(label <> local_cluster AS DOUBLE)), 6) AS label_change FROM hard",
    ),
)
def label_change(spark, sf_dir):
    changed = clusters.label_change(views.clustered(spark, sf_dir), _hard(spark, sf_dir))
    return changed.withColumn("label_change", r6("label_change"))


# --- linking -----------------------------------------------------------------------------
views.define("seqd", ["cents"], "SELECT *, dense_rank() OVER (ORDER BY window_id) AS seq FROM cents")
views.define(
    "best_links",
    ["seqd"],
    """SELECT seq, window_id, local_cluster, prev_local, prev_window, sim FROM (
  SELECT *, row_number() OVER (PARTITION BY seq, local_cluster ORDER BY sim DESC, prev_local) AS rn FROM (
    SELECT a.seq, a.window_id, a.local_cluster, b.local_cluster AS prev_local, b.window_id AS prev_window,
      list_dot_product(a.centroid, b.centroid) / ((sqrt(list_dot_product(a.centroid, a.centroid)) + 1e-12)
        * (sqrt(list_dot_product(b.centroid, b.centroid)) + 1e-12)) AS sim
    FROM seqd a JOIN seqd b ON b.seq = a.seq - 1)) WHERE rn = 1""",
)
views.define(
    "links",
    ["best_links"],
    """SELECT seq, local_cluster, prev_local FROM (SELECT *, row_number() OVER (PARTITION BY seq, prev_local ORDER BY local_cluster) AS cl
  FROM best_links WHERE sim >= 0.5) WHERE cl = 1""",
)
views.define(
    "roots",
    ["seqd", "links"],
    """SELECT seq, local_cluster, row_number() OVER (ORDER BY seq, local_cluster) - 1 AS gid FROM seqd s
WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.seq = s.seq AND l.local_cluster = s.local_cluster)""",
)
views.define(
    "chain",
    ["roots", "links"],
    """SELECT seq, local_cluster, gid, false AS linked FROM roots UNION ALL
SELECT l.seq, l.local_cluster, c.gid, true FROM chain c JOIN links l ON l.seq = c.seq + 1 AND l.prev_local = c.local_cluster""",
)
views.define(
    "linked",
    ["chain", "seqd"],
    """SELECT window_id, local_cluster, CAST(gid AS INTEGER) AS global_cluster, linked FROM chain JOIN seqd USING (seq, local_cluster)""",
)


def _links(spark, sf_dir, threshold=0.5):
    return linking.link_clusters(clusters.centroids(views.clustered(spark, sf_dir)), threshold)


@register(
    "best_matches",
    using(
        "best_links",
        select="SELECT window_id, local_cluster, prev_window, prev_local, round(sim, 6) AS similarity FROM best_links",
    ),
)
def best_matches(spark, sf_dir):
    found = linking.best_matches(clusters.centroids(views.clustered(spark, sf_dir)))
    return found.withColumn("similarity", r6("similarity"))


@register("linked_clusters", using("linked", select="SELECT * FROM linked"))
def linked_clusters(spark, sf_dir):
    return _links(spark, sf_dir)


# --- trajectories --------------------------------------------------------------------------
views.define(
    "traj",
    ["clustered", "cents", "linked"],
    """SELECT global_cluster, window_id, members, CAST(row_number() OVER h AS INTEGER) AS step,
  CAST(count(*) OVER (PARTITION BY global_cluster) AS INTEGER) AS length,
  min(window_id) OVER (PARTITION BY global_cluster) AS first_window,
  coalesce(list_distance(centroid, lag(centroid) OVER h), 0.0) AS centroid_shift,
  ln(1 + members) AS volume, members / sum(members) OVER (PARTITION BY window_id) AS volume_share, mean_dist
FROM cents JOIN linked USING (window_id, local_cluster) JOIN (
  SELECT p.window_id, p.local_cluster, avg(list_distance(p.vector, c.centroid) / greatest(1, sqrt(len(p.vector)))) AS mean_dist
  FROM clustered p JOIN cents c ON p.window_id = c.window_id AND p.local_cluster = c.local_cluster GROUP BY 1, 2)
  USING (window_id, local_cluster)
WINDOW h AS (PARTITION BY global_cluster ORDER BY window_id)""",
)


def trajectories(spark, sf_dir):
    return trajectory.build_trajectories(views.clustered(spark, sf_dir), _links(spark, sf_dir))


@register(
    "trajectories",
    using(
        "traj",
        select="""SELECT global_cluster, window_id, members, step, length, first_window, round(centroid_shift, 6) AS centroid_shift,
  round(volume, 6) AS volume, round(volume_share, 6) AS volume_share, round(mean_dist, 6) AS mean_dist FROM traj""",
    ),
)
def rounded_trajectories(spark, sf_dir):
    built = trajectories(spark, sf_dir)
    return built.select(
        GLOBAL, WINDOW, "members", "step", "length", "first_window", *[r6(f).alias(f) for f in trajectory.FEATURES]
    )


@register(
    "padded_sequences",
    using(
        "traj",
        select="""SELECT global_cluster, CAST(pos AS INTEGER) AS pos, round(centroid_shift, 6) AS centroid_shift, round(volume, 6) AS volume,
  round(volume_share, 6) AS volume_share, round(mean_dist, 6) AS mean_dist FROM (
  SELECT *, step + greatest(3 - length, 0) - 1 AS pos FROM traj
  UNION ALL SELECT *, unnest(range(0, 3 - length)) AS pos FROM traj WHERE step = 1 AND length < 3)""",
    ),
)
def padded_sequences(spark, sf_dir):
    padded = trajectory.padded_sequences(trajectories(spark, sf_dir))
    return padded.select(GLOBAL, F.posexplode("sequence").alias("pos", "x")).select(
        GLOBAL, "pos", *[r6(F.get("x", F.lit(i))).alias(f) for i, f in enumerate(trajectory.FEATURES)]
    )


views.define(
    "settled",
    ["traj"],
    """SELECT global_cluster, length FROM (SELECT global_cluster, max(length) AS length,
  sum(CAST(max(length) >= 3 AS INTEGER)) OVER () AS s, row_number() OVER (ORDER BY global_cluster) AS place, count(*) OVER () AS n
  FROM traj GROUP BY 1) WHERE CASE WHEN s > 0 THEN length >= 3 ELSE place <= greatest(1, n // 2) END""",
)


@register("settled", using("settled", select="SELECT * FROM settled"))
def settled(spark, sf_dir):
    return trajectory.settled_clusters(trajectories(spark, sf_dir))


# --- vector features --------------------------------------------------------------------------
@register(
    "sequence_fold",
    using(
        "coords",
        select="""SELECT complaint_id, CAST(64 + pos AS INTEGER) AS pos, round(avg(x), 6) AS value FROM (
  SELECT complaint_id, (dim - 1) % 8 AS pos, x FROM coords) GROUP BY 1, 2
UNION ALL SELECT complaint_id, CAST(72 + (dim - 1) % 8 AS INTEGER), round(max(x), 6) FROM coords GROUP BY 1, 2
UNION ALL SELECT complaint_id, CAST(dim - 1 AS INTEGER), round(x, 6) FROM coords""",
    ),
)
def sequence_fold(spark, sf_dir):
    fused = features.sequence_fold_features(views.clustered(spark, sf_dir), steps=8)
    return fused.select(ID, F.posexplode("fused").alias("pos", "x")).select(
        ID, "pos", r6("x").alias("value")
    )


@register(
    "filter_features",
    using(
        "coords",
        select="""SELECT complaint_id, CAST(k * 16 + cell AS INTEGER) AS pos, round(v, 6) AS value FROM cells
UNION ALL SELECT complaint_id, CAST(48 + k AS INTEGER), round(avg(v), 6) FROM cells GROUP BY 1, k, 2
UNION ALL SELECT complaint_id, CAST(51 + k AS INTEGER), round(max(v), 6) FROM cells GROUP BY 1, k, 2""",
    ).replace(
        "\nSELECT complaint_id, CAST(k",
        """,
smooth AS (SELECT k, a.complaint_id, a.dim - 1 AS i, sum(b.x) / (2 * k + 3) AS s
  FROM coords a JOIN coords b ON a.complaint_id = b.complaint_id JOIN (SELECT unnest([0, 1, 2]) AS k)
    ON abs(a.dim - b.dim) <= k + 1 GROUP BY 1, 2, 3),
cells AS (SELECT complaint_id, k, i // 4 AS cell, avg(s) AS v FROM smooth GROUP BY 1, 2, 3)
SELECT complaint_id, CAST(k""",
        1,
    ),
)
def filter_features(spark, sf_dir):
    made = features.filter_features(views.clustered(spark, sf_dir))
    return made.select(ID, F.posexplode("filtered").alias("pos", "x")).select(ID, "pos", r6("x").alias("value"))


# --- quality --------------------------------------------------------------------------------------
views.define(
    "moments",
    ["clustered", "cents"],
    """SELECT window_id, local_cluster, members AS n, centroid, ms FROM cents JOIN (SELECT window_id, local_cluster,
  avg(list_dot_product(vector, vector)) AS ms FROM clustered GROUP BY 1, 2) USING (window_id, local_cluster)""",
)


@register(
    "silhouette",
    using(
        "clustered",
        "moments",
        select="""SELECT window_id, count(*) AS n_points, count(DISTINCT own) AS n_clusters,
  CASE WHEN count(DISTINCT own) >= 2 AND count(DISTINCT own) < count(*) THEN
    round(avg(CASE WHEN n = 1 THEN 0.0 ELSE (b - a) / greatest(a, b) END), 6) END AS silhouette_sq
FROM (SELECT p.window_id, p.complaint_id, p.local_cluster AS own, max(CASE WHEN p.local_cluster = m.local_cluster THEN n END) AS n,
    max(CASE WHEN p.local_cluster = m.local_cluster AND n > 1 THEN d * n / (n - 1) END) AS a,
    min(CASE WHEN p.local_cluster <> m.local_cluster THEN d END) AS b
  FROM clustered p JOIN (SELECT * FROM moments) m ON p.window_id = m.window_id,
    LATERAL (SELECT list_dot_product(p.vector, p.vector) + m.ms - 2 * list_dot_product(p.vector, m.centroid) AS d)
  GROUP BY 1, 2, 3) GROUP BY 1""",
    ),
)
def silhouette(spark, sf_dir):
    scored = quality.silhouette(views.clustered(spark, sf_dir))
    return scored.withColumn("silhouette_sq", r6("silhouette_sq"))


@register(
    "davies_bouldin",
    using(
        "clustered",
        "cents",
        select="""SELECT window_id, count(*) AS n_clusters, round(avg(r), 6) AS davies_bouldin FROM (
  SELECT a.window_id, a.local_cluster, max((a.s + b.s) / list_distance(a.centroid, b.centroid)) AS r
  FROM spread a JOIN spread b ON a.window_id = b.window_id AND a.local_cluster <> b.local_cluster GROUP BY 1, 2) GROUP BY 1""",
    ).replace(
        "\nSELECT window_id, count(*) AS n_clusters",
        """,
spread AS (SELECT p.window_id, p.local_cluster, any_value(c.centroid) AS centroid, avg(list_distance(p.vector, c.centroid)) AS s
  FROM clustered p JOIN cents c ON p.window_id = c.window_id AND p.local_cluster = c.local_cluster GROUP BY 1, 2)
SELECT window_id, count(*) AS n_clusters""",
        1,
    ),
)
def davies_bouldin(spark, sf_dir):
    scored = quality.davies_bouldin(views.clustered(spark, sf_dir))
    return scored.withColumn("davies_bouldin", r6("davies_bouldin"))


@register(
    "calinski_harabasz",
    using(
        "clustered",
        "moments",
        "coords",
        select="""SELECT window_id, n_points, n_clusters,
  round(between * (n_points - n_clusters) / (within * (n_clusters - 1)), 4) AS calinski_harabasz FROM (
  SELECT m.window_id, CAST(sum(n) AS BIGINT) AS n_points, count(*) AS n_clusters,
    sum(n * list_distance(centroid, centre) * list_distance(centroid, centre)) AS between,
    sum(n * (ms - list_dot_product(centroid, centroid))) AS within
  FROM moments m JOIN (SELECT window_id, list(c ORDER BY dim) AS centre FROM (
    SELECT window_id, dim, avg(x) AS c FROM coords GROUP BY 1, 2) GROUP BY 1) g ON m.window_id = g.window_id GROUP BY 1)""",
    ),
)
def calinski_harabasz(spark, sf_dir):
    scored = quality.calinski_harabasz(views.clustered(spark, sf_dir))
    return scored.withColumn("calinski_harabasz", F.round("calinski_harabasz", 4))


_PER_CLASS = """SELECT label, CAST(sum(s) AS BIGINT) AS support, CAST(sum(p) AS BIGINT) AS predicted,
  coalesce(sum(t) / nullif(sum(p), 0), 0.0) AS precision, coalesce(sum(t) / nullif(sum(s), 0), 0.0) AS recall,
  2 * sum(t) / (sum(s) + sum(p)) AS f1, sum(t) AS tp
FROM (SELECT truth AS label, n AS s, 0 AS p, CASE WHEN truth = guess THEN n ELSE 0 END AS t FROM confusion
  UNION ALL SELECT guess, 0, n, 0 FROM confusion) GROUP BY 1"""
views.define("confusion", ["hard"], "SELECT label AS truth, local_cluster AS guess, count(*) AS n FROM hard GROUP BY 1, 2")
views.define("per_class", ["confusion"], _PER_CLASS)
_OVERALL = """SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1,
  round(sum(f1 * support) / sum(support), 6) AS weighted_f1, CAST(sum(support) AS BIGINT) AS n_test, count(*) AS n_classes"""


@register(
    "confusion_metrics",
    using(
        "per_class",
        select="""SELECT label, support, predicted, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1
FROM per_class""",
    ),
)
def confusion_metrics(spark, sf_dir):
    table = quality.per_class_metrics(quality.confusion(_hard(spark, sf_dir), "label", LOCAL))
    return table.select(
        "label", "support", "predicted", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1")
    )


def _rounded_overall(df):
    return df.select(
        *[r6(c).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1")], "n_test", "n_classes"
    )


@register("overall_metrics", using("per_class", select=f"{_OVERALL} FROM per_class"))
def overall_metrics(spark, sf_dir):
    table = quality.per_class_metrics(quality.confusion(_hard(spark, sf_dir), "label", LOCAL))
    return _rounded_overall(quality.overall_metrics(table))


views.define(
    "contingency",
    ["clustered_texts", "complaints"],
    """SELECT local_cluster, issue AS cls, count(*) AS n FROM clustered_texts JOIN complaints USING (complaint_id) GROUP BY 1, 2""",
)
views.define(
    "majority",
    ["contingency"],
    """SELECT local_cluster, cls AS guess FROM (SELECT *, row_number() OVER (PARTITION BY local_cluster ORDER BY n DESC, cls) AS r
  FROM contingency) WHERE r = 1""",
)


@register(
    "majority_match",
    using(
        "contingency",
        "majority",
        select=f"{_OVERALL} FROM (" + _PER_CLASS.replace("FROM confusion", "FROM agreed") + ")",
    ).replace(
        f"\n{_OVERALL}",
        f""",
agreed AS (SELECT cls AS truth, guess, sum(n) AS n FROM contingency JOIN majority USING (local_cluster) GROUP BY 1, 2)
{_OVERALL}""",
        1,
    ),
)
def majority_match(spark, sf_dir):
    joined = views.clustered_texts(spark, sf_dir).select(ID, LOCAL).join(
        views.complaints(spark, sf_dir).select(ID, "issue"), ID
    )
    return _rounded_overall(quality.cluster_class_agreement(joined, LOCAL, "issue"))
