"""Streams over the supplied tables, run until everything available is processed."""

from __future__ import annotations

from pyspark.sql import functions as F

from nascent.learning import clustering
from nascent.operators import dashboard, novelty
from nascent.operators.panel import ID, NARRATIVE, WINDOW
from nascent.plans import board_queries, views
from nascent.plans.registry import register
from nascent.plans.views import quoted, using
from nascent.session import scratch_path, settle
from nascent.streaming import flows


def _stream(spark, sf_dir, name):
    schema = views.table(spark, sf_dir, name).schema
    # A pattern, because a file stream takes a folder or a pattern, not a single file.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}*.parquet")


def _complaint_stream(spark, sf_dir):
    return _stream(spark, sf_dir, "documents").select(
        F.col("doc_id").alias(ID),
        F.date_add(F.lit(views.FIRST_DAY).cast("date"), (F.col("doc_id") % views.DAYS).cast("int")).alias("date_received"),
        F.col("source").alias("product"),
        F.col("lang").alias("issue"),
        F.col("text").alias(NARRATIVE),
    )


@register(
    "stream_daily_volume",
    """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2""",
)
def stream_daily_volume(spark, sf_dir):
    folder = scratch_path(spark, "volume")
    # The supplied times carry no zone; read as UTC whatever the session says.
    shifted = _stream(spark, sf_dir, "events").select(
        F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()).alias("ts"), "event_type"
    )
    flows.volume(shifted, folder, "ts", ["event_type"]).awaitTermination()
    counts = flows.current_volume(spark, folder, ["event_type"])
    start = F.to_utc_timestamp("window_start", F.current_timezone())
    return counts.select(F.date_format(start, "yyyy-MM-dd").alias("day"), "event_type", "n")


@register(
    "stream_ingest",
    using(
        "complaints",
        select=r"""SELECT count(*) AS raw, count(*) FILTER (regexp_matches(consumer_complaint_narrative, '\S')) AS kept,
  (SELECT count(*) FROM panel) AS panel_rows FROM complaints""",
    ).replace("\nSELECT count(*) AS raw", f",\npanel AS ({views.SQL['panel']})\nSELECT count(*) AS raw", 1),
)
def stream_ingest(spark, sf_dir):
    folder = scratch_path(spark, "ingest")
    flows.ingest(_complaint_stream(spark, sf_dir), folder).awaitTermination()
    rows = spark.read.parquet(f"{folder}/panel").agg(F.count("*").alias("panel_rows"), F.lit(1).alias("one"))
    return flows.ingest_totals(spark, folder).withColumn("one", F.lit(1)).join(rows, "one").drop("one")


@register(
    "stream_novelty",
    using("probable", select="""SELECT complaint_id, CAST(arg_min(cid, cid - p * 1000000) AS INTEGER) AS assigned_cluster,
  max(p) AS probability FROM probable GROUP BY 1"""),
)
def stream_novelty(spark, sf_dir):
    clusters = settle(board_queries._clusters(spark, sf_dir))
    folder = scratch_path(spark, "novelty")
    names = F.array(*[F.lit(n) for n in views.PRODUCT_NAMES])
    source = F.substring("product", 4, 9).cast("int") % len(views.PRODUCT_NAMES)
    texts = _complaint_stream(spark, sf_dir).where(F.col(NARRATIVE).rlike(r"^\s*+(?:\S++\s++){9}\S"))
    texts = dashboard.labelled_by_product(texts.withColumn("product", F.get(names, source)))
    flows.score_stream(texts.withColumnRenamed("label", "category"), clusters, folder).awaitTermination()
    return spark.read.parquet(f"{folder}/scored").select(ID, "assigned_cluster", "probability")


_WORDS = f"list_filter(list_filter(tokens, lambda w: regexp_full_match(w, '[a-zA-Z]{{3,}}')), lambda w: length(w) > 4 AND NOT list_contains([{quoted(novelty.SPAWN_STOP_WORDS)}], w))"
views.define(
    "live_judged",
    ["board_clusters"],
    rf"""SELECT id, emerging, words, arg_min(cid, cid - p * 1000000) AS cid, emerging OR max(score) < 3 OR greatest(0.12, round(1 - max(score) / (max(score) + 4), 3)) >= 0.55 AS is_novel
FROM (SELECT *, round(w / sum(w) OVER (PARTITION BY id), 3) AS p
  FROM (SELECT id, cid, emerging, words, score, exp(least(8.0, 0.7 * score)) AS w
    FROM (SELECT t.id, c.id AS cid, list_has_any(tokens, [{quoted(novelty.EMERGING_TERMS)}]) AS emerging, {_WORDS} AS words,
      list_sum(list_transform(c.keywords, lambda k: CASE WHEN regexp_full_match(lower(k), '[a-zA-Z]{{3,}}') AND list_contains(tokens, lower(k)) THEN 3.0
        WHEN contains(low, lower(k)) THEN 1.5 ELSE 0.0 END)) + CASE WHEN contains(low, lower(c.label)) THEN 5.0 ELSE 0.0 END AS score
    FROM (SELECT doc_id AS id, lower(coalesce(text, '')) AS low, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+') AS tokens FROM documents) t, board_clusters c)))
GROUP BY 1, 2, 3""",
)
views.define(
    "live_opened",
    ["live_judged"],
    f"""SELECT list_sort(keywords) AS same, kind, min(id) AS first, count(*) AS n, arg_min(keywords, id) AS keywords
FROM (SELECT id, CASE WHEN emerging THEN 'Emergent: Novel Fraud Pattern' ELSE 'Emergent Cluster #' END AS kind,
  CASE WHEN len(words) > 0 THEN words[1:4] ELSE [{quoted(novelty.SPAWN_KEYWORDS)}] END AS keywords FROM live_judged WHERE is_novel) GROUP BY 1, 2""",
)


@register(
    "spawn_clusters",
    using(
        "live_opened",
        select="""SELECT id, label, n + (SELECT count(*) FROM live_judged WHERE NOT is_novel AND cid = c.id) AS count, array_to_string(keywords, ' ') AS keywords
FROM board_clusters c
UNION ALL
SELECT CAST(id AS INTEGER), CASE WHEN kind = 'Emergent Cluster #' THEN kind || (id + 1) ELSE kind END, n, array_to_string(keywords, ' ')
FROM (SELECT *, (SELECT count(*) FROM board_clusters) + row_number() OVER (ORDER BY first) - 1 AS id FROM live_opened)""",
    ),
)
def spawn_clusters(spark, sf_dir):
    folder = scratch_path(spark, "live")
    flows.start_clusters(board_queries._clusters(spark, sf_dir), folder)
    texts = _complaint_stream(spark, sf_dir).withColumn("category", F.lit(""))
    flows.live_clusters(texts.select(ID, NARRATIVE, "category"), folder, novelty.NOVEL_AT)
    state = flows.live_state(spark, folder)
    return state.select("id", "label", "count", F.array_join("keywords", " ").alias("keywords"))


@register("stream_windows")
def stream_windows(spark, sf_dir):
    folder = scratch_path(spark, "windows")
    month = (F.col("vec_id") % 12 + 1).cast("int")
    quarter = F.ceil(month / 3).cast("int")
    start = F.make_date(F.lit(2024), (quarter - 1) * 3 + 1, F.lit(1))
    vectors = _stream(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias(ID),
        F.concat(F.lit("2024Q"), quarter.cast("string")).alias(WINDOW),
        F.col("embedding").cast("array<double>").alias("vector"),
        F.make_date(F.lit(2024), month, F.lit(15)).cast("timestamp").alias(flows.EVENT_TIME),
        F.add_months(start, 3).cast("timestamp").alias(flows.WINDOW_END),
    )
    settings = clustering.SMALL
    flows.cluster_closed_windows(vectors, folder, 64, settings, lateness="20 days").awaitTermination()
    flows.flush_windows(spark, folder, 64, settings)
    return flows.streamed_assignments(spark, folder, settings)
