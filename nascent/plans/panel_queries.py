"""Panel, products, text projections, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from nascent.functions import dates, text
from nascent.operators import numbering, panel, products, sampling
from nascent.plans import views
from nascent.plans.registry import r6, register
from nascent.plans.views import using
from nascent.session import scratch_path
from nascent.sources import raw, sinks

ID, NARRATIVE, WORDS = panel.ID, panel.NARRATIVE, panel.WORDS


@register(
    "panel_volume",
    using(
        "panel",
        select="""SELECT window_id, count(*) AS complaints, round(count(*) / sum(count(*)) OVER (), 6) AS share,
  row_number() OVER (ORDER BY count(*) DESC, window_id) AS size_rank FROM panel GROUP BY window_id""",
    ),
)
def panel_volume(spark, sf_dir):
    return panel.volume_with_share(views.panel(spark, sf_dir))


@register(
    "panel_build",
    using(
        "panel",
        select="SELECT * REPLACE (CAST(date_received AS VARCHAR) AS date_received) FROM panel",
    ),
)
def panel_build(spark, sf_dir):
    return views.panel(spark, sf_dir).withColumn("date_received", F.col("date_received").cast("string"))


@register(
    "narrative_rate",
    using(
        "complaints",
        select=r"""SELECT coalesce(window_id, 'all') AS window_id, count(*) AS complaints,
  CAST(sum(present) AS BIGINT) AS with_narrative, round(sum(present) / count(*), 6) AS narrative_rate
FROM (SELECT strftime(date_received, '%Y-%m') AS window_id,
        CAST(issue NOT IN ('fr', 'es') AND regexp_matches(consumer_complaint_narrative, '\S') AS INTEGER) AS present
      FROM complaints) GROUP BY ROLLUP (window_id)""",
    ),
)
def narrative_rate(spark, sf_dir):
    # The supplied texts are never blank; complaints of two issues play those filed
    # without a narrative.
    raw = views.complaints(spark, sf_dir).withColumn(
        NARRATIVE,
        F.when(F.col("issue") == "fr", F.lit(None)).when(F.col("issue") == "es", " ").otherwise(F.col(NARRATIVE)),
    )
    return panel.narrative_rate(raw)


@register(
    "panel_summary",
    using(
        "panel",
        select="""SELECT count(*) AS n_complaints, count(DISTINCT window_id) AS n_windows, min(window_id) AS first_window,
  max(window_id) AS last_window, count(DISTINCT product) AS n_products,
  quantile_cont(CAST(narrative_word_count AS DOUBLE), 0.5) AS median_narrative_words FROM panel""",
    ),
)
def panel_summary(spark, sf_dir):
    return panel.summarize(views.panel(spark, sf_dir))


@register(
    "panel_integrity",
    using(
        "panel",
        select="""SELECT count(*) AS n_rows, count(DISTINCT complaint_id) AS unique_ids,
  count(*) - count(DISTINCT complaint_id) AS duplicate_ids,
  CAST(count(*) - count(consumer_complaint_narrative) AS BIGINT) AS null_narratives,
  count(DISTINCT window_id) AS n_windows, min(window_id) AS first_window, max(window_id) AS last_window,
  count(DISTINCT product) AS n_products FROM panel""",
    ),
)
def panel_integrity(spark, sf_dir):
    return panel.integrity(views.panel(spark, sf_dir))


@register(
    "edge_windows",
    using(
        "panel",
        select="""SELECT window_id, complaints, a <= 4 AS in_head, b <= 8 AS in_tail FROM (
  SELECT window_id, count(*) AS complaints, row_number() OVER (ORDER BY window_id) AS a,
    row_number() OVER (ORDER BY window_id DESC) AS b FROM panel GROUP BY window_id) WHERE a <= 4 OR b <= 8""",
    ),
)
def edge_windows(spark, sf_dir):
    return panel.edge_windows(views.panel(spark, sf_dir))


@register(
    "length_histogram",
    using(
        "panel",
        select="""SELECT CAST(bin AS INTEGER) AS bin, round(lo + CAST(hi - lo AS DOUBLE) * bin / 50, 6) AS low_edge,
  count(*) AS complaints
FROM (SELECT least(49, (v - lo) * 50 // (hi - lo)) AS bin, lo, hi FROM
  (SELECT least(narrative_word_count, 600) AS v FROM panel),
  (SELECT min(least(narrative_word_count, 600)) AS lo, max(least(narrative_word_count, 600)) AS hi FROM panel))
GROUP BY bin, lo, hi""",
    ),
)
def length_histogram(spark, sf_dir):
    return panel.length_histogram(views.panel(spark, sf_dir))


@register(
    "top_products",
    using(
        "panel",
        select="""SELECT product, count(*) AS complaints FROM panel GROUP BY product
ORDER BY complaints DESC, product LIMIT 15""",
    ),
)
def top_products(spark, sf_dir):
    return panel.top_values(views.panel(spark, sf_dir), "product")


_CANONICAL_SQL = (
    "CASE "
    + " ".join(
        "WHEN " + " OR ".join(f"contains(lower(product), '{f}')" for f in fragments) + f" THEN '{label}'"
        for fragments, label in products.CANONICAL_RULES
    )
    + " WHEN contains(lower(product), 'debt') AND contains(lower(product), 'management') THEN 'Debt management'"
    + r""" ELSE array_to_string(list_transform(regexp_extract_all(trim(product), '\p{L}+|[^\p{L}]+'),
      lambda y: upper(y[1]) || lower(y[2:])), '') END"""
)
_DISPLAY_SQL = (
    "CASE product "
    + " ".join(f"WHEN '{raw}' THEN '{shown}'" for raw, shown in products.DISPLAY_NAMES.items())
    + r""" ELSE array_to_string(list_transform(regexp_extract_all(trim(split_part(product, ',', 1)),
      '\p{L}+|[^\p{L}]+'), lambda y: upper(y[1]) || lower(y[2:])), '') END"""
)
views.define("labelled", ["panel"], f"SELECT *, {_DISPLAY_SQL} AS label FROM panel")


@register(
    "product_canonical",
    using("complaints", select=f"SELECT complaint_id, product, {_CANONICAL_SQL} AS canonical FROM complaints"),
)
def product_canonical(spark, sf_dir):
    return views.complaints(spark, sf_dir).select(
        ID, "product", products.canonical_product(F.col("product")).alias("canonical")
    )


@register(
    "product_map",
    using("complaints", select=f"SELECT complaint_id, product, {_DISPLAY_SQL} AS shown FROM complaints"),
)
def product_map(spark, sf_dir):
    return views.complaints(spark, sf_dir).select(
        ID, "product", products.display_product(F.col("product")).alias("shown")
    )


@register(
    "text_enriched",
    using(
        "complaints",
        select=r"""SELECT complaint_id,
  'Issue: ' || coalesce(issue, '') || '. Narrative: ' || consumer_complaint_narrative AS encoder_text,
  'Issue: ' || regexp_replace(coalesce(nullif(issue, 'fr'), 'General Inquiry'), '^\s+|\s+$', '', 'g') || '. Narrative: '
    || regexp_replace(consumer_complaint_narrative, '^\s+|\s+$', '', 'g') AS evaluation_text
FROM complaints WHERE regexp_matches(consumer_complaint_narrative, '\S')""",
    ),
)
def text_enriched(spark, sf_dir):
    df = views.complaints(spark, sf_dir).where(text.is_present(F.col(NARRATIVE)))
    # One issue value plays the missing one, to exercise the default.
    sparse = F.nullif(F.col("issue"), F.lit("fr"))
    return df.select(
        ID,
        text.enrich(F.col("issue"), F.col(NARRATIVE)).alias("encoder_text"),
        text.enrich_for_evaluation(sparse, F.col(NARRATIVE)).alias("evaluation_text"),
    )


@register(
    "redacted_snippet",
    using(
        "complaints",
        select=r"""SELECT complaint_id, CASE WHEN length(t) > 280 THEN substr(t, 1, 280) || '...' ELSE t END AS short_snippet,
  CASE WHEN length(t) > 600 THEN substr(t, 1, 600) || '...' ELSE t END AS long_snippet
FROM (SELECT complaint_id, regexp_replace(replace(consumer_complaint_narrative, 'the', 'XXXX'), 'X{2,}', '[Redacted]', 'g') AS t
      FROM complaints)""",
    ),
)
def redacted_snippet(spark, sf_dir):
    # The supplied texts are not masked; one frequent word is masked to show the effect.
    masked = F.replace(F.col(NARRATIVE), F.lit("the"), F.lit("XXXX"))
    clean = views.complaints(spark, sf_dir).select(ID, text.redact(masked).alias("t"))
    return clean.select(
        ID,
        text.snippet(F.col("t"), 280).alias("short_snippet"),
        text.snippet(F.col("t"), 600).alias("long_snippet"),
    )


@register(
    "strict_presence",
    """SELECT doc_id, text FROM (SELECT doc_id, CASE lang WHEN 'de' THEN ' NaN ' WHEN 'es' THEN '  ' WHEN 'fr' THEN NULL
  ELSE text END AS text FROM documents) WHERE text IS NOT NULL AND trim(text) <> '' AND lower(trim(text)) <> 'nan'""",
)
def strict_presence(spark, sf_dir):
    lang = F.col("lang")
    spoiled = (
        F.when(lang == "de", " NaN ").when(lang == "es", "  ").when(lang == "fr", F.lit(None)).otherwise(F.col("text"))
    )
    df = views.table(spark, sf_dir, "documents").select("doc_id", spoiled.alias("text"))
    return df.where(text.is_present(F.col("text"), strict=True))


@register(
    "lenient_dates",
    using(
        "complaints",
        select="""SELECT complaint_id, strftime(coalesce(try_strptime(s, '%Y-%m-%d'), try_strptime(s, '%m/%d/%Y')), '%Y-%m-%d') AS day
FROM (SELECT complaint_id, CASE issue WHEN 'en' THEN strftime(date_received, '%m/%d/%Y') WHEN 'fr' THEN 'not a date'
  ELSE strftime(date_received, '%Y-%m-%d') END AS s FROM complaints)
WHERE coalesce(try_strptime(s, '%Y-%m-%d'), try_strptime(s, '%m/%d/%Y')) IS NOT NULL""",
    ),
)
def lenient_dates(spark, sf_dir):
    day, issue = F.col("date_received"), F.col("issue")
    written = (
        F.when(issue == "en", F.date_format(day, "MM/dd/yyyy"))
        .when(issue == "fr", "not a date")
        .otherwise(F.date_format(day, "yyyy-MM-dd"))
    )
    parsed = views.complaints(spark, sf_dir).select(ID, dates.lenient_timestamp(written).alias("when"))
    return parsed.where(F.col("when").isNotNull()).select(
        ID, F.date_format("when", "yyyy-MM-dd").alias("day")
    )


@register(
    "window_labels",
    """SELECT o_orderkey, strftime(d, '%Y-%m') AS m, strftime(d, '%Y-%m-%d') AS d, strftime(d, '%Y') AS y,
  strftime(d, '%Y') || 'Q' || CAST(quarter(d) AS VARCHAR) AS q,
  strftime(date_trunc('week', d), '%Y-%m-%d') || '/' || strftime(date_trunc('week', d) + INTERVAL 6 DAY, '%Y-%m-%d') AS w
FROM (SELECT o_orderkey, o_orderdate AS d FROM orders)""",
)
def window_labels(spark, sf_dir):
    when = F.col("o_orderdate")
    return views.table(spark, sf_dir, "orders").select(
        "o_orderkey", *[dates.window_label(when, f).alias(f.lower()) for f in ("M", "D", "Y", "Q", "W")]
    )


@register(
    "order_volume",
    """SELECT strftime(o_orderdate, '%Y-%m') AS window_id, o_orderpriority AS product, count(*) AS complaints,
  round(count(*) / sum(count(*)) OVER (PARTITION BY strftime(o_orderdate, '%Y-%m')), 6) AS share
FROM orders GROUP BY 1, 2""",
)
def order_volume(spark, sf_dir):
    from pyspark.sql import Window

    counts = (
        views.table(spark, sf_dir, "orders")
        .groupBy(
            dates.window_label(F.col("o_orderdate")).alias("window_id"),
            F.col("o_orderpriority").alias("product"),
        )
        .agg(F.count("*").alias("complaints"))
    )
    within = Window.partitionBy("window_id")
    return counts.withColumn("share", r6(F.col("complaints") / F.sum("complaints").over(within)))


@register(
    "cutoff_panel",
    using(
        "panel",
        select="""SELECT window_id, product, count(*) AS complaints FROM panel
WHERE date_received < DATE '2022-03-01' GROUP BY 1, 2""",
    ),
)
def cutoff_panel(spark, sf_dir):
    kept = panel.before_cutoff(views.panel(spark, sf_dir), "2022-03-01")
    return kept.groupBy("window_id", "product").agg(F.count("*").alias("complaints"))


@register(
    "union_narratives",
    r"""SELECT origin, count(*) AS n, CAST(sum(len(regexp_extract_all(t, '\S+'))) AS BIGINT) AS words FROM (
  SELECT 'documents' AS origin, text AS t FROM documents UNION ALL
  SELECT 'conversations', text FROM conversations UNION ALL SELECT 'benchmark', text FROM benchmark) GROUP BY origin""",
)
def union_narratives(spark, sf_dir):
    parts = [
        views.table(spark, sf_dir, t).select(F.lit(t).alias("origin"), "text")
        for t in ("documents", "conversations", "benchmark")
    ]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return whole.groupBy("origin").agg(
        F.count("*").alias("n"), F.sum(text.word_count(F.col("text")).cast("long")).alias("words")
    )


@register(
    "drilldown",
    """SELECT coalesce(o_orderpriority, 'ALL') AS product, coalesce(n_name, 'ALL') AS state,
  coalesce(c_mktsegment, 'ALL') AS company, CAST(GROUPING_ID(o_orderpriority, n_name, c_mktsegment) AS INTEGER) AS level,
  count(*) AS complaints, CAST(sum(CAST(o_totalprice > 400000 AS INTEGER)) AS BIGINT) AS alerts
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY CUBE (o_orderpriority, n_name, c_mktsegment)""",
)
def drilldown(spark, sf_dir):
    facts = (
        views.table(spark, sf_dir, "orders")
        .join(views.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(views.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderpriority").alias("product"),
            F.col("n_name").alias("state"),
            F.col("c_mktsegment").alias("company"),
            (F.col("o_totalprice") > 400000).alias("alert"),
        )
    )
    cells = panel.drill_down(facts, ["product", "state", "company"], "alert")
    dims = [F.coalesce(d, F.lit("ALL")).alias(d) for d in ("product", "state", "company")]
    return cells.select(*dims, "level", "complaints", "alerts")


# --- sampling -------------------------------------------------------------------------


@register(
    "systematic_sample",
    using(
        "complaints",
        select="""SELECT complaint_id, product FROM complaints
WHERE ('0x' || substr(md5('42:' || CAST(complaint_id AS VARCHAR)), 1, 8))::UBIGINT % 10 = 0""",
    ),
)
def systematic_sample(spark, sf_dir):
    return sampling.systematic_sample(views.complaints(spark, sf_dir), 10).select(ID, "product")


@register(
    "random_sample",
    using(
        "panel",
        select="""SELECT complaint_id, product FROM panel
ORDER BY md5('42:' || CAST(complaint_id AS VARCHAR)) LIMIT 500""",
    ),
)
def random_sample(spark, sf_dir):
    return sampling.random_sample(views.panel(spark, sf_dir), 500).select(ID, "product")


def _stratified_sql(target: int) -> str:
    return f"""
SELECT complaint_id, month, prod, n_available, row_number() OVER (ORDER BY CASE WHEN first_pass THEN '0' ELSE '1' END
    || md5('42:fill:' || CAST(complaint_id AS VARCHAR))) <= {target} OR n_available <= {target} AS sampled
FROM (SELECT *, row_number() OVER (PARTITION BY month, prod ORDER BY md5('42:' || CAST(complaint_id AS VARCHAR)))
        <= least(n_group, greatest(greatest(1, {target} // n_groups), n_group * {target} // n_available)) AS first_pass
  FROM (SELECT *, count(*) OVER (PARTITION BY month, prod) AS n_group, count(*) OVER () AS n_available,
      (SELECT count(*) FROM (SELECT DISTINCT window_id, trim(product) FROM panel)) AS n_groups
    FROM (SELECT complaint_id, window_id AS month, trim(product) AS prod FROM panel)))"""


def _sample(spark, sf_dir, target):
    pool = views.panel(spark, sf_dir).select(
        ID, F.col("window_id").alias("month"), text.strip(F.col("product")).alias("prod")
    )
    return sampling.stratified_flags(pool, ["month", "prod"], target)


@register(
    "stratified_sample",
    using("panel", select=f"SELECT complaint_id, month, prod FROM ({_stratified_sql(400)}) WHERE sampled"),
)
def stratified_sample(spark, sf_dir):
    return _sample(spark, sf_dir, 400).where("sampled").select(ID, "month", "prod")


@register(
    "sample_complement",
    using(
        "panel",
        select=f"SELECT complaint_id, product FROM panel WHERE complaint_id NOT IN (SELECT complaint_id FROM ({_stratified_sql(400)}) WHERE sampled)",
    ),
)
def sample_complement(spark, sf_dir):
    sample = _sample(spark, sf_dir, 400).where("sampled")
    return sampling.complement(views.panel(spark, sf_dir), sample).select(ID, "product")


@register(
    "stratified_split",
    using(
        "panel",
        select=f"""SELECT complaint_id, class, row_number() OVER (PARTITION BY class ORDER BY md5('17:' || CAST(complaint_id AS VARCHAR)))
  <= round(0.2 * count(*) OVER (PARTITION BY class)) AS is_test
FROM (SELECT complaint_id, {_CANONICAL_SQL} AS class FROM panel)""",
    ),
)
def stratified_split(spark, sf_dir):
    df = views.panel(spark, sf_dir).select(ID, products.canonical_product(F.col("product")).alias("class"))
    return sampling.stratified_split(df, "class")


@register(
    "label_index",
    using(
        "panel",
        select=f"""SELECT class, CAST(row_number() OVER (ORDER BY class) - 1 AS INTEGER) AS label_idx, count(*) AS rows
FROM (SELECT {_CANONICAL_SQL} AS class FROM panel) GROUP BY class""",
    ),
)
def label_index(spark, sf_dir):
    df = views.panel(spark, sf_dir).select(products.canonical_product(F.col("product")).alias("class"))
    return numbering.label_index(df, "class")


@register(
    "row_numbers",
    using(
        "panel",
        select="SELECT complaint_id, row_number() OVER (ORDER BY date_received, complaint_id) - 1 AS position FROM panel",
    ),
)
def row_numbers(spark, sf_dir):
    df = views.panel(spark, sf_dir).select(ID, "date_received")
    return numbering.number_rows(df, ["date_received", ID], "position").select(ID, "position")


@register(
    "csv_records",
    using(
        "complaints",
        select="""SELECT CAST(complaint_id AS VARCHAR) AS complaint_id, product, issue, md5(coalesce(consumer_complaint_narrative, '')) AS text_md5,
  length(coalesce(consumer_complaint_narrative, '')) AS n_chars FROM complaints""",
    ),
)
def csv_records(spark, sf_dir):
    """All complaints written as CSV, line breaks included, and read again by byte ranges."""
    path = scratch_path(spark, "csv")
    sinks.write_csv(views.complaints(spark, sf_dir), path)
    text = F.coalesce("consumer_complaint_narrative", F.lit(""))
    return raw.read_complaints(spark, path).select(
        "complaint_id", "product", "issue", F.md5(text).alias("text_md5"), F.length(text).cast("bigint").alias("n_chars")
    )
