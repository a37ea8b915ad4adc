"""Text vectors and cluster labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from nascent.functions import text
from nascent.operators import dashboard, encoding, panel, terms
from nascent.plans import panel_queries, views  # noqa: F401  (defines shared views)
from nascent.plans.registry import r6, register
from nascent.plans.views import quoted, using
from nascent.session import scratch_path
from nascent.sources.vector_store import VectorStore

ID, NARRATIVE = panel.ID, panel.NARRATIVE
DIM = 256

views.define(
    "bucketed",
    ["panel"],
    rf"""SELECT complaint_id, CAST(b AS INTEGER) AS bucket, CAST(sum(s) AS BIGINT) AS weight FROM (
  SELECT complaint_id, ('0x' || substr(md5(tok), 1, 8))::UBIGINT % {DIM} AS b,
    1 - 2 * CAST(('0x' || substr(md5('s:' || tok), 1, 8))::UBIGINT % 2 AS INTEGER) AS s
  FROM (SELECT complaint_id, unnest(regexp_extract_all(lower('Issue: ' || issue || '. Narrative: '
      || consumer_complaint_narrative), '\S+')) AS tok FROM panel)) GROUP BY 1, 2""",
)


def _encoder_text():
    return text.enrich(F.col("issue"), F.col(NARRATIVE))


@register("hashed_buckets", using("bucketed", select="SELECT * FROM bucketed"))
def hashed_buckets(spark, sf_dir):
    return encoding.hashed_buckets(views.panel(spark, sf_dir, spread=True), _encoder_text(), DIM)


@register(
    "hashed_vectors",
    using(
        "bucketed",
        select="""SELECT complaint_id, bucket, round(weight / norm, 6) AS value FROM (
  SELECT *, sqrt(sum(weight * weight) OVER (PARTITION BY complaint_id)) AS norm FROM bucketed) WHERE weight <> 0""",
    ),
)
def hashed_vectors(spark, sf_dir):
    dense = encoding.encode_hashed(views.panel(spark, sf_dir, spread=True), _encoder_text(), DIM)
    return (
        dense.select(ID, F.posexplode("vector").alias("bucket", "value"))
        .where(F.col("value") != 0)
        .select(ID, "bucket", r6("value").alias("value"))
    )


@register(
    "stored_vectors",
    using(
        "bucketed",
        select="""SELECT complaint_id, bucket, round(weight / norm, 6) AS value FROM (
  SELECT *, sqrt(sum(weight * weight) OVER (PARTITION BY complaint_id)) AS norm FROM bucketed) WHERE weight <> 0""",
    ),
)
def stored_vectors(spark, sf_dir):
    """Vectors from a store filled in two parts, of which the second only adds what is new."""
    texts = views.panel(spark, sf_dir, spread=True).select(ID, _encoder_text().alias("text"))
    hashed = lambda new: encoding.encode_hashed(new, F.col("text"), DIM)
    store = VectorStore(scratch_path(spark, "vectors"), "hashed-bow", hashed)
    store.update(texts.where(F.col(ID) % 2 == 0), "text")
    store.update(texts, "text")
    dense, _ = store.vectors(texts, "text")
    return (
        dense.select(ID, F.posexplode("vector").alias("bucket", "value"))
        .where(F.col("value") != 0)
        .select(ID, "bucket", r6("value").alias("value"))
    )


@register(
    "vector_facts",
    using("panel", select=f"SELECT 'hashed-bow' AS backend, {DIM} AS dim, count(*) AS n FROM panel"),
)
def vector_facts(spark, sf_dir):
    dense = encoding.encode_hashed(views.panel(spark, sf_dir, spread=True), _encoder_text(), DIM)
    return encoding.describe_vectors(dense, "hashed-bow")


# --- TF-IDF per cluster, vocabulary and frequencies per cluster -------------------------
views.define(
    "term_tf",
    ["panel"],
    rf"""SELECT complaint_id, product AS grp, term, count(*) AS tf FROM (
  SELECT complaint_id, product, unnest(regexp_extract_all(lower(consumer_complaint_narrative), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term
  FROM panel) WHERE term NOT IN ({quoted(terms.ENGLISH_STOP_WORDS)}) GROUP BY 1, 2, 3""",
)
views.define(
    "term_vocab",
    ["term_tf", "panel"],
    """SELECT grp, term, ln((1 + n) / (1 + df)) + 1 AS idf FROM (
  SELECT grp, term, df, row_number() OVER (PARTITION BY grp ORDER BY total DESC, term) AS place
  FROM (SELECT grp, term, sum(tf) AS total, count(*) AS df FROM term_tf GROUP BY 1, 2))
JOIN (SELECT product AS grp, count(*) AS n FROM panel GROUP BY 1) USING (grp)""",
)
views.define(
    "term_scores",
    ["term_tf", "term_vocab"],
    """SELECT grp, term, round(sum(w / norm), 6) AS score FROM (
  SELECT grp, term, w, sqrt(sum(w * w) OVER (PARTITION BY complaint_id)) AS norm FROM (
    SELECT complaint_id, grp, term, tf * idf AS w FROM term_tf JOIN term_vocab USING (grp, term))) GROUP BY 1, 2""",
)
views.define(
    "label_terms",
    ["term_scores"],
    """SELECT grp, term, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, term) AS rank
  FROM term_scores) WHERE rank <= 6""",
)


@register(
    "tfidf_sum_terms",
    using("label_terms", select="SELECT grp AS product, term, score, CAST(rank AS INTEGER) AS rank FROM label_terms"),
)
def tfidf_sum_terms(spark, sf_dir):
    return terms.top_terms(views.panel(spark, sf_dir, spread=True), "product", F.col(NARRATIVE))


# --- TF-IDF over words and pairs, vocabulary over the corpus -----------------------------
views.define(
    "gram_tf",
    ["labelled"],
    rf"""SELECT complaint_id, label AS grp, term, count(*) AS tf FROM (
  SELECT complaint_id, label, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term
  FROM (SELECT complaint_id, label, list_filter(regexp_extract_all(lower(regexp_replace(consumer_complaint_narrative,
      '\b(x{{2,}}|xx/\d{{2}}/\d{{4}}|\$[\d\.,]+)\b', ' ', 'gi')), '[\p{{L}}\p{{N}}_]+'),
      lambda t: regexp_full_match(t, '[a-zA-Z]{{3,}}') AND NOT list_contains([{quoted(terms.DOMAIN_STOP_WORDS)}], t)) AS w
    FROM labelled)) GROUP BY 1, 2, 3""",
)
views.define(
    "gram_vocab",
    ["gram_tf", "panel"],
    """SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM (SELECT term, sum(tf) AS total, count(*) AS df
  FROM gram_tf GROUP BY 1), (SELECT count(*) AS n FROM panel)""",
)
views.define(
    "gram_scores",
    ["gram_tf", "gram_vocab", "labelled"],
    """SELECT grp, term, round(s / n, 6) AS score FROM (SELECT grp, term, sum(w / norm) AS s FROM (
  SELECT grp, term, w, sqrt(sum(w * w) OVER (PARTITION BY complaint_id)) AS norm FROM (
    SELECT complaint_id, grp, term, tf * idf AS w FROM gram_tf JOIN gram_vocab USING (term))) GROUP BY 1, 2)
JOIN (SELECT label AS grp, count(*) AS n FROM labelled GROUP BY 1) USING (grp)""",
)
views.define(
    "keyword_terms",
    ["gram_scores"],
    f"""SELECT grp, term, score, row_number() OVER (PARTITION BY grp ORDER BY place) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, term) AS place FROM gram_scores
  WHERE term NOT IN ({quoted(terms.DOMAIN_STOP_WORDS)}))""",
)


@register(
    "tfidf_mean_ngrams",
    using(
        "keyword_terms",
        select="SELECT grp AS label, term, score, CAST(rank AS INTEGER) AS rank FROM keyword_terms WHERE rank <= 4",
    ),
)
def tfidf_mean_ngrams(spark, sf_dir):
    labelled = dashboard.labelled_by_product(views.panel(spark, sf_dir, spread=True))
    return terms.export_keywords(labelled, "label", F.col(NARRATIVE))


@register(
    "fallback_terms",
    using(
        "panel",
        select=r"""SELECT product, term, n, CAST(rank AS INTEGER) AS rank FROM (
  SELECT product, term, n, row_number() OVER (PARTITION BY product ORDER BY n DESC, term) AS rank FROM (
    SELECT product, term, count(*) AS n FROM (SELECT product, unnest(regexp_extract_all(lower(consumer_complaint_narrative), '\S+')) AS term
      FROM panel) WHERE length(term) > 4 GROUP BY 1, 2)) WHERE rank <= 6""",
    ),
)
def fallback_terms(spark, sf_dir):
    return terms.frequent_words(views.panel(spark, sf_dir, spread=True), "product", F.col(NARRATIVE))


@register(
    "npmi",
    using(
        "label_terms",
        "panel",
        select=rf""", present AS (SELECT DISTINCT complaint_id, unnest(regexp_extract_all(lower(consumer_complaint_narrative),
    '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM panel),
hits AS (SELECT complaint_id, term FROM present WHERE term IN (SELECT term FROM label_terms)),
singles AS (SELECT term, count(*) AS n FROM hits GROUP BY 1),
pairs AS (SELECT x.grp, x.term AS a, y.term AS b FROM label_terms x JOIN label_terms y ON x.grp = y.grp AND x.term < y.term),
joint AS (SELECT h.term AS a, g.term AS b, count(*) AS n_ab FROM hits h JOIN hits g ON h.complaint_id = g.complaint_id AND h.term < g.term
  GROUP BY 1, 2)
SELECT grp AS product, count(*) AS pairs, round(avg(CASE WHEN n_ab IS NULL THEN -1.0 WHEN n_ab = n_docs THEN 1.0
    ELSE ln(n_ab * n_docs / (sa.n * sb.n)) / -ln(n_ab / n_docs) END), 6) AS coherence
FROM pairs LEFT JOIN joint USING (a, b) JOIN singles sa ON sa.term = a JOIN singles sb ON sb.term = b,
  (SELECT count(*) AS n_docs FROM panel) GROUP BY 1""".lstrip(", "),
    ).replace("\npresent AS", ",\npresent AS", 1),
)
def npmi(spark, sf_dir):
    docs = views.panel(spark, sf_dir, spread=True)
    topics = terms.top_terms(docs, "product", F.col(NARRATIVE)).select("product", "term")
    tokens = text.terms(F.col(NARRATIVE), terms.ENGLISH_STOP_WORDS)
    return terms.npmi(docs, topics, "product", tokens)
