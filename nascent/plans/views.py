"""The complaint tables expressed over the supplied tables.

``documents`` stands in for complaints, ``embeddings`` for clustered vectors and
``benchmark`` for the descriptions of known cases. Each view exists twice: as a
DataFrame and as the SQL the check statements start from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nascent.operators import panel as panels
from nascent.operators.numbering import number_rows
from nascent.session import spread_scan

# Public complaint product names, one per document source.
PRODUCT_NAMES = [
    "Credit reporting, credit repair services, or other personal consumer reports",
    "Debt collection",
    "Credit card or prepaid card",
    "Checking or savings account",
    "Mortgage",
    "Money transfer, virtual currency, or money service",
    "Vehicle loan or lease",
    "Payday loan, title loan, or personal loan",
    "Student loan",
    "Prepaid card",
    "Debt or credit management",
    "Buy Now, Pay Later (BNPL)",
    "Earned wage access",
    "Bank account or service",
    "Consumer Loan",
    "Credit card",
    "Credit reporting",
    "Payday loan, title loan, personal loan, or advance loan",
    "Virtual currency",
    "Other financial service",
]
FIRST_DAY = "2021-01-01"
DAYS = 730
CLUSTERS = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def complaints(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    if spread:
        documents = spread_scan(documents)
    names = F.array(*[F.lit(n) for n in PRODUCT_NAMES])
    source = F.substring("source", 4, 9).cast("int") % len(PRODUCT_NAMES)
    return documents.select(
        F.col("doc_id").alias("complaint_id"),
        F.date_add(F.lit(FIRST_DAY).cast("date"), (F.col("doc_id") % DAYS).cast("int")).alias("date_received"),
        F.get(names, source).alias("product"),
        F.col("lang").alias("issue"),
        F.col("source").alias("sub_issue"),
        F.col("text").alias("consumer_complaint_narrative"),
    )


def panel(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """``spread`` is for queries that work hard on every text."""
    return panels.build_panel(complaints(spark, sf_dir, spread))


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clustered vectors: twelve windows, ten local clusters."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("complaint_id"),
        F.concat(F.lit("2024-"), F.lpad((F.col("vec_id") % 12 + 1).cast("string"), 2, "0")).alias("window_id"),
        F.col("label").cast("int").alias("local_cluster"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )


def clustered_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a clustered vector: they take the vectors in turn, by their ids."""
    vectors = number_rows(clustered(spark, sf_dir), ["complaint_id"], "_place").withColumnRenamed("complaint_id", "_vector_id")
    count = table(spark, sf_dir, "embeddings").count()
    place = F.pmod(F.col("doc_id"), F.lit(max(count, 1)))
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("complaint_id"), place.alias("_place"))
    return documents.join(vectors, "_place").drop("_place", "_vector_id")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("case-"), F.col("item_id").cast("string")).alias("name"),
        F.col("text").alias("product"),
        F.lit(None).cast("string").alias("sub_issue"),
        F.date_format(
            F.add_months(F.lit("2024-06-01").cast("date"), (F.col("item_id") % 12).cast("int")), "yyyy-MM-dd"
        ).alias("recognition_date"),
        F.lit("benchmark passage").alias("recognition_basis"),
    )


def _quoted(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


SQL: dict[str, str] = {}
SQL["complaints"] = f"""
SELECT doc_id AS complaint_id, DATE '{FIRST_DAY}' + CAST(doc_id % {DAYS} AS INTEGER) AS date_received,
  [{_quoted(PRODUCT_NAMES)}][1 + CAST(substr(source, 4) AS INTEGER) % {len(PRODUCT_NAMES)}] AS product,
  lang AS issue, source AS sub_issue, text AS consumer_complaint_narrative
FROM documents"""
SQL["panel"] = r"""
SELECT complaint_id, date_received, strftime(date_received, '%Y-%m') AS window_id, product, issue, sub_issue,
  consumer_complaint_narrative,
  CAST(len(regexp_extract_all(consumer_complaint_narrative, '\S+')) AS INTEGER) AS narrative_word_count
FROM complaints
WHERE regexp_matches(consumer_complaint_narrative, '\S')
  AND len(regexp_extract_all(consumer_complaint_narrative, '\S+')) >= 10"""
SQL["clustered"] = """
SELECT vec_id AS complaint_id, '2024-' || lpad(CAST(vec_id % 12 + 1 AS VARCHAR), 2, '0') AS window_id,
  CAST(label AS INTEGER) AS local_cluster, CAST(embedding AS DOUBLE[]) AS vector
FROM embeddings"""
SQL["clustered_texts"] = """
SELECT doc_id AS complaint_id, window_id, local_cluster, vector FROM documents
JOIN (SELECT * EXCLUDE complaint_id, row_number() OVER (ORDER BY complaint_id) - 1 AS place FROM clustered) v
  ON v.place = doc_id % (SELECT count(*) FROM clustered)"""
SQL["coords"] = """
SELECT complaint_id, window_id, local_cluster, generate_subscripts(vector, 1) AS dim, unnest(vector) AS x
FROM clustered"""
SQL["cents"] = """
SELECT window_id, local_cluster, CAST(max(n) AS BIGINT) AS members, list(c ORDER BY dim) AS centroid
FROM (SELECT window_id, local_cluster, dim, avg(x) AS c, count(*) AS n FROM coords GROUP BY 1, 2, 3)
GROUP BY 1, 2"""
SQL["cases"] = """
SELECT 'case-' || CAST(item_id AS VARCHAR) AS name, text AS product,
  strftime(DATE '2024-06-01' + to_months(CAST(item_id % 12 AS INTEGER)), '%Y-%m-%d') AS recognition_date,
  'benchmark passage' AS recognition_basis
FROM benchmark"""

NEEDS: dict[str, list[str]] = {
    "complaints": [],
    "panel": ["complaints"],
    "clustered": [],
    "clustered_texts": ["clustered"],
    "coords": ["clustered"],
    "cents": ["coords"],
    "cases": [],
}


def define(name: str, needs: list[str], sql: str) -> None:
    SQL[name], NEEDS[name] = sql, needs


def using(*names: str, select: str) -> str:
    """``select`` with the named views, and those they need, in front."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS[name]:
            add(needed)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    ctes = ",\n".join(f"{name} AS ({SQL[name]})" for name in order)
    return f"WITH RECURSIVE {ctes}\n{select}"


def quoted(values: list[str]) -> str:
    return _quoted(values)
