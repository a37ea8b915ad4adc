"""Raw complaint files and stored vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nascent.session import path_exists
from nascent.sources.quoted import read_quoted

CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "mode": "PERMISSIVE"}


def normal_name(name: str) -> str:
    """``Date received`` and ``date-received`` both become ``date_received``."""
    return name.strip().lower().replace(" ", "_").replace("-", "_")


def normal_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[normal_name(c) for c in df.columns])


def find_column(df: DataFrame, *fragments: str) -> str | None:
    """The column with exactly this normalised name, else the first containing every fragment."""
    wanted = normal_name(" ".join(fragments))
    for name in df.columns:
        if normal_name(name) == wanted:
            return name
    for name in df.columns:
        if all(f.lower() in name.lower() for f in fragments):
            return name
    return None


#: What the operators read, and fragments that find it under another name.
STANDARD_NAMES = {
    "complaint_id": ("complaint", "id"),
    "date_received": ("date", "received"),
    "consumer_complaint_narrative": ("narrative",),
    "product": ("product",),
    "issue": ("issue",),
    "sub_issue": ("sub", "issue"),
}


def standard_columns(df: DataFrame) -> DataFrame:
    """Rename columns found by their fragments to the names the operators read.

    A column with the right name is left alone, and no column is taken twice.
    """
    taken = {c for c in df.columns if c in STANDARD_NAMES}
    for name, fragments in STANDARD_NAMES.items():
        if name in taken:
            continue
        found = find_column(df.select(*[c for c in df.columns if c not in taken]), *fragments)
        if found is not None:
            df = df.withColumnRenamed(found, name)
            taken.add(name)
    return df


def read_complaints(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    """Complaint CSV files (plain, gzip or bzip2; a path, a glob or a list), all text.

    Only the header is looked at before the job: no type inference pass. Quoted narratives
    may hold line breaks; a large file is read by many tasks all the same (see
    :mod:`nascent.sources.quoted`). ``multi_line=False`` saves its first pass where there
    are no such breaks.
    """
    raw = read_quoted(spark, path) if multi_line else spark.read.options(**CSV_OPTIONS).csv(path)
    return standard_columns(normal_columns(raw))


def read_complaint_stream(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The same files as a stream. A stream needs its columns beforehand, in file order."""
    schema = ", ".join(f"`{normal_name(c)}` string" for c in columns)
    return spark.readStream.schema(schema).options(**CSV_OPTIONS, multiLine="true").csv(path)


def load_vectors(
    spark: SparkSession, path: str, make: Callable[[], DataFrame], refresh: bool = False
) -> DataFrame:
    """Stored vectors, computed with ``make`` and written first where they are missing."""
    if refresh or not path_exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def look_up_vectors(df: DataFrame, vectors: DataFrame, id_column: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their vector, and a one-row table counting the ids without one."""
    found = df.join(vectors, id_column)
    missing = df.join(vectors, id_column, "left_anti").agg(F.count("*").alias("missing"))
    return found, missing
