"""From raw documents to packed training sequences, in stages that are written between."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nascent.llm import packing, sanitise, simhash, substrings, toxicity
from nascent.llm.common import table
from nascent.session import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

TOXIC_FROM = 0.3
SHINGLE_WORDS, MOST_BITS = 4, 4
MAX_TOKENS = 1024


def plain(docs: DataFrame) -> DataFrame:
    """Id, text and, as one struct, the other columns, so that no name meets those of an operator."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", *([F.struct(*others).alias("others")] if others else []))


def like(docs: DataFrame, changed: DataFrame, new_text: bool = True) -> DataFrame:
    """``changed`` with the columns of ``docs`` again; with a new text, ``n_chars`` is its length."""

    def column(name: str) -> Column:
        if name in ("doc_id", "text"):
            return F.col(name)
        if new_text and name == "n_chars":
            return F.length("text").cast(docs.schema["n_chars"].dataType).alias(name)
        return F.col("others").getField(name).alias(name)

    return changed.select(*[column(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below ``TOXIC_FROM``.

    All labels teach. Null texts count as empty, and a null or repeated id teaches as the
    operator states; every row is scored on its own, so repeated rows go or stay together.
    Other columns are kept as they are, whatever their names. An empty table stays empty.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.train(docs.select("doc_id", "text"), labels)
    return docs.where(toxicity.score_column(model, F.col("text")) < TOXIC_FROM)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by SimHash, the one with the smallest id.

    Fingerprints of four-word shingles link at four or fewer differing bits. Texts without
    words, null ones too, share a fingerprint and are one group. Where rows repeat the
    smallest id, the first by a hash of id and text stays; of equal rows one stays. Groups in
    which no row has an id keep their first row likewise. Other columns are kept as they are,
    whatever their names. An empty table stays empty.
    """
    groups = simhash.near_duplicates(docs.select("doc_id", "text"), width=SHINGLE_WORDS, radius=MOST_BITS)
    # Groups without an id are told apart by their fingerprints.
    group = [F.col("component"), F.when(F.col("component").isNull(), F.col("fp")).alias("print")]
    rows = groups.select(*group, "doc_id", "row_key").groupBy("component", "print", "doc_id", "row_key")
    rows = rows.agg(F.count("*").alias("rows"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key", "rows")
    first = rows.groupBy("component", "print").agg(F.min(order).alias("first"))
    kept = first.select(F.col("first.row_key").alias("key"), F.col("first.rows").alias("rows"))
    joined = plain(docs).withColumn("key", simhash.row_key("doc_id", "text")).join(kept, "key")
    single, equal = joined.where("rows = 1"), joined.where("rows > 1").dropDuplicates(["key"])
    return like(docs, single.unionByName(equal), new_text=False)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows that start in an earlier document go; untouched texts stay as they are.

    Null texts stay null, and rows without an id neither lose words nor make others lose them.
    Rows with one id do not cut each other. Other columns are kept, whatever their names, but
    ``n_chars`` follows the text. An empty table stays empty.
    """
    cut = substrings.repeated_windows(plain(docs))
    text = substrings.kept_or_whole(F.col("text"), F.col("n_removed"), F.col("kept_text"))
    return like(docs, cut.withColumn("text", text))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms are masked in every text.

    Null texts become empty; equal texts get equal masks whatever their ids. Other columns are
    kept, whatever their names, but ``n_chars`` follows the text. An empty table stays empty.
    """
    return like(docs, sanitise.mask_documents(plain(docs)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of at most ``MAX_TOKENS`` tokens.

    A null or empty text is one piece with the end mark alone; repeated rows are documents of
    their own; columns beside id and text are left out. An empty table gives no piece.
    """
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN, MAX_TOKENS)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_copies", keep_one_of_near_copies),
    ("repeats", cut_repeats),
    ("personal_data", mask_personal_data),
    ("packing", pack_sequences),
]

#: The stages train a classifier and hash, which SQL cannot repeat; tests hold brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
