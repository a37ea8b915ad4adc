"""Cluster labels from text: TF-IDF terms, frequent words and their coherence."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nascent.functions import text
from nascent.functions.rows import explode_once
from nascent.operators.panel import ID
from nascent.operators.topk import top_per_group
from nascent.session import attach_small, settle

# Common English function words; replace through the parameter.
ENGLISH_STOP_WORDS = [
    "about", "above", "after", "again", "against", "all", "am", "an", "and", "any", "are", "as",
    "at", "be", "because", "been", "before", "being", "below", "between", "both", "but", "by",
    "can", "could", "did", "do", "does", "doing", "down", "during", "each", "few", "for", "from",
    "further", "had", "has", "have", "having", "he", "her", "here", "hers", "herself", "him",
    "himself", "his", "how", "if", "in", "into", "is", "it", "its", "itself", "just", "me",
    "more", "most", "my", "myself", "no", "nor", "not", "now", "of", "off", "on", "once", "only",
    "or", "other", "our", "ours", "ourselves", "out", "over", "own", "same", "she", "should",
    "so", "some", "such", "than", "that", "the", "their", "theirs", "them", "themselves", "then",
    "there", "these", "they", "this", "those", "through", "to", "too", "under", "until", "up",
    "very", "was", "we", "were", "what", "when", "where", "which", "while", "who", "whom", "why",
    "will", "with", "would", "you", "your", "yours", "yourself", "yourselves",
]

# Stop words of the dashboard export.
DOMAIN_STOP_WORDS = [
    "xxxx", "xx", "xxx", "xxxx xxxx", "xxxxxxxx", "xxxxxx", "xx xx", "xxxx xxxxxxxx",
    "the", "and", "to", "of", "in", "for", "is", "on", "that", "by", "this", "with",
    "i", "you", "it", "not", "or", "be", "are", "from", "at", "as", "your", "all",
    "have", "new", "more", "an", "was", "we", "will", "my", "me", "our", "us",
    "consumer", "complaint", "received", "stated", "company", "information",
]
# Keywords of a cluster without any.
DEFAULT_KEYWORDS = ["dispute", "account", "inquiry"]
# Terms of a vocabulary that are broadcast, and those that are scored before it is known which others matter.
COMMON_TERMS = 400_000
FIRST_TERMS = 4_000
# Tokens of rows that are counted together.
COUNTED_TOKENS = 1 << 18


def counted_rows(docs: DataFrame, tokens: Column, carry: list[str], pairs: bool = False) -> DataFrame:
    """``(carry..., _t)``: the sorted terms of each row with their counts, null without any; no shuffle.

    With ``pairs``, adjacent tokens are terms as well.
    """
    rows = docs.select(*carry, tokens.alias("_t"))
    counts = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())]))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("_t", counts)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.fill_null(pc.list_value_length(batch.columns[-1]), 0).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.diff((np.cumsum(lengths) - lengths) // COUNTED_TOKENS, prepend=-1))
            for start, end in zip(starts, [*starts[1:], len(lengths)], strict=True):
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], text.counted_lists(part.columns[-1], pairs)], names=batch.schema.names)

    return rows.mapInArrow(work, schema)


def counted_terms(docs: DataFrame, tokens: Column, carry: list[str], id_column: str = ID) -> DataFrame:
    """``(id, carry..., term, tf)``: counted inside each row, so no shuffle."""
    keep = list(dict.fromkeys([id_column, *carry]))
    exploded = explode_once(counted_rows(docs, tokens, keep), keep, F.col("_t"), "_t")
    return exploded.select(*keep, "_t.term", "_t.tf")


def tfidf_scores(
    docs: DataFrame,
    group: str,
    tokens: Column,
    features: int | None = None,
    idf_over: str = "corpus",
    combine: str = "sum",
    id_column: str = ID,
    best: int | None = None,
    without: list[str] | None = None,
    pairs: bool = False,
) -> DataFrame:
    """``(group, term, score)``: smoothed TF-IDF, each document scaled to unit length.

    The vocabulary is every term, or the ``features`` most frequent ones. The document
    frequencies are taken over the whole corpus or over each group, as ``idf_over``
    says. ``combine`` adds the weights up per group or averages them over all of the
    group's documents. With ``pairs``, adjacent tokens are terms as well.

    With ``best``, terms that cannot be among that many best ones of their group, those
    ``without`` set aside, may be missing: a document adds at most one to a term's sum, so
    a term in fewer documents than the sum of the last of the best is none of them.
    """
    scope = [group] if idf_over == "group" else []
    on, carry = [*scope, "term"], list(dict.fromkeys([id_column, group]))
    # Read several times, so that texts are cut into terms once.
    counted = settle(counted_rows(docs, tokens, carry, pairs))
    words = explode_once(counted, carry, F.col("_t"), "_t").select(*carry, "_t.term", "_t.tf")
    df = F.count("*").alias("df")
    vocabulary = words.groupBy(*on).agg(df, *([F.sum("tf").alias("total")] if features is not None else []))
    if features is not None:
        order = [F.desc("total"), F.col("term")]
        if scope:
            vocabulary = top_per_group(vocabulary, scope, order, features, spread="term").drop("rank")
        else:
            vocabulary = vocabulary.orderBy(*order).limit(features)
    sizes = settle(counted.groupBy(group).agg(F.count("*").alias("n")))
    whole = None if scope else counted.count()

    def with_idf(found: DataFrame) -> DataFrame:
        found = attach_small(found, sizes, [group], spread="term") if scope else found.withColumn("n", F.lit(whole))
        return found.withColumn("idf", F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).drop("n")

    vocabulary = settle(with_idf(vocabulary).select(*on, "df", "idf"))
    steps = _frequency_steps(vocabulary)
    many = _least_frequency(steps, COMMON_TERMS)
    few = _least_frequency(steps, FIRST_TERMS)
    every = _weighted(words, vocabulary, on, many) if features is not None else _all_weighted(words, vocabulary, on, many, with_idf)
    squares = every.select(id_column, (F.col("w") * F.col("w")).alias("w"))
    norms = settle(squares.groupBy(F.col(id_column).alias("_id")).agg(F.sqrt(F.sum("w")).alias("_norm")))

    def scored(rows: DataFrame) -> DataFrame:
        scaled = rows.join(norms, F.col(id_column).eqNullSafe(F.col("_id")))
        found = scaled.groupBy(group, "term").agg(F.sum(F.col("w") / F.col("_norm")).alias("score"))
        if combine != "mean":
            return found
        each = attach_small(found, sizes, [group], spread="term")
        return each.select(group, "term", (F.col("score") / F.col("n")).alias("score"))

    if best is None:
        return scored(_weighted(words, vocabulary, on, many))
    first = settle(scored(_weighted(words, vocabulary.where(F.col("df") >= few), on, few)))
    ranked = top_per_group(first.where(~F.col("term").isin(*(without or [""]))), [group], [F.desc("score")], best, spread="term")
    unit = F.col("n") if combine == "mean" else F.lit(1)
    # Scores are ranked by six digits; what is left of the sum then is more for sure.
    least = F.floor((F.col("score") - 2e-6) * unit)
    last = ranked.where(F.col("rank") == best).select(group, "score")
    cuts = attach_small(sizes, last, [group], spread=group, how="left", null_safe=True)
    cuts = settle(cuts.select(group, F.coalesce(least, F.lit(0)).alias("_cut")).where(F.col("_cut") < few))
    lowest = cuts.agg(F.min("_cut")).first()[0]
    if lowest is None:
        return first
    left = vocabulary.where((F.col("df") < few) & (F.col("df") >= lowest))
    own = attach_small(words, cuts, [group], spread=id_column, null_safe=True)
    more = _weighted(own, left, on, many, F.col("_cut"))
    return first.unionByName(scored(more.select(*carry, "term", "w")))


def _frequency_steps(vocabulary: DataFrame) -> list[tuple[int, int]]:
    """How many terms have which document frequency, by powers of two, the largest first."""
    step = F.floor(F.log2("df")).cast("int").alias("step")
    return sorted(((r["step"], r["n"]) for r in vocabulary.groupBy(step).agg(F.count("*").alias("n")).collect()), reverse=True)


def _least_frequency(steps: list[tuple[int, int]], most: int) -> int:
    """The smallest power of two that no more than ``most`` terms reach with their frequency."""
    kept, least = 0, (1 << steps[0][0] + 1) if steps else 1
    for step, n in steps:
        kept += n
        if kept > most:
            break
        least = 1 << step
    return least


def _weighted(rows: DataFrame, vocabulary: DataFrame, on: list[str], least: int, cut: Column | None = None) -> DataFrame:
    """``rows`` with ``w``, their ``tf`` by the idf of their term; terms not in the vocabulary go.

    Most rows have one of the terms in at least ``least`` documents, which are few enough to
    broadcast; only the others are shuffled. With a ``cut``, terms in fewer documents go.
    """
    known = vocabulary.select(*on, "df", "idf")
    common = known.where(F.col("df") >= least)
    near = rows.join(F.broadcast(common), on)
    if least > 1:
        others = rows if cut is None else rows.where(cut < least)
        far = others.join(F.broadcast(common.select(*on)), on, "left_anti").join(known.where(F.col("df") < least), on)
        near = near.unionByName(far)
    if cut is not None:
        near = near.where(F.col("df") >= cut)
    return near.withColumn("w", F.col("tf") * F.col("idf"))


def _all_weighted(
    rows: DataFrame, vocabulary: DataFrame, on: list[str], least: int, with_idf: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """``_weighted`` by a vocabulary that has every term of ``rows``.

    Rows of rarer terms are counted again where they meet, so the vocabulary, most of which
    are terms of one document, is neither shuffled nor sorted.
    """
    common = vocabulary.select(*on, "idf").where(F.col("df") >= least)
    found = rows.join(F.broadcast(common), on)
    if least > 1:
        # Hashes differ in their first bytes, terms often do not; so they come first in the sort.
        others = rows.join(F.broadcast(common.select(*on)), on, "left_anti").repartition(*on).withColumn("_hash", F.xxhash64("term"))
        far = others.withColumn("df", F.count("*").over(Window.partitionBy("_hash", *on)))
        found = found.unionByName(with_idf(far).select(*found.columns))
    return found.withColumn("w", F.col("tf") * F.col("idf"))


def top_terms(
    docs: DataFrame,
    group: str,
    narrative: Column,
    k: int = 6,
    stop_words: list[str] | None = None,
    features: int | None = None,
    id_column: str = ID,
) -> DataFrame:
    """``(group, term, score, rank)``: the ``k`` terms with the largest TF-IDF sum."""
    stops = ENGLISH_STOP_WORDS if stop_words is None else stop_words
    scores = tfidf_scores(
        docs, group, text.terms(narrative, stops), features, "group", "sum", id_column, best=k
    ).withColumn("score", F.round("score", 6))
    return top_per_group(scores, [group], [F.desc("score"), F.col("term")], k, spread="term")


def export_keywords(
    docs: DataFrame,
    group: str,
    narrative: Column,
    k: int = 4,
    features: int | None = None,
    id_column: str = ID,
) -> DataFrame:
    """``(group, term, score, rank)`` over words and word pairs, by mean TF-IDF.

    Domain stop words are dropped before the ranking. A group left without any term is
    absent.
    """
    tokens = text.latin_words(text.drop_masked(narrative), DOMAIN_STOP_WORDS)
    scores = tfidf_scores(
        docs, group, tokens, features, "corpus", "mean", id_column, best=k, without=DOMAIN_STOP_WORDS, pairs=True
    ).withColumn("score", F.round("score", 6))
    scores = scores.where(~F.col("term").isin(*DOMAIN_STOP_WORDS))
    return top_per_group(scores, [group], [F.desc("score"), F.col("term")], k, spread="term")


def frequent_words(
    docs: DataFrame, group: str, narrative: Column, k: int = 6, longer_than: int = 4, id_column: str = ID
) -> DataFrame:
    """``(group, term, n, rank)``: plain counts of the longer tokens."""
    tokens = F.filter(text.space_tokens(narrative), lambda t: F.length(t) > longer_than)
    counts = (
        counted_terms(docs, tokens, [group], id_column).groupBy(group, "term").agg(F.sum("tf").alias("n"))
    )
    return top_per_group(counts, [group], [F.desc("n"), F.col("term")], k, spread="term")


def npmi(
    docs: DataFrame,
    topics: DataFrame,
    topic: str,
    tokens: Column,
    id_column: str = ID,
) -> DataFrame:
    """``(topic, pairs, coherence)``: mean normalised PMI of each topic's term pairs.

    Co-occurrence is counted over all documents. ``topics`` holds ``(topic, term)``,
    a handful of terms each, so the pairs of one document stay a handful too.
    """
    topics = settle(topics.select(topic, "term"))
    pairs = (
        topics.groupBy(topic)
        .agg(F.sort_array(F.collect_set("term")).alias("terms"))
        .select(topic, F.explode(_pairs(F.col("terms"))).alias("p"))
        .select(topic, "p.a", "p.b")
    )
    present = explode_once(docs, [id_column], F.array_distinct(tokens), "term")
    hits = attach_small(present, topics.select(topic, "term"), ["term"], spread=id_column)
    singles = hits.groupBy("term").agg(F.countDistinct(id_column).alias("n"))
    together = (
        hits.groupBy(id_column, topic)
        .agg(F.sort_array(F.collect_set("term")).alias("terms"))
        .select(topic, F.explode(_pairs(F.col("terms"))).alias("p"))
        .groupBy(topic, "p.a", "p.b")
        .agg(F.count("*").alias("n_ab"))
    )
    n_docs = docs.agg(F.count("*").alias("n_docs"), F.lit(1).alias("_one"))
    scored = (
        pairs.join(together, [topic, "a", "b"], "left")
        .join(singles.select(F.col("term").alias("a"), F.col("n").alias("n_a")), "a")
        .join(singles.select(F.col("term").alias("b"), F.col("n").alias("n_b")), "b")
        .withColumn("_one", F.lit(1))
        .join(n_docs, "_one")
    )
    p_ab = F.col("n_ab") / F.col("n_docs")
    value = (
        F.when(F.col("n_ab").isNull(), -1.0)
        .when(F.col("n_ab") == F.col("n_docs"), 1.0)
        .otherwise(
            F.log(F.col("n_ab") * F.col("n_docs") / (F.col("n_a") * F.col("n_b"))) / -F.log(p_ab)
        )
    )
    return scored.groupBy(topic).agg(
        F.count("*").alias("pairs"), F.round(F.avg(value), 6).alias("coherence")
    )


def _pairs(terms: Column) -> Column:
    """All ordered pairs of a short sorted array."""
    return F.flatten(
        F.transform(
            terms,
            lambda a: F.transform(
                F.filter(terms, lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b"))
            ),
        )
    )
