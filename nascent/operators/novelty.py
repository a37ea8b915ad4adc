"""Novelty of a narrative against the known clusters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nascent.functions import text
from nascent.functions.vectors import let
from nascent.operators.containment import contained
from nascent.operators.numbering import number_rows
from nascent.operators.panel import ID, NARRATIVE
from nascent.session import attach_small, settle

# Words that always make a narrative novel.
EMERGING_TERMS = [
    "deepfake", "voice", "clone", "crypto", "bitcoin", "kiosk", "unhosted", "wallet", "synthetic", "ai",
]
# Words and keywords of a newly spawned cluster.
SPAWN_STOP_WORDS = ["received", "phone", "stated", "company", "account"]
SPAWN_KEYWORDS = ["emergent", "fraud", "anomaly"]
NOVEL_AT = 0.55
SPAWN_WORDS = 4
_LETTER = r"[\p{L}\p{N}_]"
# A text up to its fourth word that can be a keyword, or up to the last of fewer ones.
_HEAD = (
    rf"(?s)^(?>.*?(?<!{_LETTER})(?!(?:{'|'.join(SPAWN_STOP_WORDS)})(?!{_LETTER}))[a-zA-Z]{{5,}}+(?!{_LETTER})){{1,{SPAWN_WORDS}}}+"
)


def _emerging(low: Column) -> Column:
    """Whether one of the emerging terms is a word of a lowercase text; null without a text.

    Only texts that seem to have one are cut into words: a look behind sees half of a letter
    beyond the basic plane.
    """
    seems = [F.contains(low, F.lit(t)) & low.rlike(rf"{t}(?<!{_LETTER}{t})(?!{_LETTER})") for t in EMERGING_TERMS]
    tokens = F.regexp_extract_all(low, F.lit(text.WORD), F.lit(0))
    return reduce(Column.__or__, seems) & F.arrays_overlap(tokens, F.array(*[F.lit(t) for t in EMERGING_TERMS]))


def _picked(low: Column) -> Column:
    """The first four words of a lowercase text that can be keywords; null without any."""
    words = text.latin_words(F.regexp_substr(low, F.lit(_HEAD)))
    return F.slice(F.filter(words, lambda w: (F.length(w) > 4) & ~w.isin(*SPAWN_STOP_WORDS)), 1, SPAWN_WORDS)


def _prepared(texts: DataFrame, category: str, id_column: str) -> DataFrame:
    named = F.coalesce(category, F.lit(""))
    rows = texts.select(F.col(id_column), F.col(NARRATIVE), named.alias("category"))
    # Equal texts of one category share what they hit.
    key = F.unhex(F.md5(F.concat_ws("\u0000", "category", F.coalesce(NARRATIVE, F.lit("")))))
    return rows.withColumn("_key", key).withColumn("_low", F.lower(NARRATIVE))


def keyword_hits(texts: DataFrame, clusters: DataFrame) -> DataFrame:
    """``(_key, _rank, score)`` for every text and cluster with something in common.

    ``texts`` are prepared, ``clusters`` ranked. Keywords and labels are found by equality
    joins with the texts' words and pieces, categories with the labels' pieces, so rows grow
    with what is found and never with texts times clusters.
    """
    keywords = clusters.select("_rank", F.explode("keywords").alias("pattern"))
    keywords = keywords.select("_rank", F.lower("pattern").alias("pattern"))
    keywords = settle(keywords.groupBy("_rank", "pattern").agg(F.count("*").alias("times")))
    labels = settle(clusters.select("_rank", F.lower("label").alias("pattern")))
    patterns = keywords.select("pattern").unionByName(labels.select("pattern")).distinct()
    inside = settle(contained(texts, "_key", F.col("_low"), patterns, "pattern"))
    words = texts.select("_key", F.explode(F.array_distinct(text.latin_words(F.col(NARRATIVE)))).alias("pattern"))
    exact = attach_small(words, keywords.select("pattern").distinct(), ["pattern"], spread="_key", row_bytes=64)
    worth = inside.withColumn("worth", F.lit(1.5)).unionByName(exact.withColumn("worth", F.lit(3.0)))
    worth = worth.groupBy("_key", "pattern").agg(F.max("worth").alias("worth"))
    by_word = attach_small(worth, keywords, ["pattern"], spread="_key", row_bytes=64).select(
        "_key", "_rank", (F.col("worth") * F.col("times")).alias("words"), F.lit(0.0).alias("named")
    )
    by_label = attach_small(inside, labels, ["pattern"], spread="_key", row_bytes=64)
    categories = texts.select("_key", F.lower("category").alias("pattern")).where("pattern != ''").distinct()
    holding = contained(labels.withColumnRenamed("pattern", "label"), "_rank", F.col("label"), categories, "pattern")
    by_category = attach_small(categories, holding, ["pattern"], spread="_key", row_bytes=64)
    named = by_label.select("_key", "_rank").unionByName(by_category.select("_key", "_rank"))
    named = named.select("_key", "_rank", F.lit(0.0).alias("words"), F.lit(5.0).alias("named"))
    found = by_word.unionByName(named).groupBy("_key", "_rank")
    return found.agg((F.sum("words") + F.max("named")).alias("score"))


def _scored(texts: DataFrame, clusters: DataFrame, n: int, category: str, id_column: str) -> tuple[DataFrame, DataFrame]:
    """Texts with their ``n`` most probable clusters by rank, and the ranked clusters.

    A cluster without a hit weighs one; only how many there are enters the sum, and only the
    first of them by id can be among the most probable ones.
    """
    ranked = settle(number_rows(clusters.select("id", "label", "keywords"), ["id", "label"], "_rank"))
    known = ranked.count()
    prepared = _prepared(texts, category, id_column)
    hits = keyword_hits(prepared, ranked).withColumn("w", F.exp(F.least(F.lit(8.0), F.col("score") * 0.7)))
    listed = hits.groupBy("_key").agg(
        F.sort_array(F.collect_list(F.struct("_rank", "w"))).alias("_hits"), F.max("score").alias("_best")
    )
    slim = prepared.select(
        id_column, "category", "_key",
        F.coalesce(_emerging(F.col("_low")), F.lit(False)).alias("has_emerging_term"),
        F.coalesce(_picked(F.col("_low")), F.array().cast("array<string>")).alias("_picked"),
    )
    none = F.array().cast("array<struct<_rank:bigint,w:double>>")
    joined = slim.join(listed, "_key", "left").withColumn("_hits", F.coalesce("_hits", none))
    others = F.lit(float(known)) - F.size("_hits")
    whole = F.aggregate("_hits", others, lambda acc, hit: acc + hit["w"])
    chance = lambda w, all_weights, rank: F.struct((-F.round(w / all_weights, 3)).alias("minus"), rank.alias("_rank"))
    places = F.sequence(F.lit(0).cast("long"), F.size("_hits") + F.lit(n - 1).cast("long"))
    free = F.filter(F.array_except(places, F.transform("_hits", lambda hit: hit["_rank"])), lambda rank: rank < known)
    tops = let(
        whole,
        lambda total: F.sort_array(
            F.concat(
                F.transform("_hits", lambda hit: chance(hit["w"], total, hit["_rank"])),
                F.transform(free, lambda rank: chance(F.lit(1.0), total, rank)),
            )
        ),
    )
    return joined.withColumn("_tops", F.slice(tops, 1, n)), ranked.select("_rank", "id", "label")


def score_novelty(
    texts: DataFrame,
    clusters: DataFrame,
    threshold: float = NOVEL_AT,
    category: str = "category",
    id_column: str = ID,
) -> DataFrame:
    """The cluster each text goes to and the novelty decision.

    ``clusters`` has ``(id, label, keywords)``. Without any cluster, texts have none and are
    judged by their terms alone. The confidence is counted in thousandths, halves of a
    hundredth upwards. A null text is one without words; empty keywords and labels match
    nothing.
    """
    scored, ranked = _scored(texts, clusters, 1, category, id_column)
    best_score = F.coalesce("_best", F.lit(0.0))
    novelty = (
        F.when(F.col("has_emerging_term"), 0.88)
        .when(best_score >= 3.0, F.greatest(F.lit(0.12), F.round(1.0 - best_score / (best_score + 4.0), 3)))
        .otherwise(0.65)
    )
    spawn = F.when(F.size("_picked") > 0, F.col("_picked")).otherwise(F.array(*[F.lit(k) for k in SPAWN_KEYWORDS]))
    best = F.get("_tops", F.lit(0))
    found = scored.select(
        id_column, best["_rank"].alias("_rank"), (-best["minus"]).alias("probability"), novelty.alias("novelty_score"),
        "has_emerging_term", spawn.alias("spawn_keywords"), "category",
    )
    thousandths = F.least(F.lit(980), F.round(F.col("probability") * 1000).cast("int") + 450)
    joined = attach_small(found, ranked, ["_rank"], spread=id_column, how="left", row_bytes=128)
    return joined.select(
        id_column,
        F.col("id").alias("assigned_cluster"),
        F.col("label").alias("assigned_label"),
        "probability",
        "novelty_score",
        (F.col("novelty_score") >= threshold).alias("is_novel"),
        (F.floor((thousandths + 5) / 10) / 100).alias("familiar_confidence"),
        "has_emerging_term",
        "spawn_keywords",
        "category",
    )


def top_assignments(
    texts: DataFrame, clusters: DataFrame, n: int = 3, category: str = "category", id_column: str = ID
) -> DataFrame:
    """``(id, place, cluster, probability)``: the most probable clusters of each text."""
    scored, ranked = _scored(texts, clusters, n, category, id_column)
    rows = scored.select(id_column, F.posexplode("_tops").alias("place", "a"))
    rows = rows.select(id_column, (F.col("place") + 1).alias("place"), F.col("a._rank").alias("_rank"), (-F.col("a.minus")).alias("probability"))
    joined = attach_small(rows, ranked, ["_rank"], spread=id_column, row_bytes=128)
    return joined.select(id_column, "place", F.col("id").alias("cluster"), "probability")
