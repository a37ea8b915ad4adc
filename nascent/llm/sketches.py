"""Document fingerprints by threshold-scaled sketches; DataFrame functions only.

A fingerprint holds every hash of the text's word shingles that lies below a fixed share
of all hash values. A larger text has a larger fingerprint, so fingerprints of very
unequal texts still tell how much of one is in the other, and that of two texts together
is their union, cut at the same threshold. Where no hash is below it, the smallest one is
kept, so that a short text is told from another and from an empty one.

Likeness is the containment in the smaller fingerprint: shared hashes over its size.

Defined results: a null or empty text, or one of white space, has the empty fingerprint;
two empty ones are alike (1), an empty one and another are not (0); fewer words than the
shingle are one shingle; repeated rows have equal results; of several rows with one id,
the one of the smallest text hash stands as the next document; rows with a null id have no
next document and are none; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nascent.functions.vectors import let
from nascent.llm.common import clean_text
from nascent.operators.numbering import number_rows

WORDS = r"[\x20\x09-\x0D]+"
SHARE = 1 / 8


def below(share: float) -> int:
    """The signed 64-bit number that ``share`` of all hashes lie below."""
    return int(share * 2.0**64) - 2**63


def shingle_hashes(text: Column, width: int = 5) -> Column:
    """64-bit hashes of all word shingles; words are hashed once and shingles from them."""
    words = F.filter(F.split(text, WORDS), lambda w: w != "")

    def of_words(hashed: Column) -> Column:
        def shingle(word: Column, i: Column) -> Column:
            return F.xxhash64(word, *(F.get(hashed, i + k) for k in range(1, width)))

        whole = F.transform(F.slice(hashed, 1, F.greatest(F.size(hashed) - width + 1, F.lit(0))), shingle)
        short = F.array(F.xxhash64(hashed))
        return F.when(F.size(hashed) >= width, whole).when(F.size(hashed) > 0, short).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_words)


def sketch(text: Column, width: int = 5, share: float = SHARE) -> Column:
    """The sorted hashes below the threshold, or the smallest one."""

    def keep(hashes: Column) -> Column:
        kept = F.filter(hashes, lambda h: h < F.lit(below(share)))
        least = F.filter(F.array(F.array_min(hashes)), lambda h: h.isNotNull())
        return F.array_sort(F.array_distinct(F.when(F.size(kept) > 0, kept).otherwise(least)))

    return let(shingle_hashes(text, width), keep)


def merged(left: Column, right: Column, share: float = SHARE) -> Column:
    """The sketch of two texts together, from theirs."""

    def keep(both: Column) -> Column:
        kept = F.filter(both, lambda h: h < F.lit(below(share)))
        return F.when(F.size(kept) > 0, kept).otherwise(F.slice(both, 1, 1))

    return let(F.array_sort(F.array_union(left, right)), keep)


def contained(part: Column, whole: Column) -> Column:
    """Share of the hashes of ``part`` that ``whole`` has; two empty sketches contain each other."""
    shared = F.size(F.array_intersect(part, whole)) / F.size(part)
    return F.when(F.size(part) > 0, shared).otherwise((F.size(whole) == 0).cast("double"))


def likeness(left: Column, right: Column) -> Column:
    """Containment in the smaller sketch; 0 if just one is empty."""
    least = F.least(F.size(left), F.size(right))
    shared = F.size(F.array_intersect(left, right)) / least
    return F.when(least > 0, shared).otherwise((F.size(left) == F.size(right)).cast("double"))


def as_text(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), " ")


def next_ids(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, next_id)`` in falling order of distinct ids; after the last comes the first.

    Only ids are sorted, by range; each meets its neighbour by number.
    """
    ids = docs.select(id_col).where(F.col(id_col).isNotNull()).distinct()
    numbered = number_rows(ids, [F.desc(id_col)], "__n")
    total = numbered.agg(F.count("*")).first()[0]
    following = F.pmod(F.col("__n") - 1, F.lit(max(total, 1)))
    return numbered.join(numbered.select(F.col(id_col).alias("next_id"), following.alias("__n")), "__n").select(id_col, "next_id")


def with_edits(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, share: float = SHARE
) -> DataFrame:
    """``(id, n_chars, edited, sketch, edited_sketch, next_sketch)``, one row per row of ``docs``.

    The edited text is the text with its last third replaced by the beginning of the next
    document. Texts are shuffled once, by id; from the next document only as much travels
    as is used, and its sketch.
    """
    every = docs.select(F.col(id_col), clean_text(text_col).alias("__text"))
    # Both joins read this very table, so that its shuffle is made once.
    texts = every.where(F.col(id_col).isNotNull())
    order = next_ids(docs, id_col)
    needed = texts.groupBy(id_col).agg(F.max(F.floor(F.length("__text") / 3)).alias("__need"))
    wanted = order.join(needed, id_col).select(F.col("next_id").alias(id_col), F.col(id_col).alias("__for"), "__need")
    sent = texts.join(wanted, id_col).select(
        F.col("__for").alias(id_col),
        F.xxhash64("__text").alias("__hash"),
        F.struct(
            F.substring("__text", F.lit(1), F.col("__need").cast("int")).alias("begin"),
            sketch(F.col("__text"), width, share).alias("sketch"),
        ).alias("__next"),
    )
    first = Window.partitionBy(id_col).orderBy("__hash")
    sent = sent.withColumn("__row", F.row_number().over(first)).where("__row = 1").select(id_col, "__next")
    joined = texts.join(sent, id_col, "left")
    single = every.where(F.col(id_col).isNull())
    joined = joined.unionByName(single.withColumn("__next", F.lit(None).cast(sent.schema["__next"].dataType)))
    length = F.length("__text")
    third = F.floor(length / 3).cast("int")
    begin = F.coalesce(F.substring("__next.begin", F.lit(1), third), F.lit(""))
    edited = F.concat(F.substring("__text", F.lit(1), length - third), begin)
    return joined.select(id_col, "__text", "__next", edited.alias("edited")).select(
        id_col,
        length.cast("bigint").alias("n_chars"),
        "edited",
        sketch(F.col("__text"), width, share).alias("sketch"),
        sketch(F.col("edited"), width, share).alias("edited_sketch"),
        F.col("__next.sketch").alias("next_sketch"),
    )
