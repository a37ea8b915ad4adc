"""Text expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from nascent.functions.vectors import let

# Masking patterns of the complaint corpus.
MASKED_TOKENS = r"(?i)\b(x{2,}|xx/\d{2}/\d{4}|\$[\d\.,]+)\b"
REDACTED_RUN = r"X{2,}"
REDACTED_MARK = "[Redacted]"

# Letter classes instead of word boundaries: these agree between Java, RE2 and
# Python on accented text.
TERM = r"[\p{L}\p{N}_]{2,}"
WORD = r"[\p{L}\p{N}_]+"
# A whole word of the kind above that has ASCII letters only.
LATIN_WORD = r"(?<![\p{L}\p{N}_])[a-zA-Z]{3,}+(?![\p{L}\p{N}_])"


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def word_count(text: Column, unicode_spaces: bool = False) -> Column:
    """Number of runs of non-space characters."""
    pattern = r"(?U)\S+" if unicode_spaces else r"\S+"
    return F.regexp_count(text, F.lit(pattern)).cast("int")


def has_words(text: Column, at_least: int) -> Column:
    """``word_count(text) >= at_least``, reading no further than the word that decides."""
    if at_least <= 0:
        return text.isNotNull()
    return text.rlike(r"^\s*+(?:\S++\s++){%d}\S" % (at_least - 1))


def is_present(text: Column, strict: bool = False) -> Column:
    """Not null and not blank; ``strict`` also rejects the literal ``nan``."""
    present = text.isNotNull() & text.rlike(r"\S")
    if strict:
        present = present & (F.lower(strip(text)) != "nan")
    return present


def title_case(text: Column) -> Column:
    """Capitalise after any non-letter, not only after white space."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, _capital), "")


def _capital(run: Column) -> Column:
    return F.concat(F.upper(run.substr(1, 1)), F.lower(run.substr(F.lit(2), F.length(run))))


def redact(text: Column) -> Column:
    return F.regexp_replace(text, REDACTED_RUN, REDACTED_MARK)


def drop_masked(text: Column) -> Column:
    return F.regexp_replace(text, MASKED_TOKENS, " ")


def snippet(text: Column, length: int) -> Column:
    """The first ``length`` characters, with an ellipsis where something was cut."""
    return F.when(
        F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))
    ).otherwise(text)


def enrich(issue: Column, narrative: Column) -> Column:
    """Text given to the encoder."""
    return F.concat(
        F.lit("Issue: "), F.coalesce(issue, F.lit("")), F.lit(". Narrative: "), narrative
    )


def enrich_for_evaluation(issue: Column, narrative: Column) -> Column:
    """Text used by the model comparison: both parts trimmed, default issue."""
    return F.concat(
        F.lit("Issue: "),
        strip(F.coalesce(issue, F.lit("General Inquiry"))),
        F.lit(". Narrative: "),
        strip(F.coalesce(narrative, F.lit(""))),
    )


def space_tokens(text: Column) -> Column:
    """Lowercase tokens between white space."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\S+"), F.lit(0))


def terms(text: Column, stop_words: list[str]) -> Column:
    """Lowercase terms of two or more word characters, stop words removed."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))
    return _without(found, stop_words)


def latin_words(text: Column, stop_words: list[str] | None = None) -> Column:
    """Lowercase ASCII words of three or more letters."""
    found = F.regexp_extract_all(F.lower(text), F.lit(LATIN_WORD), F.lit(0))
    return _without(found, stop_words or [])


def with_bigrams(words: Column) -> Column:
    """Words followed by their adjacent pairs."""
    return let(
        words,
        lambda w: F.when(
            F.size(w) > 1,
            F.concat(
                w,
                F.transform(
                    F.sequence(F.lit(1), F.size(w) - 1),
                    lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)),
                ),
            ),
        ).otherwise(w),
    )


def _without(words: Column, stop_words: list[str]) -> Column:
    if not stop_words:
        return words
    return F.filter(words, lambda word: ~word.isin(*stop_words))


def term_counts(tokens: Column) -> Column:
    """``array<struct<term, tf>>`` of one row's tokens, without leaving the row.

    Tokens are sorted and the runs of equal ones measured, so counting costs
    n log n per row and no shuffle.
    """

    def measure(ordered: Column) -> Column:
        first_of_run = F.filter(
            F.sequence(F.lit(1), F.size(ordered)),
            lambda i: (i == 1) | (F.get(ordered, i - 1) != F.get(ordered, i - 2)),
        )
        return let(
            first_of_run,
            lambda starts: F.transform(
                starts,
                lambda start, j: F.struct(
                    F.get(ordered, start - 1).alias("term"),
                    (F.coalesce(F.get(starts, j + 1), F.size(ordered) + 1) - start)
                    .cast("long")
                    .alias("tf"),
                ),
            ),
        )

    empty = F.lit(None).cast("array<struct<term:string,tf:bigint>>")
    return let(
        F.sort_array(tokens), lambda ordered: F.when(F.size(ordered) > 0, measure(ordered)).otherwise(empty)
    )


def counted_lists(column: pa.Array, pairs: bool = False) -> pa.Array:
    """The same as ``term_counts`` for a batch of rows at once, on the numbers of their different tokens.

    With ``pairs``, of the tokens ``with_bigrams``.
    """
    rows = len(column)
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    row, tokens = np.repeat(np.arange(rows, dtype=np.int64), lengths), column.flatten()
    if pairs:
        first = np.flatnonzero(row[1:] == row[:-1])
        both = pc.binary_join_element_wise(tokens.take(pa.array(first)), tokens.take(pa.array(first + 1)), " ")
        row, tokens = np.concatenate([row, row[first]]), pa.concat_arrays([tokens, both])
    coded = tokens.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy(zero_copy_only=False)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    many = max(1, len(order))
    keys = row * many + place[coded.indices.to_numpy(zero_copy_only=False)]
    keys, counts = np.unique(keys, return_counts=True)
    row, term = np.divmod(keys, many)
    sizes = np.bincount(row, minlength=rows)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    words = coded.dictionary.take(pa.array(order[term]))
    pairs = pa.StructArray.from_arrays([words, pa.array(counts.astype(np.int64))], ["term", "tf"])
    return pa.ListArray.from_arrays(offsets, pairs, mask=pa.array(sizes == 0))
