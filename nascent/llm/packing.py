"""Best-fit packing of token pieces into sequences of bounded length.

Bulk-synchronous best fit: pieces are range-sorted by falling length and gaps by size.
In each round the pieces of one length look for their successor, the smallest gap that
holds them; where more pieces want a size of gap than there are gaps, rank decides, and
the others go on to the next size; the gaps shrink and the next round begins. Pieces
without any gap open sequences, each as full as it gets.

Pieces of equal length and gaps of equal size are interchangeable, so a round moves rank
ranges, not rows: what the rounds read and write is one counter per length and the ranges
of sequences per gap size. Their number is bounded by ``max_tokens``, whatever the number
of documents, and the rounds need no job each. One range sort gives every piece its rank
within its length, and a join with the bounded table of moves gives its place.

Defined results: a null or empty text is one piece, its end token; repeated rows are
packed each for itself; ties of length go by id, piece and checksum; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nascent.llm.common import bounded_batches, clean_text
from nascent.operators.numbering import number_rows
from nascent.session import settle

PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint"


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> tiktoken.Encoding:
    """The byte-level BPE of a tokenizer file, with its added tokens.

    The ids are those that the tokenizers library gives for the same file, which tests
    compare; this encoder needs a quarter of the time.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    # Byte-level files write each byte as a printable character: the printable ones stand
    # for themselves, the others follow from 256 on.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    vocab = spec["model"]["vocab"]
    ranks = {bytes(byte_of[c] for c in word): i for word, i in vocab.items() if word not in added}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)


def cut(total: int, most: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of ``total`` ids; only the first may be shorter."""
    first = total % most or most
    return [(0, first), *((start, most) for start in range(first, total, most))]


def pieces(
    docs: DataFrame,
    path: str,
    pattern: str,
    max_tokens: int = 1024,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """``(id, piece, start, length, ids_crc32[, ids])`` of every document; no shuffle."""
    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    ids_kind = ", ids array<int>" if with_ids else ""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = encoder(path, pattern)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch[id_col], batch["text"], strict=True):
                ids = np.append(tokens.encode_to_numpy(text, allowed_special="all"), end_id)
                ids = ids.astype("<u4")
                for number, (start, length) in enumerate(cut(len(ids), max_tokens)):
                    part = ids[start : start + length]
                    row = (doc_id, number, start, length, zlib.crc32(part.tobytes()))
                    rows.append((*row, part.astype(np.int32)) if with_ids else row)
            names = [id_col, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
            frame = pd.DataFrame(rows, columns=names)
            # An id column with nulls arrives as float; give it back as it came.
            frame[id_col] = frame[id_col].astype("Int64") if kind in ("bigint", "int") else frame[id_col]
            yield frame

    rows = docs.select(F.col(id_col), clean_text(text_col).alias("text"))
    return rows.mapInPandas(split, f"{id_col} {kind}, {PIECES}{ids_kind}")


def plan_moves(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Moves ``(length, first rank, pieces, first sequence, offset)`` for counts per length.

    A move puts that many pieces, by rank, into as many consecutive sequences. The state
    is the ranges of sequences per gap size; a round splits at most one of them.
    """
    gaps: dict[int, deque[tuple[int, int]]] = defaultdict(deque)
    sizes: set[int] = set()
    moves, opened = [], 0
    for length in sorted((n for n in counts if counts[n]), reverse=True):
        rank, left = 0, counts[length]
        while left and (fitting := [g for g in sizes if g >= length]):
            gap = min(fitting)  # the successor of this length among the gaps
            first, many = gaps[gap].popleft()
            taken = min(left, many)
            if taken < many:
                gaps[gap].appendleft((first + taken, many - taken))
            moves.append((length, rank, taken, first, capacity - gap))
            rank, left = rank + taken, left - taken
            if not gaps[gap]:
                sizes.discard(gap)
            if gap > length:
                gaps[gap - length].append((first, taken))
                sizes.add(gap - length)
        each = capacity // length
        for filled, many in ((each, left // each), (left % each, 1)):
            if not filled or not many:
                continue
            for k in range(filled):
                moves.append((length, rank, many, opened, k * length))
                rank += many
            if rest := capacity - filled * length:
                gaps[rest].append((opened, many))
                sizes.add(rest)
            opened += many
    return moves


def pack(cut_pieces: DataFrame, max_tokens: int = 1024, id_col: str = "doc_id") -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces of at most ``max_tokens``.

    ``cut_pieces`` needs id, piece and length; it is sorted by range once, its texts and
    ids should be left out before.
    """
    spark = cut_pieces.sparkSession
    order = [F.desc("length"), *(c for c in (id_col, "piece", "ids_crc32") if c in cut_pieces.columns)]
    placed = number_rows(cut_pieces, order, "__place")
    counts = {r["length"]: r["n"] for r in placed.groupBy("length").agg(F.count("*").alias("n")).collect()}
    starts, total = {}, 0
    for length in sorted(counts, reverse=True):
        starts[length], total = total, total + counts[length]
    moves = [(n, starts[n] + rank, starts[n] + rank + many, first, offset) for n, rank, many, first, offset in plan_moves(counts, max_tokens)]
    schema = "length bigint, __low bigint, __high bigint, __first bigint, offset bigint"
    table = F.broadcast(spark.createDataFrame(moves, schema))  # bounded by max_tokens
    within = (F.col("__place") >= F.col("__low")) & (F.col("__place") < F.col("__high"))
    sequence = F.col("__first") + F.col("__place") - F.col("__low")
    return (
        placed.join(table, "length")
        .where(within)
        .withColumn("sequence_id", sequence)
        .select(*cut_pieces.columns, "sequence_id", "offset")
    )


def pack_documents(docs: DataFrame, path: str, pattern: str, max_tokens: int = 1024, end_id: int = 2) -> DataFrame:
    """Tokenise, cut and pack whole documents."""
    return pack(settle(pieces(docs, path, pattern, max_tokens, end_id)), max_tokens)
