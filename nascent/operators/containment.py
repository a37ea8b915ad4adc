"""Which patterns stand inside which texts, by an index of their four-letter pieces.

A pattern is cut into pieces of four characters, one after another, the last one ending
where the pattern ends; shorter patterns are one piece. Patterns that are small together are
broadcast: a task looks up the pieces at all places of its texts in their index, and a pattern
whose pieces all are in a text is looked for there, so a text gives rows for the patterns in it
only. Larger sets of patterns meet the texts' pieces by an equality join, and a pattern stands
where all its pieces do. Texts are not shuffled and no text is held against a pattern it shares
no piece with.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nascent.functions.rows import explode_once
from nascent.session import attach_small, settle

PIECE = 4
# Broadcast size of the patterns, of which a task holds an index about ten times as large.
INDEX_LIMIT_BYTES = 4 * 1024 * 1024
_STRIDE = 1 << 20
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def pieces_at(text: Column, size: int) -> Column:
    """The ``size`` characters from every place of a text on."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{size}}}))."), F.lit(1))


def pattern_pieces(patterns: DataFrame, pattern: str) -> DataFrame:
    """``(pattern, size, needed, offset, piece)`` of every different pattern that is not empty."""
    known = patterns.select(F.col(pattern).alias("pattern")).where(F.length("pattern") > 0).distinct()
    size = F.least(F.length("pattern"), F.lit(PIECE))
    last = F.length("pattern") - size
    offsets = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(PIECE)), F.array(last)))
    cut = known.select("pattern", size.alias("size"), F.size(offsets).alias("needed"), F.explode(offsets).alias("offset"))
    return cut.withColumn("piece", F.substring(F.col("pattern"), F.col("offset") + 1, F.col("size")))


class PieceIndex:
    """The pieces of some patterns, by hash, for one task."""

    def __init__(self, patterns: list[str]) -> None:
        self.patterns = patterns
        places: dict[tuple[int, str], list[int]] = {}
        for number, pattern in enumerate(patterns):
            size = min(PIECE, len(pattern))
            for offset in {*range(0, len(pattern) - size + 1, PIECE), len(pattern) - size}:
                places.setdefault((size, pattern[offset : offset + size]), []).append(number)
        self.needed = np.zeros(len(patterns), dtype=np.int64)
        self.sizes = []
        for size in sorted({size for size, _ in places}):
            pieces = [(piece, sorted(set(of))) for (s, piece), of in places.items() if s == size]
            hashes = _hashes(_code_points("".join(piece for piece, _ in pieces)), size)[::size]
            order = np.argsort(hashes, kind="stable")
            owners = [np.array(pieces[i][1], dtype=np.int64) for i in order]
            for of in owners:
                self.needed[of] += 1
            starts = np.concatenate([[0], np.cumsum([len(of) for of in owners])])
            # Most places of a text have none of the pieces; a bit per hash prefix tells so.
            maybe = np.zeros(1 << 16, dtype=bool)
            maybe[hashes >> np.uint64(48)] = True
            self.sizes.append((size, hashes[order], maybe, starts, np.concatenate(owners)))

    def find(self, texts: list[str | None]) -> list[list[str] | None]:
        """The patterns in each text; None without any."""
        found: list[list[str] | None] = [None] * len(texts)
        first = 0
        while first < len(texts):
            last, length = first, 0
            while last < len(texts) and (last == first or length < _STRIDE):
                length += len(texts[last] or "")
                last += 1
            self._find(texts, first, last, found)
            first = last
        return found

    def _find(self, texts: list[str | None], first: int, last: int, found: list[list[str] | None]) -> None:
        some = [text or "" for text in texts[first:last]]
        points = _code_points("".join(some))
        ends = np.cumsum([len(text) for text in some])
        pairs = []
        for size, hashes, maybe, starts, owners in self.sizes:
            if len(points) < size:
                continue
            here = _hashes(points, size)
            at = np.flatnonzero(maybe[here >> np.uint64(48)])
            here = here[at]
            low, high = np.searchsorted(hashes, here, "left"), np.searchsorted(hashes, here, "right")
            hit = high > low
            text = np.searchsorted(ends, at[hit], "right")
            # A piece of a text counts once; pieces over the end of a text are found out below.
            piece = np.unique(text * (len(hashes) + 1) + low[hit])
            text, low = np.divmod(piece, len(hashes) + 1)
            high = np.searchsorted(hashes, hashes[low], "right")
            counts = starts[high] - starts[low]
            within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            pairs.append(np.repeat(text, counts) * len(self.patterns) + owners[np.repeat(starts[low], counts) + within])
        if not pairs:
            return
        pair, n = np.unique(np.concatenate(pairs), return_counts=True)
        whole = pair[n >= self.needed[pair % len(self.patterns)]]
        for row, number in zip((whole // len(self.patterns)).tolist(), (whole % len(self.patterns)).tolist(), strict=True):
            pattern = self.patterns[number]
            if pattern in some[row]:
                if found[first + row] is None:
                    found[first + row] = []
                found[first + row].append(pattern)


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _hashes(points: np.ndarray, size: int) -> np.ndarray:
    """A number for the ``size`` characters from every place on."""
    n = max(0, len(points) - size + 1)
    total = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        total += (points[i : i + n].astype(np.uint64) + np.uint64(1)) * _MIX[i]
    return (total ^ (total >> np.uint64(29))) * _MIX[0]


def contained(
    texts: DataFrame, key: str, text: Column, patterns: DataFrame, pattern: str, limit_bytes: int = INDEX_LIMIT_BYTES
) -> DataFrame:
    """``(key, pattern)`` once for every pattern that stands in a text of a key.

    Null texts and patterns and empty patterns give no row.
    """
    known = settle(patterns.select(F.col(pattern).alias("pattern")).where(F.length("pattern") > 0).distinct())
    size = known.agg(F.sum(F.octet_length("pattern") + 32)).first()[0] or 0
    if size > limit_bytes:
        return _contained_by_join(texts, key, text, known)
    sent = texts.sparkSession.sparkContext.broadcast(sorted(r[0] for r in known.collect()))

    @F.arrow_udf("array<string>")
    def inside(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = PieceIndex(sent.value)
        for column in columns:
            yield pa.array(index.find(column.to_pylist()), type=pa.list_(pa.string()))

    return explode_once(texts, [key], inside(text), "pattern").distinct()


def _contained_by_join(texts: DataFrame, key: str, text: Column, known: DataFrame) -> DataFrame:
    pieces = settle(pattern_pieces(known, "pattern"))
    sizes = sorted(r[0] for r in pieces.select("size").distinct().collect()) or [PIECE]
    # Texts may share a key, and pieces of different texts make no pattern.
    told = texts.select(F.col(key), text.alias("_text")).withColumn("_whole", F.unhex(F.md5("_text")))
    placed = [told.select(key, "_whole", F.posexplode(pieces_at(F.col("_text"), size)).alias("place", "piece")) for size in sizes]
    rows = reduce(DataFrame.unionByName, placed)
    met = attach_small(rows, pieces.drop("size"), ["piece"], spread="_whole", row_bytes=128)
    start = (F.col("place") - F.col("offset")).alias("start")
    # Texts may be equal; a piece of each counts once.
    whole = met.groupBy(key, "_whole", "pattern", "needed", start).agg(F.count_distinct("offset").alias("n")).where("n = needed")
    return whole.select(key, "pattern").distinct()
