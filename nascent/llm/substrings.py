"""Removal of repeated word windows with a count-min prefilter.

Documents are dealt into chunks of bounded text. Each chunk sketches its windows: every
window has one cell per row of a count-min sketch whose width follows the corpus. The
sketch is cut into blocks of cells; a chunk sends each block the cells it touches, and the
block adds up the chunks, counting no further than two. A cell then tells at least how
often its windows occur, never less, so no repeated window is lost.

A block answers every chunk with one bit per cell sent. Only windows with all their cells
at two or more go on to the second pass, which groups them exactly by a 96-bit hash of
their words and answers with one bit again: whether a chunk's smallest id for the window
is larger than the smallest of all. Chunks send each cell and each window once, however
often it repeats inside, so a passage that a third of the documents share costs no more
than one row entry per chunk. Nothing is ever collected per window.

Defined results: a null or empty text has no words; texts below the window's length keep
all; rows that repeat an id are one document, so a window found only in them stays; rows
with a null id take no part and stay whole; extra columns are kept, those named as an
output are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS = 2  # rows of the sketch
WIDTH = 8  # cells per window in each row
BLOCK_ENTRIES = 1_000_000
CHUNK_CHARS = (1_500_000, 12_000_000)
OUTPUTS = ("n_words", "n_removed", "kept_text")
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


class _WordHashes(dict):
    """64-bit hash of each distinct word of a chunk."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Windows:
    """The words of a chunk and the hashes of its windows."""

    def __init__(self, ids: list, texts: list[str | None], window: int):
        hashes = _WordHashes()
        self.words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
        self.sizes = np.fromiter(map(len, self.words), dtype=np.int64, count=len(texts))
        total = int(self.sizes.sum())
        every = map(hashes.__getitem__, chain.from_iterable(self.words))
        flat = np.fromiter(every, dtype=np.uint64, count=total)
        known = np.fromiter((i is not None for i in ids), dtype=bool, count=len(ids))
        owner = np.repeat(np.arange(len(ids)), self.sizes)
        ends = np.repeat(np.cumsum(self.sizes), self.sizes)
        self.at = np.flatnonzero((np.arange(total) + window <= ends) & known[owner]) if total else np.zeros(0, np.int64)
        number = np.array([0 if i is None else int(i) for i in ids], dtype=np.int64)
        self.docs = number[owner[self.at]]
        self.owner, self.window = owner, window
        low = np.zeros(len(self.at), dtype=np.uint64)
        high = np.zeros(len(self.at), dtype=np.uint64)
        for k in range(window):
            word = flat[self.at + k]
            low = _mixed(low * np.uint64(MULTIPLIERS[0]) + word)
            high = _mixed((high ^ word) * np.uint64(MULTIPLIERS[1]) + np.uint64(k + 1))
        self.low, self.high = low, high & np.uint64(0xFFFFFFFF)

    def cells(self, row: int, blocks: int, width: int) -> np.ndarray:
        """Cell of every window in a row of the sketch, as block * width + place."""
        h = _mixed(self.low * np.uint64(MULTIPLIERS[2]) + np.uint64(row + 1)) if row else self.low
        return ((h >> np.uint64(11)) % np.uint64(blocks * width)).astype(np.int64)

    def distinct(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of the given windows by hash and id, and the starts of equal ones in it."""
        order = places[np.lexsort((self.docs[places], self.high[places], self.low[places]))]
        low, high = self.low[order], self.high[order]
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        return order, np.flatnonzero(fresh)


def _planes(numbers: np.ndarray, size: int) -> bytes:
    """Little-endian numbers, all lowest bytes first: equal high bytes compress away."""
    return numbers.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T.tobytes()


def _numbers(raw: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(raw, dtype=np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{size}").ravel()


def _chunk_of(table: pa.Table, id_col: str, text_col: str, window: int) -> Windows:
    return Windows(table[id_col].to_pylist(), table[text_col].to_pylist(), window)


def _sketch(chunk: Windows, blocks: int, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row and block, the distinct cells touched, rising; keyed row * blocks + block."""
    for row in range(ROWS):
        cells = np.sort(chunk.cells(row, blocks, width))
        cells = cells[np.append(True, cells[1:] != cells[:-1])[: len(cells)]]
        borders = np.searchsorted(cells, np.arange(blocks + 1) * width)
        for block in np.flatnonzero(np.diff(borders)):
            yield row * blocks + int(block), cells[borders[block] : borders[block + 1]] - block * width


def _estimated_repeated(chunk: Windows, blocks: int, width: int, answers: dict[int, bytes]) -> np.ndarray:
    """Places of the windows whose least cell counts two or more."""
    repeated = np.ones(len(chunk.at), dtype=bool)
    for row in range(ROWS):
        cells, back, times = np.unique(chunk.cells(row, blocks, width), return_inverse=True, return_counts=True)
        borders = np.searchsorted(cells, np.arange(blocks + 1) * width)
        twice = times > 1
        for block in np.flatnonzero(np.diff(borders)):
            part = slice(borders[block], borders[block + 1])
            raw = np.frombuffer(answers[row * blocks + int(block)], dtype=np.uint8)
            twice[part] |= np.unpackbits(raw, count=part.stop - part.start).astype(bool)
        repeated &= twice[back]
    return np.flatnonzero(repeated)


def _second_pass(chunk: Windows, places: np.ndarray, blocks: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Block, order and starts of the distinct windows to be grouped exactly."""
    home = (chunk.low[places] % np.uint64(blocks)).astype(np.int64)
    by_home = np.argsort(home, kind="stable")
    borders = np.searchsorted(home[by_home], np.arange(blocks + 1))
    for block in np.flatnonzero(np.diff(borders)):
        order, starts = chunk.distinct(places[by_home[borders[block] : borders[block + 1]]])
        yield int(block), order, starts


MESSAGE = "__block int, __chunk int, __data binary"
ANSWER = "__chunk int, __block int, __data binary"


def _table(schema: str, *columns: list) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(fields, columns, strict=True)})


def repeated_windows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept_text`` (UTF-8 bytes).

    A word goes if a window over it also starts in a document with a smaller id. Kept
    words are joined by one space.
    """
    spark = docs.sparkSession
    kept = docs.drop(*OUTPUTS)
    chars = kept.agg(F.sum(F.length(text_col).cast("bigint")).alias("n")).first()["n"] or 0
    each = int(min(CHUNK_CHARS[1], CHUNK_CHARS[0] * max(1.0, (chars / 1e9) ** 0.5)))
    chunks = max(1, -(-chars // each))
    # A window starts at a word, and words take two characters with their space.
    entries = max(1, chars // 5)
    blocks = max(1, -(-entries // BLOCK_ENTRIES))
    width = WIDTH * (-(-entries // blocks))

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(chunks, 20_000))
    # Windows are compared by id, wherever their rows are, so rows of one id, or without any, spread.
    chunk = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(chunks)).cast("int")
    dealt = kept.withColumn("__chunk", chunk).repartition(parts, "__chunk")
    slim = dealt.select("__chunk", id_col, text_col)

    def sketch(key: tuple, table: pa.Table) -> pa.Table:
        found = list(_sketch(_chunk_of(table, id_col, text_col, window), blocks, width))
        cells = [_planes(np.diff(c, prepend=0), 4) for _, c in found]
        return _table(MESSAGE, [b for b, _ in found], [key[0].as_py()] * len(found), cells)

    def add_up(key: tuple, table: pa.Table) -> pa.Table:
        once, twice = np.zeros(width, dtype=bool), np.zeros(width, dtype=bool)
        parts = [np.cumsum(_numbers(raw, 4)) for raw in table["__data"].to_pylist()]
        for cells in parts:
            twice[cells] |= once[cells]
            once[cells] = True
        bits = [np.packbits(twice[cells]).tobytes() for cells in parts]
        return _table(ANSWER, table["__chunk"].to_pylist(), [key[0].as_py()] * len(bits), bits)

    def ask(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        one = _chunk_of(table, id_col, text_col, window)
        places = _estimated_repeated(one, blocks, width, _answers(answers, 0))
        rows = []
        for block, order, starts in _second_pass(one, places, blocks):
            first = order[starts]
            hashed = _planes(one.low[first], 8) + _planes(one.high[first], 4)
            rows.append((block, hashed + _planes(one.docs[first].view(np.uint64), 8)))
        return _table(MESSAGE, [r[0] for r in rows], [key[0].as_py()] * len(rows), [r[1] for r in rows])

    def least_id(key: tuple, table: pa.Table) -> pa.Table:
        raw = table["__data"].to_pylist()
        sizes = [len(r) // 20 for r in raw]
        low = np.concatenate([_numbers(r[: 8 * n], 8) for r, n in zip(raw, sizes, strict=True)])
        high = np.concatenate([_numbers(r[8 * n : 12 * n], 4) for r, n in zip(raw, sizes, strict=True)])
        ids = np.concatenate([_numbers(r[12 * n :], 8).view(np.int64) for r, n in zip(raw, sizes, strict=True)])
        order = np.lexsort((ids, high, low))
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
        starts = np.flatnonzero(fresh)
        least = np.empty(len(order), dtype=np.int64)
        least[order] = np.repeat(ids[order][starts], np.diff(np.append(starts, len(order))))
        later = np.split(least < ids, np.cumsum(sizes)[:-1])
        bits = [np.packbits(part).tobytes() for part in later]
        return _table(ANSWER, table["__chunk"].to_pylist(), [key[0].as_py()] * len(bits), bits)

    def remove(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        one = _chunk_of(table, id_col, text_col, window)
        places = _estimated_repeated(one, blocks, width, _answers(answers, 0))
        later, gone = _answers(answers, 1), np.zeros(len(one.owner) + 1, dtype=np.int64)
        for block, order, starts in _second_pass(one, places, blocks):
            elsewhere = np.unpackbits(np.frombuffer(later[block], dtype=np.uint8), count=len(starts)).astype(bool)
            runs = np.diff(np.append(starts, len(order)))
            repeat = np.repeat(elsewhere, runs) | (one.docs[order] > np.repeat(one.docs[order[starts]], runs))
            begin = one.at[order[repeat]]
            np.add.at(gone, begin, 1)
            np.add.at(gone, begin + window, -1)
        covered = np.cumsum(gone[:-1]) > 0
        ends = np.cumsum(one.sizes)
        removed, texts = [], []
        for words, end, size in zip(one.words, ends.tolist(), one.sizes.tolist(), strict=True):
            mask = covered[end - size : end]
            count = int(mask.sum())
            removed.append(count)
            left = [words[i] for i in np.flatnonzero(~mask)] if count else words
            texts.append(b" ".join(left))
        out = table.drop_columns(["__chunk"])
        out = out.append_column("n_words", pa.array(one.sizes, pa.int64()))
        out = out.append_column("n_removed", pa.array(removed, pa.int64()))
        return out.append_column("kept_text", pa.array(texts, pa.binary()))

    sketched = slim.groupBy("__chunk").applyInArrow(sketch, MESSAGE)
    counted = sketched.groupBy("__block").applyInArrow(add_up, ANSWER).withColumn("__pass", F.lit(0))
    asked = slim.groupBy("__chunk").cogroup(counted.groupBy("__chunk")).applyInArrow(ask, MESSAGE)
    exact = asked.groupBy("__block").applyInArrow(least_id, ANSWER).withColumn("__pass", F.lit(1))
    answers = counted.unionByName(exact)
    fields = [*kept.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.BinaryType())]
    return dealt.groupBy("__chunk").cogroup(answers.groupBy("__chunk")).applyInArrow(remove, T.StructType(fields))


def _answers(table: pa.Table, number: int) -> dict[int, bytes]:
    rows = zip(table["__pass"].to_pylist(), table["__block"].to_pylist(), table["__data"].to_pylist(), strict=True)
    return {block: data for pass_number, block, data in rows if pass_number == number}


def kept_or_whole(text: Column, removed: Column, kept: Column) -> Column:
    """The text after removal; a text that lost nothing stays as it was."""
    return F.when(removed > 0, kept.cast("string")).otherwise(text)
