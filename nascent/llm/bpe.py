"""Byte-level BPE on padded numpy matrices.

Each distinct piece of text is one row of a matrix of token ids, padded on the right;
rows of similar length share a matrix. In each round every row merges its leftmost pair
of lowest rank: the ranks of all neighbouring pairs are looked up in an open-addressing
hash table, the row's tail moves one place left, and only the two new pairs are looked up
again. Rows without a known pair are done and leave the matrix.

A piece longer than ``LONG`` bytes would need a round per byte. It gets the same merges in
the same order from a heap.

Defined results: a null or empty text gives no ids; text of any length is encoded whole;
repeated rows give repeated results; extra columns are ignored; an empty table gives an
empty result; bytes that are no UTF-8 after decoding stay bytes.
"""

from __future__ import annotations

import base64
import sys
from collections.abc import Iterable
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nascent.llm.common import bounded_batches, clean_text

NO_RANK = np.int32(2**31 - 1)
LONG = 192
CELLS = 1 << 17
CACHED_PIECES = 250_000


class PairTable:
    """Ranks of mergeable pairs in an open-addressing hash table with linear probing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(rank)) * 4))))
        self.shift = np.uint64(64 - bits)
        self.mask = np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << bits, NO_RANK, dtype=np.int32)
        keys = (left.astype(np.int64) << 32) | right
        waiting, slots = np.arange(len(keys)), self._slots(keys)
        while len(waiting):
            _, first = np.unique(slots, return_index=True)
            free = first[self.keys[slots[first]] == -1]
            self.keys[slots[free]] = keys[waiting[free]]
            self.ranks[slots[free]] = rank[waiting[free]]
            left_over = np.ones(len(waiting), dtype=bool)
            left_over[free] = False
            waiting, slots = waiting[left_over], (slots[left_over] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of every pair, ``NO_RANK`` for unknown pairs and padding (-1)."""
        keys = (left.astype(np.int64) << 32) | right
        slots = self._slots(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.ranks[slots], NO_RANK)
        missed = np.flatnonzero(((found != keys) & (found != -1)).ravel())
        flat, keys, slots = out.reshape(-1), keys.ravel(), slots.ravel()
        while len(missed):
            slots[missed] = (slots[missed] + 1) & self.mask
            found = self.keys[slots[missed]]
            hit = found == keys[missed]
            flat[missed[hit]] = self.ranks[slots[missed[hit]]]
            missed = missed[~hit & (found != -1)]
        return np.where((left < 0) | (right < 0), NO_RANK, flat.reshape(out.shape))


class Vocabulary:
    """Token bytes by id, byte ids and the pair table of a rank file."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            self.rank = {base64.b64decode(token): int(number) for token, number in pairs}
        self.byte_ids = np.array([self.rank[bytes([b])] for b in range(256)], dtype=np.int32)
        found = [
            (self.rank[token[:cut]], self.rank[token[cut:]], number)
            for token, number in self.rank.items()
            for cut in range(1, len(token))
            if token[:cut] in self.rank and token[cut:] in self.rank
        ]
        left, right, rank = (np.array(c, dtype=np.int64) for c in zip(*found, strict=True))
        self.pairs = PairTable(left, right, rank.astype(np.int32))
        size = max(self.rank.values()) + 1
        self.lengths = np.zeros(size, dtype=np.int64)
        for token, number in self.rank.items():
            self.lengths[number] = len(token)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        joined = np.zeros(int(self.lengths.sum()), dtype=np.uint8)
        for token, number in self.rank.items():
            at = self.starts[number]
            joined[at : at + len(token)] = np.frombuffer(token, dtype=np.uint8)
        self.joined = joined

    def encode_pieces(self, pieces: Iterable[bytes]) -> list[bytes]:
        """The token ids of every piece as 32-bit numbers; a piece that is a token is that token."""
        pieces = list(pieces)
        out = [b""] * len(pieces)
        rows = []
        for i, piece in enumerate(pieces):
            whole = self.rank.get(piece)
            if whole is not None:
                out[i] = whole.to_bytes(4, sys.byteorder)
            elif piece:
                rows.append(i)
        rows.sort(key=lambda i: len(pieces[i]))
        at = 0
        while at < len(rows):
            width = len(pieces[rows[at]])
            # Rows up to twice as long as the first share the matrix, within a number of cells.
            end, widest = at, width
            while end < len(rows):
                longer = len(pieces[rows[end]])
                if longer > max(8, 2 * width) or (longer > LONG >= width) or (end > at and (end - at + 1) * longer > CELLS):
                    break
                widest, end = longer, end + 1
            batch = rows[at:end]
            if width > LONG:
                for i in batch:
                    out[i] = self._merge_long(pieces[i])
            else:
                for i, ids in zip(batch, self._merge_rows([pieces[i] for i in batch], widest), strict=True):
                    out[i] = ids
            at = end
        return out

    def _merge_rows(self, pieces: list[bytes], width: int) -> list[bytes]:
        n = len(pieces)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8)
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=n)
        columns = np.arange(width)
        ids = np.where(columns < sizes[:, None], self.byte_ids[raw.reshape(n, width)], -1)
        ids = np.ascontiguousarray(ids.T, dtype=np.int32)  # a line per column of the rows
        # ranks[j] belongs to the pair (j, j + 1); the last line has no pair.
        ranks = np.full(ids.shape, NO_RANK, dtype=np.int32)
        ranks[:-1] = self.pairs.find(ids[:-1], ids[1:])
        place, out = np.arange(n), [b""] * n
        while len(place):
            # The first column with the lowest rank; columns lie one after another in memory.
            lowest = ranks.min(axis=0)
            open_rows = lowest != NO_RANK
            if not open_rows.all():
                done = ids[:, ~open_rows].T
                kept = done >= 0
                flat = done[kept].tobytes()
                ends = (np.cumsum(kept.sum(axis=1)) * 4).tolist()
                for row, start, end in zip(place[~open_rows].tolist(), [0, *ends], ends):  # noqa: B905
                    out[row] = flat[start:end]
                ids, ranks = ids[:, open_rows], ranks[:, open_rows]
                place, lowest = place[open_rows], lowest[open_rows]
                if not len(place):
                    break
            best = (ranks == lowest).argmax(axis=0)
            here = np.arange(len(place))
            # Compaction: the columns after the merged pair move one place left.
            stays = np.arange(len(ids) - 1)[:, None] <= best
            ids = np.where(stays, ids[:-1], ids[1:])
            ranks = np.where(stays, ranks[:-1], ranks[1:])
            ids[best, here] = lowest
            after = np.where(best + 1 < len(ids), ids[np.minimum(best + 1, len(ids) - 1), here], -1)
            ranks[best, here] = self.pairs.find(lowest, after)
            inner = np.flatnonzero(best > 0)
            at = best[inner]
            ranks[at - 1, inner] = self.pairs.find(ids[at - 1, inner], ids[at, inner])
        return out

    def _merge_long(self, piece: bytes) -> bytes:
        """The same merges for one very long piece: a heap of (rank, place) and links between
        the tokens left, so the time is in proportion to n log n instead of n squared."""
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        rank = self.rank.get
        heap = [(r, i, parts[i] + parts[i + 1]) for i in range(len(parts) - 1) if (r := rank(parts[i] + parts[i + 1])) is not None]
        heapify(heap)
        while heap:
            _, i, merged = heappop(heap)
            if parts[i] is None or (j := after[i]) == len(parts) or parts[i] + parts[j] != merged:
                continue  # one of the two has been merged meanwhile
            parts[i], parts[j], after[i] = merged, None, after[j]
            if (k := after[i]) < len(parts):
                before[k] = i
                if (r := rank(merged + parts[k])) is not None:
                    heappush(heap, (r, i, merged + parts[k]))
            if (h := before[i]) >= 0 and (r := rank(parts[h] + merged)) is not None:
                heappush(heap, (r, h, parts[h] + merged))
        return np.array([self.rank[p] for p in parts if p is not None], dtype=np.int32).tobytes()

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ends):
            return b""
        shift = np.repeat(self.starts[ids] - (ends - lengths), lengths)
        return self.joined[shift + np.arange(ends[-1])].tobytes()


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, read once per Python worker."""
    return Vocabulary(path)


def encode_column(text: Column, path: str, pattern: str) -> Column:
    """Token ids of a text column; pieces seen before are remembered within a bound."""
    splitter = regex.compile(pattern)
    known: dict[str, bytes] = {}

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        words = vocabulary(path)
        if len(known) > CACHED_PIECES:
            known.clear()
        split = [splitter.findall(t) for t in texts]
        new = list(set().union(*map(set, split)).difference(known)) if split else []
        ids = words.encode_pieces(p.encode("utf-8", "surrogatepass") for p in new)
        known.update(zip(new, ids, strict=True))
        joined = (b"".join(map(known.__getitem__, pieces)) for pieces in split)
        return pd.Series([np.frombuffer(j, dtype=np.int32) for j in joined])

    return encode(text)


def decode_column(ids: Column, path: str) -> Column:
    """The bytes of a column of token ids."""

    @F.pandas_udf("binary")
    def decode(rows: pd.Series) -> pd.Series:
        words = vocabulary(path)
        return pd.Series([words.decode(np.asarray(row, dtype=np.int64)) for row in rows])

    return decode(ids)


def encode(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, ids array<int>)``, one row per row of ``docs``; no shuffle."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col), encode_column(clean_text(text_col), path, pattern).alias("ids"))
