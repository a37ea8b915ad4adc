"""Encoding against tiktoken, packing against tokenizers and its own rules."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from nascent.llm import bpe, packing, queries

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
FILE = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def plain():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    dice = random.Random(2)
    return [
        None,
        "",
        " ",
        "\n\n  two  spaces\t\n",
        "don't we'll 123456 !!! <|endoftext|>",
        "日本語 🎉🎉 ñandú",
        "a" * 3_000,
        "ab" * 150 + "x",
        "".join(dice.choice("abcdef") for _ in range(4_000)),
        "".join(dice.choice("etaoin shrdlu ETAOIN,.\n") for _ in range(20_000)),
        "same",
        "same",
    ]


def test_ids_and_their_bytes(spark, plain):
    texts = odd_texts()
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("ids", F.lit("own"))
    encoded = bpe.encode(rows, RANKS, PATTERN)
    back = encoded.withColumn("bytes", bpe.decode_column(F.col("ids"), RANKS)).collect()
    assert len(back) == len(texts)
    for r in back:
        assert r.ids == plain.encode_ordinary(texts[r.doc_id] or "")
        assert bytes(r.bytes) == (texts[r.doc_id] or "").encode()
    assert bpe.encode(rows.limit(0), RANKS, PATTERN).count() == 0


def test_any_byte_string_merges_as_the_library_does(plain):
    words, dice = bpe.vocabulary(RANKS), random.Random(8)
    pieces = [bytes(dice.choice(b"abc \xff\xc3e") for _ in range(n)) for n in range(1, 320) for _ in range(2)]
    for piece, ids in zip(pieces, words.encode_pieces(pieces), strict=True):
        ids = np.frombuffer(ids, dtype=np.int32)
        assert ids.tolist() == plain._encode_single_piece(piece)
        assert words.decode(ids) == piece


def test_bpe_query_on_the_whole_table(spark, data, plain):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = queries.QUERIES["op5_bpe"](spark, data).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids = plain.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def gapless(rows, most):
    """Every sequence is filled from 0 without gaps and not beyond ``most``."""
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= most
    return len(sequences)


def test_packing_query_on_the_whole_table(spark, data):
    library = Tokenizer.from_file(FILE)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = queries.QUERIES["op10_packing"](spark, data).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert sorted(by_doc) == sorted(texts)
    for doc_id, parts in by_doc.items():
        ids = [*library.encode(texts[doc_id], add_special_tokens=False).ids, 2]
        parts.sort(key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts)))
        assert sum(r.length for r in parts) == len(ids)
        assert all(r.length == 1024 for r in parts[1:])
        for r in parts:
            raw = np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(raw)
    count = gapless(rows, 1024)
    assert count <= 1.01 * sum(r.length for r in rows) / 1024 + 1


def test_ids_of_odd_texts_are_those_of_the_library(spark):
    library, texts = Tokenizer.from_file(FILE), odd_texts()
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("piece", F.lit("own"))
    got = packing.pieces(rows, FILE, PATTERN, with_ids=True).orderBy("doc_id", "piece").collect()
    for i, text in enumerate(texts):
        ids = [n for r in got if r.doc_id == i for n in r.ids]
        assert ids == [*library.encode(text or "", add_special_tokens=False).ids, 2]
    packed = packing.pack_documents(rows, FILE, PATTERN)
    gapless(packed.collect(), 1024)
    assert packing.pack_documents(rows.limit(0), FILE, PATTERN).count() == 0


def test_null_ids_and_repeated_rows_are_packed(spark):
    rows = spark.createDataFrame([(None, "a b"), (3, "a b"), (3, "a b"), (None, None)], "doc_id bigint, text string")
    got = packing.pack_documents(rows, FILE, PATTERN, max_tokens=4).collect()
    assert sorted((r.doc_id or -1, r.length) for r in got) == [(-1, 1), (-1, 3), (3, 3), (3, 3)]
    assert gapless(got, 4) == 3


@pytest.mark.parametrize("seed", range(4))
def test_moves_are_best_fit(seed):
    """The moves place as many sequences as best fit of one piece after another, longest first."""
    dice = random.Random(seed)
    lengths = [dice.choice([dice.randint(1, 64), dice.randint(20, 40), 64]) for _ in range(400)]
    counts = {n: lengths.count(n) for n in set(lengths)}
    moves = packing.plan_moves(counts, 64)
    filled = {}
    ranks = {n: [] for n in counts}
    for length, rank, many, first, offset in moves:
        ranks[length] += range(rank, rank + many)
        for k in range(many):
            filled.setdefault(first + k, []).append((offset, length))
    assert all(sorted(r) == list(range(counts[n])) for n, r in ranks.items())
    for parts in filled.values():
        assert sum(n for _, n in parts) <= 64
        assert [o for o, _ in sorted(parts)] == list(np.cumsum([0, *(n for _, n in sorted(parts))])[:-1])
    gaps = []
    for length in sorted(lengths, reverse=True):
        fitting = [g for g in gaps if g >= length]
        if fitting:
            gaps.remove(min(fitting))
            gaps.append(min(fitting) - length)
        else:
            gaps.append(64 - length)
    assert len(filled) <= len(gaps)


def test_cut():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)]
    assert packing.cut(8, 4) == [(0, 4), (4, 4)]
    assert packing.cut(3, 4) == [(0, 3)]
