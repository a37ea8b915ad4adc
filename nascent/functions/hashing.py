"""Stable hashes: the same value on every engine, partitioning and run."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def rank_key(seed: int | str, key: Column) -> Column:
    """Pseudo-random hexadecimal key used wherever a random order is needed."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def token_hash(token: Column) -> Column:
    """32-bit unsigned hash of a token."""
    return F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("long")


def signed_buckets(tokens: Column, dim: int) -> Column:
    """One code per token: ``bucket * 2`` plus one where the sign is negative."""
    return F.transform(
        tokens,
        lambda t: (
            (token_hash(t) % dim) * 2 + token_hash(F.concat(F.lit("s:"), t)) % 2
        ).cast("int"),
    )


def blake_buckets(dim: int):
    """Arrow function giving the same codes from 64-bit BLAKE2b, hashing each token once."""

    @F.arrow_udf("array<int>")
    def codes(tokens: pa.Array) -> pa.Array:
        known: dict[str, int] = {}

        def code(token: str) -> int:
            if token not in known:
                known[token] = (_blake(token) % dim) * 2 + _blake("s:" + token) % 2
            return known[token]

        return pa.array(
            [None if row is None else [code(t) for t in row] for row in tokens.to_pylist()],
            type=pa.list_(pa.int32()),
        )

    return codes


def _blake(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little")
