"""Merkle manifest of a dataset as a persistent tree with path copying.

Rows are leaves of one tree per group; the roots of the groups are leaves of a last tree.
A tree is cut into aligned blocks of ``2 ** BLOCK_BITS`` nodes. One task hashes a block up
to its top; the tops of all blocks are the nodes of the next tier, which is cut into blocks
again, so a tier is a few thousand times smaller than the one below and no task ever holds
more than a block, however large a group is.

A changed leaf makes a version of the tree. Inside its block only the ancestors of the leaf
are copied and every other node is shared with the original tree; the copied block top goes
on through the upper tiers, where again only its ancestors are copied. What a version shares
in the upper tiers is the same for all leaves of a block, so it travels once a block, as the
path of the block's top to the root.

Two consecutive nodes become the sha256 of their hex digests; a last node without a partner
is hashed alone. A tree of one leaf has that leaf as its root.

Defined results: null values are hashed as ``-`` and differ from empty text; a null group is
a group and comes first; rows with null order values come first in their group; rows that
tie are ordered by their leaves, so the tree does not depend on the order of the input, and
repeated rows are leaves of their own; texts are hashed whole on the JVM; an empty table has
no root and gives an empty result; columns beside those named are ignored, and names of the
input never clash with those used here, because the leaves are renamed first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nascent.llm.common import complete_runs, run_ends
from nascent.operators.numbering import number_rows
from nascent.session import attach_small, settle

BLOCK_BITS = 12
#: Steps of a path: the partner's side and digest, or no partner.
LEFT, RIGHT, ALONE = "L", "R", "-"


def encoded(value: Column) -> Column:
    """``-`` for null, else the value's length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    """sha256 over the encoded values, as lowercase hex."""
    return F.sha2(F.concat(*[encoded(v) for v in values]).cast("binary"), 256)


def _hash(digests: str) -> str:
    return sha256(digests.encode("ascii")).hexdigest()


def grow_levels(nodes: list[str], levels: int) -> list[list[str]]:
    """``levels`` rounds of hashing pairs above ``nodes``, which come first."""
    grown = [nodes]
    for _ in range(levels):
        below = grown[-1]
        grown.append([_hash("".join(below[i : i + 2])) for i in range(0, len(below), 2)])
    return grown


def path_in(grown: list[list[str]], place: int) -> list[str]:
    """The steps from a node of the first level to the last one, from below."""
    steps = []
    for level in grown[:-1]:
        partner = place ^ 1
        if partner >= len(level):
            steps.append(ALONE)
        else:
            steps.append((RIGHT if partner > place else LEFT) + level[partner])
        place >>= 1
    return steps


def copy_ancestors(digest: str, steps: list[str]) -> list[str]:
    """The new ancestors of a node along its path; every partner is a shared node."""
    copies = []
    for step in steps:
        side, partner = step[0], step[1:]
        digest = _hash(partner + digest if side == LEFT else digest + partner)
        copies.append(digest)
    return copies


def siblings(steps: list[str]) -> str:
    return "".join(step[1:] for step in steps)


def levels_of(nodes: int, size: int, bits: int) -> int:
    """How many levels a block of ``size`` of a tree of ``nodes`` is hashed up."""
    return bits if nodes > 1 << bits else (size - 1).bit_length()


def blocks_of(nodes: int, bits: int) -> int:
    return -(-int(nodes) >> bits)


@dataclass(frozen=True)
class Tier:
    """Nodes ``(tree, pos, nodes, digest)`` and how many there are in the largest tree."""

    nodes: DataFrame
    largest: int


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in complete_runs(batches, ["tree", "block"]):
        ends = run_ends(frame, ["tree", "block"])
        start = 0
        while start < len(frame):
            yield frame.iloc[start : ends[start]]
            start = ends[start]


def _framed(rows: Iterator[tuple], columns: list[str], most: int = 10_000) -> Iterator[pd.DataFrame]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pd.DataFrame(held, columns=columns)
            held = []
    if held:
        yield pd.DataFrame(held, columns=columns)


def grow_tiers(nodes: DataFrame, bits: int = BLOCK_BITS) -> list[Tier]:
    """The tiers of all trees, from the leaves to the roots.

    One round a tier: three tiers hold 6.9e10 leaves. ``nodes`` is read several times.
    """

    def tops(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            for block in _runs(batches):
                first, own = block.iloc[0], block["digest"].tolist()
                top = grow_levels(own, levels_of(first["nodes"], len(own), bits))[-1][0]
                yield first["tree"], first["block"], blocks_of(first["nodes"], bits), top

        yield from _framed(rows(), ["tree", "pos", "nodes", "digest"])

    tiers = [Tier(nodes, nodes.agg(F.max("nodes")).first()[0] or 0)]
    while tiers[-1].largest > 1:
        below = tiers[-1]
        blocked = below.nodes.select("tree", "pos", "nodes", "digest", F.shiftright("pos", bits).alias("block"))
        whole = blocked.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
        made = settle(whole.mapInPandas(tops, "tree long, pos long, nodes long, digest string"))
        tiers.append(Tier(made, blocks_of(below.largest, bits)))
    return tiers


def _with_paths(own: DataFrame, above: DataFrame, bits: int) -> DataFrame:
    """Every block of ``own`` after one row with the path of its top; that row's place is -1."""
    heads = above.select(
        "tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), F.lit(0).cast("long").alias("nodes"), "path"
    )
    blocked = own.withColumn("block", F.shiftright("pos", bits))
    both = blocked.unionByName(heads, allowMissingColumns=True)
    return both.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _down(own: DataFrame, above: DataFrame, bits: int) -> DataFrame:
    """Paths to the root of the nodes of a tier, given those of their blocks' tops."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            for block in _runs(batches):
                onward, inner = list(block["path"].iloc[0]), block.iloc[1:]
                tree, first, digests = inner["tree"].iloc[0], inner["pos"].iloc[0], inner["digest"].tolist()
                grown = grow_levels(digests, levels_of(inner["nodes"].iloc[0], len(digests), bits))
                for i in range(len(digests)):
                    yield tree, first + i, path_in(grown, i) + onward

        yield from _framed(rows(), ["tree", "pos", "path"])

    joined = _with_paths(own.select("tree", "pos", "nodes", "digest"), above, bits)
    return joined.mapInPandas(walk, "tree long, pos long, path array<string>")


def place_leaves(rows: DataFrame, group: Column, order: list[Column], leaf: Column, kept: dict[str, Column]) -> DataFrame:
    """``(tree, pos, nodes, digest)`` and the ``kept`` columns, written once.

    A tree is a group, numbered in order; a third of all rows in one group, or equal rows in
    any number, are dealt over partitions like others.
    """
    named = [c.alias(f"_by{i}") for i, c in enumerate(order)]
    leaves = rows.select(group.alias("_group"), *named, leaf.alias("digest"), *[c.alias(n) for n, c in kept.items()])
    # The row's place in the written table parts equal rows, which no other column can.
    leaves = settle(leaves).withColumn("_row", F.monotonically_increasing_id())
    by = ["_group", *[f"_by{i}" for i in range(len(order))], "digest", "_row"]
    placed = number_rows(leaves, by, "_place")
    sizes = placed.groupBy("_group").agg(F.min("_place").alias("_first"), F.count("*").alias("nodes"))
    trees = number_rows(sizes, ["_group"], "tree")
    joined = attach_small(placed, trees, ["_group"], spread="_place", null_safe=True)
    return settle(
        joined.select("tree", (F.col("_place") - F.col("_first")).alias("pos"), "nodes", "digest", *kept)
    )


def manifest(leaves: DataFrame, changed: str, kept: list[str], bits: int = BLOCK_BITS) -> DataFrame:
    """Digests, proof and version of every leaf of :func:`place_leaves`.

    ``changed`` is the column with the digest of the leaf's present content; where it differs
    from ``digest`` a version is made. Returns the ``kept`` columns, ``leaf``, ``subroot``,
    ``root``, ``proof`` (the sha256 over all partners, from below), ``folded_root`` (the root
    of the leaf's version) and ``n_copied`` (the nodes that version does not share). Blocks hold
    ``2 ** bits`` nodes; the result does not depend on that. The
    ``kept`` columns travel as text: integers, decimals, strings and dates come back as they were.
    """
    groups = grow_tiers(leaves, bits)
    subroots = groups[-1].nodes
    trees = F.lit(subroots.count()).cast("long")
    upper = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), trees.alias("nodes"), "digest")
    forest = grow_tiers(settle(upper), bits)
    root = forest[-1].nodes.select("digest").first()
    path = forest[-1].nodes.select("tree", "pos", F.array().cast("array<string>").alias("path"))
    for tier in reversed(forest[:-1]):
        path = settle(_down(tier.nodes, path, bits))
    # From here the place of a group's root is the group's tree.
    tops = path.select(F.col("pos").alias("tree"), F.lit(0).cast("long").alias("pos"), "path")
    for tier in reversed(groups[1:-1]):
        tops = settle(_down(tier.nodes, tops, bits))
    roots = subroots.select("tree", F.col("digest").alias("subroot"))
    found = attach_small(_fold(leaves, tops, changed, kept, bits), roots, ["tree"], spread="leaf")
    return found.drop("tree").withColumn("root", F.lit(root[0] if root else None).cast("string"))


def _fold(leaves: DataFrame, tops: DataFrame, changed: str, kept: list[str], bits: int) -> DataFrame:
    """The last step down: whole blocks of leaves, each after its top's path."""
    types = {field.name: field.dataType for field in leaves.schema}
    texts = [f"_kept{i}" for i in range(len(kept))]
    made = ["tree", "leaf", "proof", "folded_root", "n_copied"]
    schema = ", ".join([*(f"{t} string" for t in texts), "tree long, leaf string, proof string, folded_root string, n_copied long"])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in _runs(batches):
            onward, own = list(block["path"].iloc[0]), block.iloc[1:]
            nodes, now = own["digest"].tolist(), own["_now"].tolist()
            grown = grow_levels(nodes, levels_of(own["nodes"].iloc[0], len(nodes), bits))
            proofs, folded, copied = [], [], []
            for place, (before, after) in enumerate(zip(nodes, now)):
                steps = path_in(grown, place) + onward
                ancestors = copy_ancestors(after, steps)
                proofs.append(_hash(siblings(steps)))
                folded.append(ancestors[-1] if ancestors else after)
                copied.append(0 if after == before else len(ancestors) + 1)
            out = own[[*texts, "tree"]].copy()
            out["leaf"], out["proof"], out["folded_root"], out["n_copied"] = nodes, proofs, folded, copied
            yield out[[*texts, *made]]

    own = leaves.select(
        "tree", "pos", "nodes", "digest", F.col(changed).alias("_now"),
        *[F.col(k).cast("string").alias(t) for k, t in zip(kept, texts)],
    )
    folded = _with_paths(own, tops, bits).mapInPandas(fold, schema)
    return folded.select(*[F.col(t).cast(types[k]).alias(k) for k, t in zip(kept, texts)], *made)
