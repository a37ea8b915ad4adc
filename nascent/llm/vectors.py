"""Near-duplicate embeddings by cross-polytope hashing.

A vector is turned by three rounds of random signs and a fast Hadamard transform and
hashed to the nearest vertex of the cross-polytope: its largest coordinate and sign
(Andoni et al., 2015). A table joins ``functions`` such hashes, and its probes are the
buckets next to the own one, with the smallest loss in one coordinate. Two vectors are
compared if one's own bucket is among the other's own and probed ones.

The number of hashes a table joins follows the number of vectors, so that buckets stay
small; the number of tables follows that one, so that a pair at the threshold is missed
about once in ten thousand. Every pair found is verified by its cosine in doubles.

Equal vectors are one node with a weight. A crowded bucket is compared in blocks of
bounded size, which hand on counts and one star per group, never pairs. A pair may meet in
several buckets; the first table in which it meets counts it, which both rows can tell
from their signatures.

Defined results: null ids, null or zero vectors and those with null or non-finite numbers
link with nothing and are components of their own; vectors of different lengths are never
compared; repeated rows are vectors of their own and link with each other; ties at the
threshold are links; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nascent.llm.common import (
    complete_runs,
    deal_blocks,
    local_labels,
    pairs_in_runs,
    partitions_for,
    run_ends,
)
from nascent.llm.components import components
from nascent.session import settle

BUCKET_ROWS = 64
BLOCK_ROWS = 512
#: Tables for one, two, three and more hashes a table, with ``PROBES`` probes each.
TABLES = (3, 6, 12, 24)
PROBES = 3


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal fast Hadamard transform of every row; the length is a power of two."""
    size, half = x.shape[1], 1
    while half < size:
        y = x.reshape(len(x), size // (2 * half), 2, half)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(x), size)
        half *= 2
    return x / np.sqrt(size)


@dataclass(frozen=True)
class Hashing:
    """``tables`` tables of ``functions`` hashes; signs follow from the seed and the length."""

    functions: int
    tables: int
    probes: int = PROBES
    seed: int = 17

    def signatures(self, x: np.ndarray) -> np.ndarray:
        """Bucket numbers, ``(rows, tables, 1 + probes)``; the own bucket comes first."""
        size = 1 << max(1, int(ceil(log(max(x.shape[1], 2), 2))))
        padded = np.zeros((len(x), size))
        padded[:, : x.shape[1]] = x
        out = np.zeros((len(x), self.tables, 1 + self.probes), dtype=np.int64)
        random = np.random.default_rng([self.seed, size])
        rows = np.arange(len(x))[:, None]
        for table in range(self.tables):
            own, others, losses = [], [], []
            for _ in range(self.functions):
                y = padded
                for _ in range(3):
                    y = hadamard(y * random.choice([-1.0, 1.0], size))
                heights = np.abs(y)
                order = np.argsort(-heights, axis=1, kind="stable")[:, : min(size, self.probes + 1)]
                code = 2 * order + (y[rows, order] < 0)
                own.append(code[:, 0])
                others.append(code[:, 1:])
                losses.append(heights[rows, order[:, :1]] - heights[rows, order[:, 1:]])
            places = (2 * size) ** np.arange(self.functions, dtype=np.int64)
            home = sum(o * p for o, p in zip(own, places, strict=True))
            probed = np.hstack([home[:, None] + (o - h[:, None]) * p for o, h, p in zip(others, own, places, strict=True)])
            cheapest = np.argsort(np.hstack(losses), axis=1, kind="stable")[:, : self.probes]
            out[:, table, 0] = home
            out[:, table, 1 : 1 + cheapest.shape[1]] = probed[rows, cheapest]
            out[:, table, 1 + cheapest.shape[1] :] = home[:, None]
        return out


def hashing_for(count: int, size: int) -> Hashing:
    """Enough hashes a table for buckets of about ``BUCKET_ROWS`` unrelated vectors."""
    vertices = 2 * max(2, size)
    functions = max(1, ceil(log(max(count / BUCKET_ROWS, 1)) / log(vertices)))
    return Hashing(functions, TABLES[min(functions, len(TABLES)) - 1])


def usable(vector: str):
    """Not null, not zero, and all numbers finite."""
    number = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    values = F.col(vector)
    return F.coalesce(F.forall(values, number) & F.exists(values, lambda v: v != 0), F.lit(False))


ROW = "part int, bucket bigint, probe boolean, node bigint, rep bigint, weight bigint, unit binary, signature binary"


def bucket_rows(nodes: DataFrame, hashing: Hashing) -> DataFrame:
    """One row for every node, table and bucket, own and probed; with unit vector and signature."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, group in batch.groupby(batch["vector"].map(len)):
                x = np.array(group["vector"].tolist(), dtype=np.float64)
                # Scaled first, so that squares of very large or small numbers stay finite.
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                found = hashing.signatures(x)
                n, tables, buckets = found.shape
                repeats = tables * buckets
                fresh = np.ones(found.shape, dtype=bool)
                fresh[:, :, 1:] = found[:, :, 1:] != found[:, :, :1]
                units = [row.tobytes() for row in x]
                signatures = [row.tobytes() for row in found]
                rows = pd.DataFrame(
                    {
                        "part": np.tile(np.repeat(np.arange(tables), buckets), n) + tables * int(size),
                        "bucket": found.ravel(),
                        "probe": np.tile(np.arange(buckets) > 0, n * tables),
                        **{c: np.repeat(group[c].to_numpy(), repeats) for c in ("node", "rep", "weight")},
                        "unit": np.repeat(np.array(units, dtype=object), repeats),
                        "signature": np.repeat(np.array(signatures, dtype=object), repeats),
                    }
                )
                yield rows[fresh.ravel()]

    return nodes.mapInPandas(spread, ROW)


def first_meeting(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The first table in which one's own bucket is among the other's, by row of two signatures."""
    meets = (left[:, :, :1] == right).any(axis=2) | (right[:, :, :1] == left).any(axis=2)
    return meets.argmax(axis=1)


def compare(nodes: DataFrame, hashing: Hashing, threshold: float, count: int) -> DataFrame:
    """``(node, links, rep, least)``: links counted in a block, and the smallest rep it ties to."""
    keys = ["part", "bucket", "__low", "__high"]
    dealt = deal_blocks(bucket_rows(nodes, hashing), ["part", "bucket"], F.xxhash64("node"), BLOCK_ROWS)
    tables, buckets = hashing.tables, 1 + hashing.probes

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in complete_runs(batches, keys, 8_000):
            part = frame["part"].to_numpy()
            node, rep, weight, probe, own = (frame[c].to_numpy() for c in ("node", "rep", "weight", "probe", "__own"))
            mixed = (frame["__low"] != frame["__high"]).to_numpy()
            signature = np.frombuffer(b"".join(frame["signature"]), dtype=np.int64).reshape(-1, tables, buckets)
            places = np.concatenate(([0], np.cumsum(frame["unit"].map(len).to_numpy() // 8)))
            flat = np.frombuffer(b"".join(frame["unit"]), dtype=np.float64)
            lengths = np.diff(places)
            links, lefts, rights = np.zeros(len(frame), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b in pairs_in_runs(run_ends(frame, keys)):
                ok = ~(probe[a] & probe[b]) & ~(mixed[a] & (own[a] == own[b]))
                a, b = a[ok], b[ok]
                if not len(a):
                    continue
                cosine = np.zeros(len(a))
                for size in np.unique(lengths[a]):
                    same = np.flatnonzero(lengths[a] == size)
                    steps = np.arange(size)
                    cosine[same] = np.einsum("ij,ij->i", flat[places[a[same]][:, None] + steps], flat[places[b[same]][:, None] + steps])
                near = cosine >= threshold
                a, b = a[near], b[near]
                table = part[a] % tables
                counted = first_meeting(signature[a], signature[b]) == table
                # Each may probe the other's bucket; then the bucket of the smaller node counts.
                host, guest = np.where(probe[a], b, a), np.where(probe[a], a, b)
                twice = (signature[host, table, 1:] == signature[guest, table, :1]).any(axis=1) & (probe[a] | probe[b])
                counted &= ~twice | (node[host] < node[guest])
                np.add.at(links, a[counted], weight[b[counted]])
                np.add.at(links, b[counted], weight[a[counted]])
                lefts.append(a)
                rights.append(b)
            label = local_labels(len(frame), np.concatenate(lefts), np.concatenate(rights))
            least = np.full(len(frame), np.iinfo(np.int64).max)
            np.minimum.at(least, label, rep)
            out = pd.DataFrame({"node": frame["node"], "links": links, "rep": rep, "least": least[label]})
            out = out[(out["links"] > 0) | (out["least"] != out["rep"])]
            yield out.groupby(["node", "rep", "least"], as_index=False)["links"].sum()[["node", "links", "rep", "least"]]

    expected = count * tables * buckets
    parts = partitions_for(expected, 20_000, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = dealt.repartition(parts, *keys).sortWithinPartitions(*keys)
    return placed.mapInPandas(verify, "node bigint, links bigint, rep bigint, least bigint")


def near_vectors(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, hashing: Hashing | None = None
) -> DataFrame:
    """``(id, n_links, component_id)`` for every row."""
    vectors = rows.select(F.col(id_col), F.col(vector_col).alias("vector"))
    fit = usable("vector") & F.col(id_col).isNotNull()
    keyed = vectors.select(id_col, F.when(fit, F.xxhash64("vector")).alias("node"), F.when(fit, F.col("vector")).alias("vector"))
    usable_rows = keyed.where(F.col("node").isNotNull())
    grouped = usable_rows.groupBy("node").agg(F.min(id_col).cast("bigint").alias("rep"), F.count("*").alias("weight"), F.first("vector").alias("vector"))
    nodes = settle(grouped)
    count, size = nodes.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(2))).first()
    nodes_few = nodes.repartition(partitions_for(count, 2_000, 1))
    hashing = hashing or hashing_for(count, size)
    found = settle(compare(nodes_few, hashing, threshold, count))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.select("rep", "least"), "rep", "least")
    joined = nodes.select("node", "rep", "weight").join(counts, "node", "left").join(groups, F.col("rep") == groups["node"], "left")
    per_node = joined.select(
        nodes["node"].alias("__node"),
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"),
    )
    ids = keyed.select(id_col, "node")
    out = ids.join(per_node, F.col("node") == F.col("__node"), "left")
    return out.select(id_col, F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", F.col(id_col).cast("bigint")).alias("component_id"))
