"""SimHash near-duplicates, found by the general pigeonhole principle.

Two fingerprints at most ``radius`` bits apart agree, in one of ``m`` parts of the bits,
up to that part's own threshold, if the thresholds sum to ``radius - m + 1`` (Qin et al.,
2018). Bits that go together over all fingerprints share a part, as one such part tells
as much as its most telling bits and leaves the others independent. The thresholds are
unequal: dynamic programming over the parts takes those with the least estimated work,
that is the pairs that agree in a part and the rows sent to probe it. Both numbers come
from all fingerprints. Every pair that meets is verified on all 64 bits.

Equal fingerprints are one node from the start. A part's value that very many fingerprints
share is compared in blocks of bounded size, and a block hands on a star per group of
linked fingerprints, never its pairs.

Defined results: a null or empty text, or one of white space, has fingerprint zero, which
links like any other; fewer than ``width`` words are one shingle; repeated rows and ties
share a fingerprint and a component; a row without an id links others and gets the component of
its fingerprint, null if no id is reachable;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nascent.llm.common import (
    bounded_batches,
    clean_text,
    complete_runs,
    deal_blocks,
    local_labels,
    pairs_in_runs,
    partitions_for,
    run_ends,
)
from nascent.llm.components import components
from nascent.operators.numbering import number_rows
from nascent.session import settle

SEED = 42
AT_ONCE = 1 << 18
BLOCK_ROWS = 1024
ROW_COST = 40.0  # what sending a row costs, in compared pairs


def fingerprint(text: str, width: int = 4) -> int:
    """The 64-bit SimHash of a text's word shingles, as a signed number."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    count = max(1, len(words) - width + 1)
    starts, ends = starts[:count].tolist(), ends[min(width, len(words)) - 1 :].tolist()
    digest, ones = xxhash.xxh64_digest, np.zeros(64, dtype=np.int64)
    for at in range(0, count, AT_ONCE):
        part = zip(starts[at : at + AT_ONCE], ends[at : at + AT_ONCE], strict=True)
        hashed = b"".join([digest(joined[a:b], SEED) for a, b in part])
        bits = np.unpackbits(np.frombuffer(hashed, dtype=np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > count).view(">i8")[0])


def row_key(id_col: str, text_col: str) -> Column:
    """A hash of id and text: equal rows share it, other rows do not."""
    return F.xxhash64(F.col(id_col), clean_text(text_col))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """``(id, row_key, fp)``, one row per row of ``docs``; no shuffle."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("bigint")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width) for t in texts], dtype="int64")

    keyed = row_key(id_col, text_col).alias("row_key")
    return docs.select(F.col(id_col), keyed, hashed(clean_text(text_col)).alias("fp"))


def bit_counts(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for every two bits how many have both set."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, rows = np.zeros((64, 64)), 0
        for batch in batches:
            raw = batch["fp"].to_numpy(dtype=np.int64).astype(">i8").view(np.uint8)
            bits = np.unpackbits(raw.reshape(-1, 8), axis=1)[:, ::-1].astype(np.float32)
            total += bits.T @ bits
            rows += len(batch)
        i, j = np.triu_indices(64)
        yield pd.DataFrame({"i": np.append(i, -1), "j": np.append(j, -1), "n": np.append(total[i, j], rows).astype(np.int64)})

    summed = nodes.select("fp").mapInPandas(count, "i int, j int, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n"))
    both, rows = np.zeros((64, 64)), 0
    for r in summed.collect():  # 2,081 rows at most
        if r["i"] < 0:
            rows = r["n"]
        else:
            both[r["i"], r["j"]] = both[r["j"], r["i"]] = r["n"]
    return rows, both


def correlated_parts(rows: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """The bits in ``parts`` groups of nearly equal size; correlated bits go together."""
    share = np.diag(both) / max(rows, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    alike = np.abs(both / max(rows, 1) - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(alike, 0)
    left, found = list(range(64)), []
    for k in range(parts):
        size = -(-len(left) // (parts - k))
        group = [left[int(alike[np.ix_(left, left)].sum(axis=1).argmax())]]
        left.remove(group[0])
        while len(group) < size:
            nearest = left[int(alike[np.ix_(left, group)].sum(axis=1).argmax())]
            group.append(nearest)
            left.remove(nearest)
        found.append(sorted(group))
    return found


def mask_of(bits: list[int]) -> int:
    """A set of bits as a signed 64-bit number."""
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


@dataclass(frozen=True)
class Plan:
    """Bits of each part and its threshold; -1 leaves the part out."""

    parts: list[list[int]]
    thresholds: list[int]
    cost: float


def allocate(pairs: list[list[float]], probes: list[list[float]], total: int) -> tuple[list[int], float]:
    """Thresholds of -1 and up that sum to ``total`` with the least work, by dynamic programming.

    ``pairs[i][e]`` and ``probes[i][e]``: pairs to verify and rows to send if part i has threshold e.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i in range(len(pairs)):
        grown: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for e in range(-1, len(pairs[i])):
                work = cost + (pairs[i][e] + ROW_COST * probes[i][e] if e >= 0 else 0.0)
                if spent + e not in grown or work < grown[spent + e][0]:
                    grown[spent + e] = (work, [*chosen, e])
        best = grown
    cost, chosen = best[total]
    return chosen, cost


def make_plan(nodes: DataFrame, radius: int) -> Plan:
    """The partition and thresholds with the least estimated work, from all fingerprints.

    Pairs that agree in a part are counted exactly. How many more agree but for a few bits
    follows from the share of pairs that differ in each bit.
    """
    rows, both = bit_counts(nodes)
    differing = np.diag(both) / max(rows, 1)
    differing = np.clip(2 * differing * (1 - differing), 1e-6, 1 - 1e-6)
    candidates = [correlated_parts(rows, both, m) for m in range(max(2, (radius + 1) // 2), radius + 2)]
    keys = [
        F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(mask_of(bits))).alias("key"))
        for m, parts in enumerate(candidates)
        for i, bits in enumerate(parts)
    ]
    exploded = nodes.select(F.explode(F.array(*keys)).alias("k")).select("k.*")
    counted = exploded.groupBy("m", "i", "key").agg(F.count("*").cast("double").alias("n"))
    squares = counted.groupBy("m", "i").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"))
    exact = {(r["m"], r["i"]): r["pairs"] for r in squares.collect()}
    plans = []
    for m, parts in enumerate(candidates):
        pairs, probes = [], []
        for i, bits in enumerate(parts):
            odds = differing[bits] / (1 - differing[bits])
            two = (odds.sum() ** 2 - (odds**2).sum()) / 2
            same = exact.get((m, i), 0.0)
            pairs.append([same, same * (1 + odds.sum()), same * (1 + odds.sum() + two)])
            n = len(bits)
            probes.append([rows, rows * (1 + n / 2), rows * (1 + n / 2 + comb(n, 2) / 2)])
        thresholds, cost = allocate(pairs, probes, radius - len(parts) + 1)
        plans.append(Plan(parts, thresholds, cost))
    return min(plans, key=lambda p: p.cost)


def probe_rows(nodes: DataFrame, plan: Plan) -> DataFrame:
    """``(part, key, probe, fp, rep)``: every node's own value in each part and its variations.

    Two values that differ in some bits meet once: the one with the lowest of them set
    comes to the other.
    """
    own, varied = [], []
    for i, (bits, most) in enumerate(zip(plan.parts, plan.thresholds, strict=True)):
        if most < 0:
            continue
        value = F.col("fp").bitwiseAND(F.lit(mask_of(bits)))
        own.append(F.struct(F.lit(i).alias("part"), value.alias("key"), F.lit(False).alias("probe")))
        for flips in (c for size in range(1, most + 1) for c in combinations(bits, size)):
            lowest_set = F.col("fp").bitwiseAND(F.lit(mask_of([flips[0]]))) != 0
            varied.append(
                F.when(
                    lowest_set,
                    F.struct(F.lit(i).alias("part"), value.bitwiseXOR(F.lit(mask_of(list(flips)))).alias("key"), F.lit(True).alias("probe")),
                )
            )
    rows = nodes.select("fp", "rep", F.explode(F.array(*own, *varied)).alias("k")).where("k is not null")
    return rows.select("k.part", "k.key", "k.probe", "fp", "rep")


def linked(nodes: DataFrame, plan: Plan, radius: int, count: int) -> DataFrame:
    """``(left, right)`` links that join all nodes reachable within a block."""
    keys = ["part", "key", "__low", "__high"]
    dealt = deal_blocks(probe_rows(nodes, plan), ["part", "key"], F.xxhash64("fp"), BLOCK_ROWS)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in complete_runs(batches, keys):
            fp, rep = frame["fp"].to_numpy().view(np.uint64), frame["rep"].to_numpy()
            probe, own = frame["probe"].to_numpy(), frame["__own"].to_numpy()
            mixed = (frame["__low"] != frame["__high"]).to_numpy()
            lefts, rights, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
            label = np.arange(len(frame))
            for a, b in pairs_in_runs(run_ends(frame, keys)):
                near = np.bitwise_count(fp[a] ^ fp[b]) <= radius
                near &= ~(probe[a] & probe[b]) & ~(mixed[a] & (own[a] == own[b]))
                lefts.append(a[near])
                rights.append(b[near])
                held += len(lefts[-1])
                if held > 2_000_000:
                    label = local_labels(len(frame), np.concatenate([*lefts, label]), np.concatenate([*rights, np.arange(len(label))]))
                    lefts, rights, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
            label = local_labels(len(frame), np.concatenate([*lefts, label]), np.concatenate([*rights, np.arange(len(label))]))
            other = rep[label] != rep
            yield pd.DataFrame({"left": rep[other], "right": rep[label[other]]}).drop_duplicates()

    parts = partitions_for(count, 20_000, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = dealt.repartition(parts, *keys).sortWithinPartitions(*keys)
    return placed.mapInPandas(verify, "left bigint, right bigint")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4
) -> DataFrame:
    """``(id, row_key, fp, component)``: the smallest id reachable over links, for every row."""
    prints = settle(fingerprints(docs, id_col, text_col, width))
    nodes = settle(prints.groupBy("fp").agg(F.min(id_col).cast("bigint").alias("rep")))
    count, with_id, top = nodes.agg(F.count("*"), F.count("rep"), F.coalesce(F.max("rep"), F.lit(0))).first()
    if with_id < count:
        # Texts without an id still link others: they take numbers above all ids.
        bare = number_rows(nodes.where("rep is null").select("fp"), [F.col("fp")], "n")
        bare = bare.select("fp", (F.lit(top + 1) + F.col("n")).cast("bigint").alias("rep"))
        nodes = settle(nodes.where("rep is not null").unionByName(bare))
    if count > 1:
        links = linked(nodes, make_plan(nodes, radius), radius, count)
        found = components(links, "left", "right")
        joined = nodes.join(found, F.col("rep") == F.col("node"), "left")
        groups = joined.select("fp", F.coalesce("component", "rep").alias("component"))
    else:
        groups = nodes.select("fp", F.col("rep").alias("component"))
    groups = groups.select("fp", F.when(F.col("component") <= top, F.col("component")).alias("component"))
    return prints.join(groups, "fp", "left").select(id_col, "row_key", "fp", "component")
