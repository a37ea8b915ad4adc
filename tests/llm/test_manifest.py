import random
from collections import Counter
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from nascent.llm import manifest
from nascent.llm.common import in_fold

SCHEMA = "doc_id long, grp string, n long, body string, digest string, tree string, _place long"


def enc(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def digest(row, more=0):
    doc_id, grp, n, body = row[:4]
    n = None if n is None else n + more
    return sha256("".join(enc(v) for v in (doc_id, grp, n, body)).encode()).hexdigest()


def fold_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([sha256("".join(low[i : i + 2]).encode()).hexdigest() for i in range(0, len(low), 2)])
    return levels


def brute(rows):
    first = lambda v: (v is not None, v if v is not None else 0)
    names = sorted({r[1] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    groups = {g: sorted((r for r in rows if r[1] == g), key=lambda r: (first(r[0]), digest(r))) for g in names}
    trees = {g: fold_tree([digest(r) for r in own]) for g, own in groups.items()}
    top = fold_tree([trees[g][-1][0] for g in names])
    out = []
    for number, g in enumerate(names):
        for place, row in enumerate(groups[g]):
            path = []
            for levels, at in ((trees[g], place), (top, number)):
                for level in levels[:-1]:
                    path.append((at % 2, level[at ^ 1] if (at ^ 1) < len(level) else ""))
                    at //= 2
            bad = row[0] is not None and crc32(str(row[0]).encode()) % 7 == 0
            now = digest(row, int(bad))
            for before, partner in path:
                now = sha256(((partner + now) if before else (now + partner)).encode()).hexdigest()
            proof = sha256("".join(p for _, p in path).encode()).hexdigest()
            out.append((row[0], digest(row), trees[g][-1][0], top[-1][0], proof, now))
    return Counter(out)


def run(spark, rows, bits):
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA).repartition(3)
    columns = ["doc_id", "grp", "n", "body"]
    leaf = manifest.leaf_digest([F.col(c) for c in columns])
    other = manifest.leaf_digest([F.col("n") + 1 if c == "n" else F.col(c) for c in columns])
    changed = F.when(in_fold("doc_id", 7, 0), other).otherwise(leaf)
    leaves = manifest.place_leaves(df, F.col("grp"), [F.col("doc_id")], leaf, {"doc_id": F.col("doc_id"), "now": changed})
    return manifest.manifest(leaves, "now", ["doc_id"], bits)


def sample():
    rng = random.Random(4)
    rows = [(i, "en" if i % 3 else "de", rng.randrange(50), "word " * rng.randrange(4)) for i in range(90)]
    rows += [(7, "en", 7, "same")] * 40 + [(None, "en", None, None), (None, None, 3, ""), (5, None, None, "ü" * 3000)]
    return rows + [(3, "fr", 1, "alone"), (2**60 + 1, "en", 2**50, "big id")]


@pytest.mark.parametrize("bits", [1, 2, 12])
def test_manifest_equals_brute_force_at_every_block_size(spark, bits):
    rows = sample()
    got = run(spark, rows, bits).select("doc_id", "leaf", "subroot", "root", "proof", "folded_root").collect()
    assert Counter(tuple(r) for r in got) == brute(rows)


def test_versions_copy_only_the_path(spark):
    rows = [(i, "en", 1, f"t{i}") for i in range(100)]
    got = run(spark, rows, 3).collect()
    for r in got:
        bad = crc32(str(r.doc_id).encode()) % 7 == 0
        assert r.n_copied == (8 if bad else 0)
        assert (r.folded_root == r.root) != bad


def test_one_leaf_and_no_leaf(spark):
    one = run(spark, [(1, None, None, None)], 12).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof == sha256(b"").hexdigest()
    assert run(spark, [], 12).collect() == []


def test_a_version_shares_what_it_does_not_copy():
    nodes = [sha256(str(i).encode()).hexdigest() for i in range(11)]
    grown = manifest.grow_levels(nodes, 4)
    assert len(grown[-1]) == 1
    changed = nodes[:6] + ["0" * 64] + nodes[7:]
    steps = manifest.path_in(grown, 6)
    assert manifest.copy_ancestors("0" * 64, steps)[-1] == manifest.grow_levels(changed, 4)[-1][0]
    assert manifest.copy_ancestors(nodes[6], steps)[-1] == grown[-1][0]
