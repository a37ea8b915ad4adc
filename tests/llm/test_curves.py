import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nascent.llm import curves

SCHEMA = "vec_id long, v array<double>, id string, point int, distance double"
TINY = curves.CurveSettings(curves=4, axes=3, least=16, block=64, meeting=5, trials=20, salts=3)


def frame(spark, rows, element="double"):
    made = spark.createDataFrame([(i, v, "x", 1, 0.5) for i, v in rows], SCHEMA).repartition(3)
    return made.withColumn("v", F.col("v").cast(f"array<{element}>"))


def run(spark, rows, k=3, every=10, settings=TINY, element="double"):
    found = curves.nearest_neighbours(frame(spark, rows, element), "v", "vec_id", F.col("id") % every == 0, k, settings)
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.rank, r.id, r.score))
    return out


def brute(rows, k=3, every=10):
    good = [(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q in {i for i, _ in good if i % every == 0}:
        best = {}
        for i, v in good:
            for j, w in good:
                if i == q and j != q and len(v) == len(w):
                    d = math.sqrt(sum((a - b) ** 2 for a, b in zip(v, w)))
                    best[j] = min(best.get(j, d), d)
        ranked = sorted((d, j) for j, d in best.items())[:k]
        if ranked:
            out[q] = [(n + 1, j, d) for n, (d, j) in enumerate(ranked)]
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert [x[:2] for x in got[q]] == [x[:2] for x in want[q]], q
        assert np.allclose([x[2] for x in got[q]], [x[2] for x in want[q]], atol=1e-12)


def test_small_tables_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, size=4)]) for i in range(14)]
    same(run(spark, rows), brute(rows))


def test_bad_rows_ties_copies_and_lengths(spark):
    rows = [(i, [1.0, float(i % 4)]) for i in range(30)]  # copies and ties
    rows += [(40, None), (41, []), (42, [0.0, 0.0]), (43, [math.nan, 1.0]), (44, [math.inf, 1.0]), (45, [None, 1.0])]
    rows += [(None, [1.0, 1.0]), (50, [1.0, 2.0, 3.0]), (51, [1.0, 2.0, 4.0]), (60, [9.0, 9.0]), (60, [1.0, 0.0]), (20, [-0.0, 5.0]), (71, [0.0, 5.0])]
    same(run(spark, rows, k=4), brute(rows, k=4))


def test_fewer_candidates_than_asked_for_and_none(spark):
    assert run(spark, [(0, [1.0, 2.0]), (1, [2.0, 2.0])], k=5) == {0: [(1, 1, 1.0)]}
    assert run(spark, [(0, [1.0, 2.0])]) == {} and run(spark, []) == {} and run(spark, [(0, None)]) == {}


def test_a_third_of_all_rows_are_copies(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [0.5, 0.25, 1.0] if i % 3 == 0 else rng.normal(size=3).tolist()) for i in range(300)]
    got = run(spark, rows, k=5)
    want = brute(rows, k=5)
    for q in (0, 30, 270, 150):
        assert got[q] == want[q]


@pytest.mark.parametrize("kind", ["clusters", "noise"])
def test_recall_over_many_blocks(spark, kind):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 16)) * 5 if kind == "clusters" else np.zeros((40, 16))
    rows = [(i, (centres[i % 40] + rng.normal(size=16)).tolist()) for i in range(1500)]
    settings = curves.CurveSettings(curves=4, axes=4, least=20, block=128, trials=100)
    got, want = run(spark, rows, 10, 20, settings, "float"), brute_fast(rows, 10, 20)
    hits = sum(len({x[1] for x in got[q]} & want[q]) for q in want)
    assert all(len(v) == 10 for v in got.values()) and got.keys() == want.keys()
    assert hits >= 0.93 * sum(len(v) for v in want.values())


def brute_fast(rows, k, every):
    x = np.array([v for _, v in rows], dtype=np.float32).astype(float)
    out = {}
    for q in range(0, len(rows), every):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = math.inf
        out[q] = set(np.argsort(d, kind="stable")[:k].tolist())
    return out


@pytest.mark.parametrize("axes,bits", [(2, 3), (3, 2), (4, 2)])
def test_the_curve_visits_neighbouring_cells(axes, bits):
    cells = np.array(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij")).reshape(axes, -1).T
    keys = curves.hilbert_keys(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()
