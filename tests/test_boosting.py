"""Boosted trees against a plain version, over shards, and on odd rows."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from nascent.learning import boosting, classify, trainer

SETTINGS = boosting.BoostSettings(trees=4, depth=3, rate=0.3, subsample=1.0, bins=8, refresh=3)


def points(spark, rows=240):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(rows, 5)), 2)
    label = np.where(x[:, 0] > 0.3, "up", np.where(x[:, 1] * x[:, 2] > 0, "left", "right"))
    data = [(int(i), str(y), [float(v) for v in r]) for i, (r, y) in enumerate(zip(x, label, strict=True))]
    return spark.createDataFrame(data, "complaint_id long, label string, vector array<double>"), x, label


def plain_scores(forest, x, label, settings):
    """Grow the same trees row by row: every cut of every feature is tried on the rows themselves."""
    names = sorted(set(label))
    y = np.array([names.index(v) for v in label])
    bins = np.array([[sum(e < v for e in forest.edges[f]) for f, v in enumerate(row)] for row in x])
    scores = np.tile(np.log([np.mean(y == c) for c in range(len(names))]), (len(x), 1))
    gains = []
    for _ in range(settings.trees):
        grown = np.exp(scores)
        share = grown / grown.sum(axis=1, keepdims=True)
        for c in range(len(names)):
            g, h = share[:, c] - (y == c), share[:, c] * (1 - share[:, c])

            def grow(at, depth, c=c, g=g, h=h):
                worth = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + settings.l2)
                best = (1e-9, None)
                for f in range(x.shape[1]) if depth else ():
                    for cut in range(settings.bins - 1):
                        left, right = at[bins[at, f] <= cut], at[bins[at, f] > cut]
                        if min(h[left].sum(), h[right].sum()) < settings.least_weight:
                            continue
                        gain = worth(left) + worth(right) - worth(at)
                        if gain > best[0] + 1e-7:
                            best = (gain, (left, right))
                if best[1] is None:
                    scores[at, c] -= settings.rate * g[at].sum() / (h[at].sum() + settings.l2)
                else:
                    gains.append(best[0])
                    for part in best[1]:
                        grow(part, depth - 1)

            grow(np.arange(len(x)), settings.depth)
    return scores, gains


def test_splits_and_scores_equal_a_plain_version(spark):
    df, x, label = points(spark)
    forest = boosting.train(df, "complaint_id", "label", "vector", SETTINGS)
    want, gains = plain_scores(forest, x, label, SETTINGS)
    cells = forest.binned(x)
    assert np.allclose(forest.base + sum(t.scores(cells) for t in forest.trees), want, atol=1e-6)
    found = np.concatenate([t.gain[t.gain > 0] for t in forest.trees])
    assert np.allclose(sorted(found), sorted(gains), atol=1e-5)
    # Features 3 and 4 say nothing.
    assert {f for f, _ in forest.importance()[:3]} == {0, 1, 2}


def test_trees_do_not_depend_on_shards_or_refreshing(spark, monkeypatch):
    df, x, _ = points(spark)
    settings = boosting.BoostSettings(trees=4, depth=3, bins=8, subsample=0.6, refresh=2)
    one = boosting.train(df, "complaint_id", "label", "vector", settings)
    monkeypatch.setattr(trainer, "SHARD_ROWS", 20)  # twelve shards, merged in two levels
    monkeypatch.setattr(boosting, "FAN_IN", 3)
    many = boosting.train(df.repartition(7), "complaint_id", "label", "vector", settings)
    cells = one.binned(x)
    for a, b in zip(one.trees, many.trees, strict=True):
        assert (a.feature == b.feature).all() and (a.cut == b.cut).all()
        assert np.allclose(a.scores(cells), b.scores(cells), atol=1e-12)


def test_histograms_are_plain_sums_without_a_number_per_row_and_feature():
    rng = np.random.default_rng(8)
    rows, features, bins = 20_000, 40, 8
    cells, node = rng.integers(0, bins, (features, rows)), rng.integers(0, 4, rows)
    values = tuple(np.round(rng.normal(size=rows) * boosting.ROUNDING) / boosting.ROUNDING for _ in range(2))
    for open_ in ([True, True, False, True], [False, True, False, False]):
        taken, wanted = np.array(open_)[node], np.flatnonzero(open_)
        tracemalloc.start()
        found = boosting.histograms(cells, node, taken, wanted, values, bins)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < cells.nbytes / 2
        for i, one in enumerate(wanted):
            want = np.zeros((features, bins, 2))
            for f in range(features):
                for v in range(2):
                    np.add.at(want[f, :, v], cells[f, node == one], values[v][node == one])
            assert np.array_equal(found[i], want.reshape(-1, 2))


def test_every_round_draws_its_share_by_id():
    keys = np.arange(20_000) * 7_919 - 50_000
    settings = boosting.BoostSettings(subsample=0.8)
    first, second = (boosting.in_sample(keys, n, settings) for n in (0, 1))
    assert abs(first.mean() - 0.8) < 0.02 and abs((first & second).mean() - 0.64) < 0.02
    assert (boosting.in_sample(keys[::-1], 0, settings)[::-1] == first).all()


def test_odd_rows(spark):
    df, _, _ = points(spark, 60)
    odd = spark.createDataFrame(
        [(900, None, [0.0] * 5), (901, "up", None), (None, "up", [9.0] * 5), (902, "left", [float("nan")] * 5), (902, "left", [float("inf")] * 5)],
        df.schema,
    )
    both = df.unionByName(odd).withColumn("y", F.lit("own")).withColumn("shard", F.lit(1))
    forest = boosting.train(both, "complaint_id", "label", "vector", SETTINGS)
    got = boosting.predict(forest, both, "vector", "complaint_id", "y")
    rows = got.collect()
    assert len(rows) == 65 and {r.y for r in rows} == {"own"}
    bare = next(r for r in rows if r.complaint_id == 901)
    assert abs(bare.share - np.exp(forest.base.max())) < 1e-12
    single = boosting.train(df.where("label = 'up'"), "complaint_id", "label", "vector", SETTINGS)
    assert not single.trees
    assert {r.predicted for r in boosting.predict(single, df, "vector", "complaint_id").collect()} == {"up"}


def test_held_out_rows(spark):
    df, _, _ = points(spark, 1_500)
    parts = classify.split(df, "label")
    predicted = classify.train_boosted(parts, "label", trees=25, depth=4, rate=0.3, fold=None)
    assert predicted.columns == ["complaint_id", "truth", "predicted"]
    assert classify.evaluate(predicted).first()["macro_f1"] > 0.9
