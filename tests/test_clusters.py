import numpy as np
import pytest
from pyspark.sql import functions as F

from nascent.functions import vectors
from nascent.operators import clusters, encoding, features, linking, quality, scoring, trajectory
from nascent.operators.trajectory import FEATURES


def table(spark, rows):
    return spark.createDataFrame(rows, "complaint_id long, window_id string, local_cluster int, vector array<double>")


def greedy(windows, threshold):
    """Plain loop: the first claimant in cluster order keeps the id."""
    out, before, ids_before, following = {}, None, None, 0
    for name, centres in windows:
        ids, used = [], set()
        for c in centres:
            j = None
            if before is not None:
                a = c / (np.linalg.norm(c) + 1e-12)
                sims = [a @ (p / (np.linalg.norm(p) + 1e-12)) for p in before]
                j = int(np.argmax(sims))
                if sims[j] < threshold or j in used:
                    j = None
            if j is None:
                ids.append(following)
                following += 1
            else:
                used.add(j)
                ids.append(ids_before[j])
        for local, g in enumerate(ids):
            out[(name, local)] = g
        before, ids_before = centres, ids
    return out


@pytest.mark.parametrize("seed", range(3))
def test_linking_equals_the_greedy_loop(spark, seed):
    rng = np.random.default_rng(seed)
    windows, centres = [], rng.normal(size=(4, 3))
    for w in range(11):
        centres = centres + rng.normal(scale=0.5, size=centres.shape)
        windows.append((f"2024-{w + 1:02d}", rng.permutation(centres)))
    rows = [(w, i, [float(x) for x in c]) for w, cs in windows for i, c in enumerate(cs)]
    found = spark.createDataFrame(rows, "window_id string, local_cluster int, centroid array<double>")
    got = {(r.window_id, r.local_cluster): r.global_cluster for r in linking.link_clusters(found).collect()}
    assert got == greedy(windows, 0.5)


def test_small_shift_keeps_ids_and_negation_opens_new_ones(spark):
    eye = 5 * np.eye(3)
    for second, expected in ((eye + 0.01, {0, 1, 2}), (-eye, {3, 4, 5})):
        rows = [("a", i, c.tolist()) for i, c in enumerate(eye)] + [("b", i, c.tolist()) for i, c in enumerate(second)]
        found = spark.createDataFrame(rows, "window_id string, local_cluster int, centroid array<double>")
        links = linking.link_clusters(found, 0.8).where("window_id = 'b'").collect()
        assert {r.global_cluster for r in links} == expected


def test_target_rows_sum_to_one(spark):
    rng = np.random.default_rng(1)
    points = table(spark, [(i, "w", i % 2, rng.normal(size=4).tolist()) for i in range(20)])
    soft = clusters.soft_assign(points.drop("local_cluster"), clusters.centroids(points))
    for r in clusters.target_distribution(soft).collect():
        assert abs(sum(r.p) - 1) < 1e-9 and abs(sum(r.q) - 1) < 1e-9


def test_empty_clusters_are_zero(spark):
    points = table(spark, [(1, "w", 0, [1.0, 2.0]), (2, "w", 2, [3.0, 4.0])])
    assert {(r.local_cluster, r.size) for r in clusters.cluster_sizes(points, 4).collect()} == {(0, 1), (1, 0), (2, 1), (3, 0)}
    rows = {r.local_cluster: r.centroid for r in clusters.full_centroids(points, 3).collect()}
    assert rows == {0: [1.0, 2.0], 1: [0.0, 0.0], 2: [3.0, 4.0]}


def test_short_series_repeat_the_first_step_and_long_ones_keep_all_or_the_last(spark):
    rows = []
    for cluster, length in ((0, 1), (1, 2), (2, 30)):
        rows += [(cluster, f"w{s:02d}", s, length, "w01", float(s), 0.0, 0.0, 0.0) for s in range(1, length + 1)]
    df = spark.createDataFrame(
        rows, "global_cluster int, window_id string, step int, length int, first_window string, "
        + ", ".join(f"{f} double" for f in FEATURES)
    )
    got = {r.global_cluster: [s[0] for s in r.sequence] for r in trajectory.padded_sequences(df).collect()}
    assert got == {0: [1.0] * 3, 1: [1.0, 1.0, 2.0], 2: [float(s) for s in range(1, 31)]}
    recent = {r.global_cluster: [s[0] for s in r.sequence] for r in trajectory.padded_sequences(df, max_steps=24).collect()}
    assert recent == {**got, 2: [float(s) for s in range(7, 31)]}
    assert {r.global_cluster for r in trajectory.settled_clusters(df).collect()} == {2}
    young = df.where("global_cluster < 2")
    assert {r.global_cluster for r in trajectory.settled_clusters(young).collect()} == {0}


def test_shift_spans_a_gap(spark):
    rows = [
        (1, "w1", 0, [0.0, 0.0]), (2, "w1", 1, [9.0, 9.0]), (3, "w2", 1, [9.0, 8.0]),
        (4, "w3", 0, [3.0, 4.0]), (5, "w3", 1, [9.0, 8.0]),
    ]
    links = spark.createDataFrame(
        [(w, c, c, False) for w in ("w1", "w2", "w3") for c in (0, 1)],
        "window_id string, local_cluster int, global_cluster int, linked boolean",
    )
    got = {(r.global_cluster, r.window_id): r for r in trajectory.build_trajectories(table(spark, rows), links).collect()}
    assert got[(0, "w3")].centroid_shift == 5.0 and got[(0, "w3")].step == 2
    assert got[(1, "w2")].volume_share == 1.0 and abs(got[(1, "w2")].volume - np.log(2)) < 1e-12


def test_threshold_and_alert(spark):
    values = [1.0, 1.1, 0.9, 1.05, 1.0, 0.95]
    training = spark.createDataFrame([(v,) for v in values], "error double")
    cut = scoring.choose_threshold(training, 0.9, 0.1).first().threshold
    assert abs(cut - np.quantile(values, 0.9) * 1.1) < 1e-12
    errors = spark.createDataFrame(
        [(0, "w", 3, 1.0, 1.0, 1.0, 1.0, 1.0), (1, "w", 3, 2.0, 9.0, 2.0, 2.0, 5.0)],
        "global_cluster int, first_window string, length int, "
        + ", ".join(f"{f}_error double" for f in FEATURES) + ", error double",
    )
    ranked = scoring.rank_clusters(errors, scoring.choose_threshold(training, 0.9, 0.1))
    alerts = scoring.alerts(ranked).collect()
    assert [a.global_cluster for a in alerts] == [1] and alerts[0].per_feature["volume"] == 9.0


def silhouette_by_hand(x, labels):
    out = []
    for i in range(len(x)):
        d = ((x - x[i]) ** 2).sum(axis=1)
        own = labels == labels[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[own].sum() / (own.sum() - 1)
        b = min(d[labels == c].mean() for c in set(labels) if c != labels[i])
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def test_quality_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 5)) + np.repeat(np.eye(4, 5) * 3, 10, axis=0)
    labels = np.repeat(np.arange(4), 10)
    labels[0] = 4
    points = table(spark, [(i, "w", int(labels[i]), x[i].tolist()) for i in range(40)])
    assert abs(quality.silhouette(points).first().silhouette_sq - silhouette_by_hand(x, labels)) < 1e-9
    centres = {c: x[labels == c].mean(axis=0) for c in range(5)}
    s = {c: np.linalg.norm(x[labels == c] - centres[c], axis=1).mean() for c in range(5)}
    db = np.mean([max((s[i] + s[j]) / np.linalg.norm(centres[i] - centres[j]) for j in range(5) if j != i) for i in range(5)])
    assert abs(quality.davies_bouldin(points).first().davies_bouldin - db) < 1e-9
    between = sum((labels == c).sum() * ((centres[c] - x.mean(axis=0)) ** 2).sum() for c in range(5))
    within = sum(((x[labels == c] - centres[c]) ** 2).sum() for c in range(5))
    assert abs(quality.calinski_harabasz(points).first().calinski_harabasz - between / 4 / (within / 35)) < 1e-6
    lonely = table(spark, [(1, "w", 0, [1.0]), (2, "w", 1, [2.0])])
    assert quality.silhouette(lonely).first().silhouette_sq is None


def test_metrics_by_class_name(spark):
    pairs = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "b"), ("a", "d")]
    df = spark.createDataFrame(pairs, "t string, p string")
    per_class = {r.label: r for r in quality.per_class_metrics(quality.confusion(df, "t", "p")).collect()}
    assert per_class["a"].precision == 1.0 and abs(per_class["a"].recall - 1 / 3) < 1e-12
    assert per_class["d"].support == 0 and per_class["d"].f1 == 0.0
    overall = quality.overall_metrics(quality.per_class_metrics(quality.confusion(df, "t", "p"))).first()
    assert overall.accuracy == 0.4 and overall.n_classes == 4


def test_hashed_vectors(spark):
    texts = [(1, "The card was charged"), (2, "another text"), (3, "the CARD was charged"), (4, " ")]
    df = spark.createDataFrame(texts, "complaint_id long, t string")
    for blake in (False, True):
        got = {r.complaint_id: np.array(r.vector) for r in encoding.encode_hashed(df, F.col("t"), 64, blake).collect()}
        assert np.allclose(got[1], got[3]) and not np.allclose(got[1], got[2])
        assert abs(np.linalg.norm(got[1]) - 1) < 1e-12 and not got[4].any()
    sparse = encoding.hashed_buckets(df, F.col("t"), 64).where("complaint_id = 1").collect()
    dense = np.zeros(64)
    for r in sparse:
        dense[r.bucket] = r.weight
    first = {r.complaint_id: r.vector for r in encoding.encode_hashed(df, F.col("t"), 64).collect()}[1]
    assert np.allclose(dense / np.linalg.norm(dense), first)


def test_encoder_hook(spark):
    class Lengths:
        def encode(self, texts):
            return [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([(1, "abc"), (2, "")], "complaint_id long, t string")
    rows = encoding.encode_with(df, "t", Lengths).collect()
    assert {r.complaint_id: r.vector for r in rows} == {1: [3.0, 1.0], 2: [0.0, 1.0]}


def test_vector_features(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(10, 384))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "complaint_id long, vector array<double>")
    folded = df.select(vectors.fold(F.col("vector"), 12).alias("f")).first().f
    assert len(folded) == 12 and all(len(row) == 32 for row in folded)
    fused = np.array([r.fused for r in features.sequence_fold_features(df).orderBy("complaint_id").collect()])
    steps = x.reshape(10, 12, 32)
    assert np.allclose(fused, np.concatenate([x, steps.mean(axis=1), steps.max(axis=1)], axis=1))
    filtered = np.array([r.filtered for r in features.filter_features(df).orderBy("complaint_id").collect()])
    parts = []
    for k in (3, 5, 7):
        smooth = np.array([np.convolve(v, np.ones(k) / k, mode="same") for v in x])
        parts.append(smooth.reshape(10, 16, 24).mean(axis=2))
    want = np.concatenate([*parts, *[p.mean(axis=1, keepdims=True) for p in parts], *[p.max(axis=1, keepdims=True) for p in parts]], axis=1)
    assert np.allclose(filtered, want)


def test_uneven_pooling(spark):
    row = spark.createDataFrame([([float(i) for i in range(10)],)], "v array<double>")
    got = row.select(vectors.adaptive_average(F.col("v"), 4)).first()[0]
    assert got == [1.0, 3.0, 6.0, 8.0]
