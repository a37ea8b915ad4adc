import numpy as np
import pytest
from fixtures import COLUMNS, blank_letters, letters
from pyspark.sql import functions as F

from nascent.learning import classify, clustering, sequences
from nascent.learning.kernels import Adam, ClusteringModel, DenseAutoencoder, SequenceAutoencoder, sharpened
from nascent.learning.trainer import average, make_shards, minibatches
from nascent.operators import scoring
from nascent.plans import end_to_end
from nascent.session import settle


def check_gradient(f, flat, rng, count=60):
    _, grad = f(flat)
    for i in rng.choice(flat.size, size=min(count, flat.size), replace=False):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        slope = (f(flat + step)[0] - f(flat - step)[0]) / 2e-6
        assert abs(slope - grad[i]) < 1e-6, i


def test_gradients_match_finite_differences():
    rng = np.random.default_rng(0)
    network = DenseAutoencoder(7, (6, 5), 3)
    x = rng.normal(size=(9, 7))
    check_gradient(lambda w: network.loss_and_gradient(w, x), network.initial(1), rng)
    model = ClusteringModel(network, 4)
    flat = np.concatenate([network.initial(1), rng.normal(size=12)])
    q = model.assign(flat, x)
    p = sharpened(q, q.sum(axis=0))
    assert np.allclose(p.sum(axis=1), 1)
    check_gradient(lambda w: model.loss_and_gradient(w, x, p), flat, rng, 120)
    recurrent = SequenceAutoencoder(4, 5, 3)
    seq = rng.normal(size=(3, 6, 4))
    check_gradient(lambda w: recurrent.loss_and_gradient(w, seq), recurrent.initial(2), rng, 150)


def test_lean_steps_equal_the_plain_ones_to_the_last_bit():
    rng = np.random.default_rng(4)
    network = DenseAutoencoder(9, (8, 6), 5)
    model = ClusteringModel(network, 3)
    x, flat = rng.normal(size=(101, 9)), np.concatenate([network.initial(1), rng.normal(size=15)])
    q = model.assign(flat, x)
    p = sharpened(q, q.sum(axis=0))
    plain, adam, lean = flat.copy(), Adam(flat.size, 1e-2), model.tuner(flat, 1e-2)
    for epoch in range(4):
        for rows in minibatches(len(x), 16, np.random.default_rng(epoch)):
            loss, grad = model.loss_and_gradient(plain, x[rows], p[rows])
            adam.step(plain, grad)
            assert lean.step(x, p, rows, True) == loss
    assert np.array_equal(lean.weights(), plain) and not np.array_equal(plain, flat)


CORNERS = [(0, 3), (2, 7), (5, 9), (1, 11)]


def bundles(spark, each=36, dim=12, height=6.0):
    """Bundles of vectors: each has two coordinates of its own, the rest is jitter by a chirp."""
    rows = []
    for bundle, corner in enumerate(CORNERS):
        for n in range(each):
            i = bundle * each + n
            point = [0.8 * np.sin(0.37 * i * (c + 1) + c * c) for c in range(dim)]
            for c in corner:
                point[c] += height
            rows.append((7 * i + 1, "early" if n < each // 2 else "late", [float(v) for v in point], bundle))
    return spark.createDataFrame(rows, "complaint_id long, window_id string, vector array<double>, bundle int")


SETTINGS = clustering.ClusterSettings(
    k=4, latent=4, hidden=(16,), pretrain_epochs=60, max_epochs=40, refresh_every=10, rate=3e-3, batch=32,
    epochs_per_round=20, shards=2,
)


def test_averaging_is_weighted_and_two_level(spark):
    rows = [(i, float(1 + i % 3), float(i), [float(i), 1.0]) for i in range(150)]
    df = spark.createDataFrame(rows, "shard int, n double, loss double, w array<double>")
    weights, loss, n = average(df, 150)
    flat = average(df, 1)
    assert np.allclose(weights, flat[0]) and np.isclose(loss, flat[1])
    share = np.array([r[1] for r in rows])
    want = (share * np.arange(150)).sum() / share.sum()
    assert np.allclose(weights, [want, 1.0]) and abs(loss - want) < 1e-9 and n == share.sum()


def test_bundles_are_found(spark):
    df = bundles(spark)
    shards = make_shards(df, "complaint_id", 2)
    network = DenseAutoencoder(12, SETTINGS.hidden, SETTINGS.latent)
    weights, losses = clustering.train_autoencoder(shards, network, SETTINGS)
    x = np.array([r.vector for r in df.collect()])
    assert network.row_errors(weights, x).mean() < 0.9 * ((x - x.mean(axis=0)) ** 2).mean()
    assert losses[-1] < losses[0]
    model = ClusteringModel(network, 4)
    centres = clustering.initial_centroids(clustering.encode(shards, network, weights), 4, 3, 23)
    tuned, facts = clustering.fine_tune(
        shards, model, np.concatenate([weights, centres.ravel()]), SETTINGS, SETTINGS.max_epochs
    )
    placed = clustering.assign_rows(shards, model, tuned)
    pairs = placed.select("bundle", "local_cluster").distinct().collect()
    assert len(pairs) == 4 and len({p.local_cluster for p in pairs}) == 4
    assert facts["epochs"] <= SETTINGS.max_epochs


@pytest.mark.parametrize("steps", [200_000, 30])
def test_one_shard_tunes_without_a_job_per_round(spark, monkeypatch, steps):
    """The same weights as by rounds, in jobs that follow the steps instead of the rounds."""
    network = DenseAutoencoder(12, SETTINGS.hidden, SETTINGS.latent)
    model, rng = ClusteringModel(network, 4), np.random.default_rng(3)
    start = np.concatenate([network.initial(2), rng.normal(size=16)])
    shard = make_shards(bundles(spark), "complaint_id", 1)
    context = spark.sparkContext
    monkeypatch.setattr(clustering, "JOB_STEPS", steps)
    context.setJobGroup(f"alone {steps}", "tuning")
    tuned, facts = clustering.fine_tune(shard, model, start, SETTINGS, 35)
    jobs = len(context.statusTracker().getJobIdsForGroup(f"alone {steps}"))
    context.setJobGroup("other", "other")
    by_rounds, same = clustering._tune_in_rounds(shard, model, start, SETTINGS, 35, "vector")
    assert np.array_equal(tuned, by_rounds) and facts == same and facts["epochs"] > 10
    # Five steps an epoch, ten epochs between two refreshes: four intervals at most.
    assert jobs == 1 if steps > 1_000 else 1 < jobs <= 5


@pytest.mark.parametrize("size", [7, 10_000])
def test_training_does_not_depend_on_arrow_batches(spark, size):
    network = DenseAutoencoder(12, (8,), 3)
    quick = clustering.ClusterSettings(k=4, latent=3, hidden=(8,), pretrain_epochs=4, epochs_per_round=2, batch=16)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, "10000")
    try:
        results = []
        for records in (str(size), "50"):
            spark.conf.set(key, records)
            shards = make_shards(bundles(spark).drop("bundle"), "complaint_id", 2)
            results.append(clustering.train_autoencoder(shards, network, quick)[0])
    finally:
        spark.conf.set(key, before)
    assert np.array_equal(*results)


def test_every_row_of_every_window_is_assigned(spark):
    columns = "complaint_id long, window_id string, vector array<double>"
    few = [(90_001, "a before", [1.0] * 12), (90_002, "z after", [0.0] * 12), (90_003, "z after", [6.0] * 12)]
    df = bundles(spark).drop("bundle").unionByName(spark.createDataFrame(few, columns))
    found = clustering.cluster_windows(df, SETTINGS)
    placed = found.assignments.collect()
    assert sorted(r.complaint_id for r in placed) == sorted(r.complaint_id for r in df.collect())
    assert len({r.global_cluster for r in placed}) == 4
    summary = {r.window_id: r for r in found.summary.collect()}
    assert {w: r.trained for w, r in summary.items()} == {"a before": False, "early": True, "late": True, "z after": False}
    assert {w: r.n_points for w, r in summary.items()} == {"a before": 1, "early": 72, "late": 72, "z after": 2}
    assert all(sum(r.cluster_sizes) == r.n_points for r in summary.values())
    assert set(summary["late"].local_to_global) == {0, 1, 2, 3} and summary["late"].recon_loss > 0
    again = clustering.cluster_windows(df, clustering.ClusterSettings(**{**SETTINGS.__dict__, "replay": 25}))
    assert again.assignments.count() == len(placed)
    alone = clustering.cluster_windows(spark.createDataFrame(few, columns), SETTINGS)
    assert alone.assignments.count() == 3 and [r["trained"] for r in alone.rounds] == [False, True]


def windows_of(spark, count, each=40):
    rng = np.random.default_rng(21)
    rows = [(w * each + i, f"w{w}", (rng.normal(size=5) + 4 * (i % 3)).tolist()) for w in range(count) for i in range(each)]
    return spark.createDataFrame(rows, "complaint_id long, window_id string, vector array<double>")


QUICK = clustering.ClusterSettings(
    k=3, latent=2, hidden=(6,), pretrain_epochs=3, max_epochs=4, refresh_every=2, kmeans_starts=1, replay=15
)


def test_later_ends_cost_only_their_own_windows(spark, tmp_path, monkeypatch):
    df, trained, step = windows_of(spark, 4), [], clustering.cluster_step
    monkeypatch.setattr(clustering, "cluster_step", lambda rows, n, *rest: trained.append(n) or step(rows, n, *rest))

    def placed(found):
        return sorted((r.complaint_id, r.window_id, r.local_cluster, r.global_cluster) for r in found.assignments.collect())

    # The last window of every cut-off holds a part of its rows.
    cuts = [F.col("complaint_id") < end for end in (75, 115, 160)]
    states = str(tmp_path / "states")
    chained = [placed(clustering.cluster_windows(df.where(cut), QUICK, states)) for cut in cuts]
    # Two windows, then two more as the second has become whole, then the third whole and the last.
    assert trained == [40, 35, 40, 35, 40, 40]
    again = placed(clustering.cluster_windows(df, QUICK, states))
    assert len(trained) == 6 and again == chained[2]
    alone = placed(clustering.cluster_windows(df.where(cuts[1]), QUICK))
    assert len(trained) == 9 and alone == chained[1]


def test_the_reservoir_is_a_sample_of_all_windows_so_far(spark):
    df, before = windows_of(spark, 3), None
    for w in range(3):
        own = df.where(F.col("window_id") == f"w{w}").repartition(w + 1)
        before = settle(clustering.merged_reservoir(before, own, QUICK))
        whole = clustering.merged_reservoir(None, df.where(F.col("window_id") <= f"w{w}"), QUICK)
        ids = sorted(r.complaint_id for r in before.collect())
        assert len(ids) == 15 and ids == sorted(r.complaint_id for r in whole.collect())
    assert clustering.merged_reservoir(None, df.limit(4), QUICK).count() == 4


def test_shifts_and_bursts_stand_out(spark):
    """Steady series train; a level shift and a burst of variance score above all of them."""
    steps, usual = 9, 10
    series = []
    for c in range(usual + 2):
        line = [[0.4 + 0.02 * ((3 * t + 5 * c + f) % 4) for f in range(4)] for t in range(steps)]
        if c == usual:
            line = [[v + (1.5 if t >= 5 else 0.0) for v in step] for t, step in enumerate(line)]
        if c == usual + 1:
            line = [[v + (0.9 if (t + f) % 2 else -0.9) for f, v in enumerate(step)] for t, step in enumerate(line)]
        series.append((c, "w", steps, line))
    df = spark.createDataFrame(series, "global_cluster int, first_window string, length int, sequence array<array<double>>")
    model, weights, losses = sequences.train_sequences(df.where(f"global_cluster < {usual}"), sequences.SMALL)
    errors = {r.global_cluster: r.error for r in scoring.sequence_errors(sequences.rebuild(df, model, weights)).collect()}
    highest = max(errors[c] for c in range(usual))
    assert errors[usual] > 5 * highest and errors[usual + 1] > 10 * highest
    own = np.array(series[2][3])
    assert errors[2] == pytest.approx(((own - model.rebuild(weights, own[None])[0]) ** 2).mean())


@pytest.fixture(scope="module")
def classes(spark):
    """The bundles under names, of which three are kept."""
    named = bundles(spark, each=60, dim=16, height=3.0).where("bundle < 3")
    return classify.split(named.select("complaint_id", F.concat(F.lit("kind "), "bundle").alias("label"), "vector"), "label")


def test_classifiers_beat_chance(classes):
    table = classify.compare(
        classes,
        "label",
        {
            "mlp": lambda p: classify.train_mlp(p, "label", hidden=(8,), iterations=(10, 30)),
            "trees": lambda p: classify.train_boosted(p, "label", trees=3, depth=3, fold=4),
        },
    ).collect()
    assert {r.model for r in table} == {"mlp", "trees"}
    assert all(r.accuracy >= 0.75 and r.n_test == 36 for r in table)


def test_classes_are_only_those_seen(classes):
    indexed = classify._fit(
        classify._with_features(classes, "vector").where("part = 'train'"),
        "label",
        classify.MultilayerPerceptronClassifier(layers=[16, 3], maxIter=2, labelCol="_y", predictionCol="_predicted"),
    )
    assert indexed.stages[0].labels == ["kind 0", "kind 1", "kind 2"] and indexed.stages[0].getHandleInvalid() == "error"


def test_whole_run_and_backtest(spark):
    """Dates stay as they were written, in three layouts, with one that cannot be read."""
    unread = (99_999, "once", "Water meter", None, None, "A letter whose day nobody can read at all", "post", False)
    raw = spark.createDataFrame([*letters(), *blank_letters(), unread], COLUMNS)
    raw = raw.withColumnRenamed("consumer_complaint_narrative", "narrative text")
    small = clustering.ClusterSettings(
        k=3, latent=4, hidden=(16,), pretrain_epochs=10, max_epochs=10, refresh_every=5, kmeans_starts=1
    )
    settings = end_to_end.RunSettings(
        window="Q", min_words=3, dim=64, quantile=0.5, margin=0.0, cluster=small, sequence=sequences.SMALL
    )
    done = end_to_end.run(raw, settings)
    ranked = done.ranked.orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == list(range(1, len(ranked) + 1))
    assert sorted((r.error for r in ranked), reverse=True) == [r.error for r in ranked]
    assert end_to_end.label_clusters(done).count() > 0
    cases = spark.createDataFrame(
        [
            ("pumps", "Heat pump grant", None, "2019-01-01", "given"),
            ("early", "Water meter", None, "2017-01-01", "before all data"),
            ("absent", "zzzz qqqq", None, "2019-01-01", "given"),
        ],
        "name string, product string, sub_issue string, recognition_date string, recognition_basis string",
    )
    results = {r["name"]: r for r in end_to_end.backtest(raw, cases, settings).collect()}
    assert results["early"].notes.startswith("no pre-recognition")
    assert not results["absent"].matched
    if results["pumps"].matched:
        assert results["pumps"].first_alert_window < "2019Q1"
    assert end_to_end.backtest(raw, cases.limit(0), settings).count() == 0
