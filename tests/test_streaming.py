from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from nascent.learning import clustering
from nascent.operators.panel import NARRATIVE
from nascent.streaming import flows


def test_volume_over_several_files_equals_the_batch(spark, tmp_path, data):
    events = spark.read.parquet(f"{data}/events.parquet").select("ts", "event_type")
    source = str(tmp_path / "events")
    events.repartition(4).write.parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    folder = str(tmp_path / "out")
    flows.volume(stream, folder, "ts", ["event_type"]).awaitTermination()
    assert spark.read.parquet(f"{folder}/volume").select("batch").distinct().count() > 1
    got = {(r.window_start.date(), r.event_type): r.n for r in flows.current_volume(spark, folder, ["event_type"]).collect()}
    want = {
        (r.d, r.event_type): r.n
        for r in events.groupBy(F.to_date("ts").alias("d"), "event_type").agg(F.count("*").alias("n")).collect()
    }
    assert got == want


def test_ingest_counts_and_appends(spark, tmp_path):
    rows = [(i, "2021-01-01", "p", "one two three" if i % 2 else " ") for i in range(20)]
    columns = f"complaint_id long, date_received string, product string, {NARRATIVE} string"
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, columns).repartition(2).write.parquet(source)
    stream = spark.readStream.schema(columns).option("maxFilesPerTrigger", 1).parquet(source)
    folder = str(tmp_path / "out")
    flows.ingest(stream, folder, min_words=3).awaitTermination()
    row = flows.ingest_totals(spark, folder).first()
    assert (row.raw, row.kept) == (20, 10)
    assert spark.read.parquet(f"{folder}/panel").count() == 10
    # Nothing new: a restart adds nothing.
    flows.ingest(stream, folder, min_words=3).awaitTermination()
    assert flows.ingest_totals(spark, folder).first().raw == 20


def test_live_clusters_grow_and_spawn_in_order(spark, tmp_path):
    known = spark.createDataFrame([(0, "Mortgage", 5, ["escrow", "servicer"])], "id int, label string, count long, keywords array<string>")
    folder = str(tmp_path / "live")
    flows.start_clusters(known, folder)
    columns = f"complaint_id long, {NARRATIVE} string, category string"
    source = str(tmp_path / "in")
    first = [(1, "escrow servicer again", ""), (2, "bitcoin kiosk trouble", "Crypto"), (3, "unknown matter entirely", "")]
    spark.createDataFrame(first, columns).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(columns).parquet(source)
    flows.live_clusters(stream, folder)
    state = {r.id: r for r in flows.live_state(spark, folder).collect()}
    assert state[0]["count"] == 6 and state[1].label == "Emergent: Crypto" and state[2].label == "Emergent Cluster #3"
    # A later batch meets the clusters the first one opened.
    spark.createDataFrame([(4, "unknown matter entirely", "")], columns).coalesce(1).write.mode("append").parquet(source)
    flows.live_clusters(spark.readStream.schema(columns).parquet(source), folder)
    state = {r.id: r for r in flows.live_state(spark, folder).collect()}
    assert len(state) == 3 and state[2]["count"] == 2
    placed = {r.complaint_id: r.cluster_id for r in flows.live_places(spark, folder).collect()}
    assert placed == {1: 0, 2: 1, 3: 2, 4: 2}


WINDOWED = "complaint_id long, window_id string, vector array<double>, event_time timestamp, window_end timestamp"


def dated(key, window, vector, day=15):
    """A row of a month, on a day of it."""
    year, month = map(int, window.split("-"))
    return key, window, vector, datetime(year, month, day), datetime(year + month // 12, month % 12 + 1, 1)


def test_closed_windows_are_clustered_once(spark, tmp_path):
    rng = np.random.default_rng(8)
    columns, source = WINDOWED, str(tmp_path / "in")
    for w in range(3):
        rows = [dated(w * 100 + i, f"2024-0{w + 1}", rng.normal(size=6).tolist()) for i in range(30)]
        spark.createDataFrame(rows, columns).coalesce(1).write.mode("append").parquet(source)
    settings = clustering.ClusterSettings(
        k=3, latent=2, hidden=(8,), pretrain_epochs=5, max_epochs=5, refresh_every=5, kmeans_starts=1
    )
    folder = str(tmp_path / "out")
    stream = spark.readStream.schema(columns).option("maxFilesPerTrigger", 1).parquet(source)
    flows.cluster_closed_windows(stream, folder, 6, settings).awaitTermination()
    early = flows.streamed_assignments(spark, folder, settings)
    assert {r.window_id for r in early.select("window_id").distinct().collect()} == {"2024-01", "2024-02"}
    flows.flush_windows(spark, folder, 6, settings)
    done = flows.streamed_assignments(spark, folder, settings)
    assert done.count() == 90 and done.select("complaint_id").distinct().count() == 90


def test_small_and_late_windows_lose_no_row(spark, tmp_path):
    columns = WINDOWED
    point = lambda i: [float((i * k) % 7) for k in range(1, 6)]
    batches = [
        [(1, "2024-01", point(1))],  # too small, and before any weights
        [(100 + i, "2024-02", point(i)) for i in range(24)],
        [(200 + i, "2024-03", point(3 * i)) for i in range(24)] + [(2, "2024-01", point(2))],
        [(300, "2024-04", point(5)), (150, "2024-02", point(50)), (3, "2024-01", point(3))],
    ]
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    settings = clustering.ClusterSettings(
        k=3, latent=2, hidden=(6,), pretrain_epochs=4, max_epochs=4, refresh_every=4, kmeans_starts=1
    )
    for rows in batches:
        spark.createDataFrame([dated(*row) for row in rows], columns).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(columns).parquet(source)
        flows.cluster_closed_windows(stream, folder, 5, settings).awaitTermination()
    flows.flush_windows(spark, folder, 5, settings)
    done = flows.streamed_assignments(spark, folder, settings).collect()
    assert sorted(r.complaint_id for r in done) == sorted(row[0] for rows in batches for row in rows)
    assert {r.complaint_id: r.window_id for r in done} == {row[0]: row[1] for rows in batches for row in rows}


def test_one_or_many_batches_and_restarts_give_the_same_clusters(spark, tmp_path):
    known = spark.createDataFrame(
        [(0, "Mortgage", 5, ["escrow", "servicer"]), (1, "Emergent: Crypto", 1, ["trouble", "kiosk", "bitcoin"])],
        "id int, label string, count long, keywords array<string>",
    )
    columns = f"complaint_id long, {NARRATIVE} string, category string"
    texts = [(i, "strange kiosk swallowed banknotes", "") for i in (9, 2, 5)]
    texts += [(6, "bitcoin kiosk trouble", "Crypto"), (7, "escrow servicer again", ""), (8, None, None), (None, "no id", "")]
    texts += [(3, "swallowed banknotes, strange kiosk", ""), (4, "bitcoin kiosk trouble", "Wallets")]
    states = []
    for name, batches in (("one", [texts]), ("restarted", [texts[:4], texts[4:]]), ("files", [texts[:2], texts[2:7], texts[7:]])):
        source, folder = str(tmp_path / f"in-{name}"), str(tmp_path / name)
        flows.start_clusters(known, folder)
        for rows in batches:
            spark.createDataFrame(rows, columns).coalesce(1).write.mode("append").parquet(source)
            if name != "files":
                flows.live_clusters(spark.readStream.schema(columns).parquet(source), folder)
        if name == "files":
            stream = spark.readStream.schema(columns).option("maxFilesPerTrigger", 1).parquet(source)
            flows.live_clusters(stream, folder)
            assert spark.read.parquet(f"{folder}/placed").select("batch").distinct().count() == 3
        state = sorted((r.id, r.label, r["count"], tuple(r.keywords)) for r in flows.live_state(spark, folder).collect())
        places = sorted((r.complaint_id, r.cluster_id) for r in flows.live_places(spark, folder).collect())
        states.append((state, places))
    assert states[0] == states[1] == states[2]
    state, places = states[0]
    assert [(i, label, n) for i, label, n, _ in state] == [
        (0, "Mortgage", 6), (1, "Emergent: Crypto", 2), (2, "Emergent: Novel Fraud Pattern", 4), (3, "Emergent: Wallets", 1), (4, "Emergent Cluster #5", 1)
    ]
    # The keywords are those of the first text by id.
    assert state[2][3] == ("strange", "kiosk", "swallowed", "banknotes")
    assert places == [(2, 2), (3, 2), (4, 3), (5, 2), (6, 1), (7, 0), (8, 4), (9, 2)]


def test_many_clusters_grow_without_python_for_each(spark, tmp_path):
    folder, columns = str(tmp_path / "live"), "_set string, _kind string, first long, texts long, keywords array<string>"
    # The second batch meets half of the clusters again, some by an earlier text, some by the same one.
    for number, known in enumerate((range(2000), range(1000, 3000))):
        rows = [(f"a\u0001w{i}", "Emergent Cluster #", i - number * (i % 2), 2, [("a", "b")[number], f"w{i}"]) for i in known]
        spark.createDataFrame(rows, columns).repartition(3).write.parquet(f"{folder}/novel/batch={number}")
        query = flows.grow_clusters(spark, folder)
        query.awaitTermination()
        used = {op["operatorName"] for progress in query.recentProgress for op in progress["stateOperators"]}
        assert used == {"stateStoreSave"}
    grown = [(r.batch, int(r["keywords"][1][1:]), r["first"], r.texts, r["keywords"][0]) for r in spark.read.parquet(f"{folder}/grown").collect()]
    # Only what a batch touches is written; the first text by id tells the keywords, of equal ids that of the earlier batch.
    again = [(1, i, i - i % 2, 4, ("a", "b")[i % 2]) for i in range(1000, 2000)]
    fresh = [(1, i, i - i % 2, 2, "b") for i in range(2000, 3000)]
    assert sorted(grown) == [(0, i, i, 2, "a") for i in range(2000)] + again + fresh


def test_a_batch_tried_again_counts_once(spark, tmp_path):
    known = spark.createDataFrame([(0, "Mortgage", 5, ["escrow"])], "id int, label string, count long, keywords array<string>")
    columns = f"complaint_id long, {NARRATIVE} string, category string"
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    flows.start_clusters(known, folder)
    spark.createDataFrame([(1, "unknown matter entirely", "")], columns).coalesce(1).write.parquet(source)
    flows.live_clusters(spark.readStream.schema(columns).parquet(source), folder)
    # The placing query lost its last commit: its first batch is run again on restart.
    import shutil

    shutil.move(f"{folder}/progress/commits/0", str(tmp_path / "lost"))
    (tmp_path / "out/progress/commits/.0.crc").unlink(missing_ok=True)
    flows.live_clusters(spark.readStream.schema(columns).parquet(source), folder)
    assert [(r.id, r["count"]) for r in flows.live_state(spark, folder).orderBy("id").collect()] == [(0, 5), (1, 1)]


def test_rows_out_of_order_train_their_window_within_the_lateness(spark, tmp_path):
    """Shuffled files give the clusters of ordered ones; what comes after the lateness is placed."""
    rng = np.random.default_rng(12)
    point = {i: rng.normal(size=4).tolist() for i in range(90)}
    first = [dated(i, "2024-01", point[i], 1 + i % 28) for i in range(30)]
    second = [dated(i, "2024-02", point[i], 1 + i % 28) for i in range(30, 60)]
    third = [dated(i, "2024-04", point[i], 1 + i % 28) for i in range(60, 90)]
    late = [dated(200, "2024-01", point[3])]
    settings = clustering.ClusterSettings(
        k=3, latent=2, hidden=(6,), pretrain_epochs=4, max_epochs=4, refresh_every=4, kmeans_starts=1
    )
    results = []
    for name, files in (
        ("ordered", [first, second, third + late]),
        ("shuffled", [second[15:] + first[:9], first[9:] + second[:15], third + late]),
    ):
        source, folder = str(tmp_path / f"in-{name}"), str(tmp_path / name)
        for number, rows in enumerate(files):
            spark.createDataFrame(rows, WINDOWED).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(WINDOWED).parquet(source)
            flows.cluster_closed_windows(stream, folder, 4, settings, lateness="30 days").awaitTermination()
            # A row of February has come, but January stays open for another thirty days.
            assert flows.path_exists(spark, f"{folder}/weights") == (number == 2)
        assert {r[0] for r in spark.read.parquet(f"{folder}/weights").select("window_id").collect()} == {"2024-01", "2024-02"}
        flows.cluster_closed_windows(stream, folder, 4, settings, lateness="30 days").awaitTermination()
        flows.flush_windows(spark, folder, 4, settings)
        rows = flows.streamed_assignments(spark, folder, settings).collect()
        assert len(rows) == 91
        results.append(sorted((r.complaint_id, r.window_id, r.local_cluster, r.global_cluster) for r in rows))
    assert results[0] == results[1]


def test_the_watermark_never_goes_back(spark, tmp_path):
    folder = str(tmp_path / "out")
    for number, day in enumerate((9, 20, 3)):
        spark.createDataFrame([(datetime(2024, 1, day),)], "latest timestamp").write.parquet(f"{folder}/times/batch={number}")
    spark.createDataFrame([(None,)], "latest timestamp").write.parquet(f"{folder}/times/batch=3")
    reached = [flows.watermark(spark, folder, "2 days", n) for n in range(-1, 4)]
    assert reached == [None, datetime(2024, 1, 7), *[datetime(2024, 1, 18)] * 3]
