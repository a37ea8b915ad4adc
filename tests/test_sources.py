import csv
import gzip
import random

import pandas as pd
from pyspark.sql import functions as F

from nascent.operators import dashboard
from nascent.sources import quoted, raw, sinks
from nascent.sources.vector_store import VectorStore


def test_vectors_are_stored_once_and_looked_up_by_id(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.createDataFrame([(1, [1.0]), (2, [2.0])], "complaint_id long, vector array<double>")

    path = str(tmp_path / "vectors")
    for _ in range(2):
        stored = raw.load_vectors(spark, path, make)
    assert len(made) == 1
    assert stored.count() == 2
    assert raw.load_vectors(spark, path, make, refresh=True).count() == 2 and len(made) == 2
    ids = spark.createDataFrame([(1,), (3,)], "complaint_id long")
    found, missing = raw.look_up_vectors(ids, raw.load_vectors(spark, path, make), "complaint_id")
    assert [r.vector for r in found.collect()] == [[1.0]] and missing.first().missing == 1


def test_json_keeps_nested_columns_and_nulls(spark, tmp_path):
    df = spark.createDataFrame([(2, None, ("x", 1))], "b int, a string, c struct<k:string,n:int>")
    sinks.write_json(df, str(tmp_path / "json"))
    line = spark.read.text(str(tmp_path / "json")).first()[0]
    assert line == '{"a":null,"b":2,"c":{"k":"x","n":1}}'


def test_dashboard_files(spark, tmp_path):
    points = spark.createDataFrame([("1", 0, ("t",)), ("2", 1, ("u",))], "id string, cluster_id int, metadata struct<title:string>")
    clusters = spark.createDataFrame([(0, "a"), (1, "b")], "id int, label string")
    quality = spark.createDataFrame([(0.5,)], "silhouette_sq double")
    metrics = dashboard.dataset_metrics(points, clusters, quality)
    row = metrics.first()
    assert (row.total_points, row.total_clusters, row.noise_count) == (2, 2, 0)
    path = str(tmp_path / "board")
    sinks.write_dashboard(points, clusters, metrics, path)
    assert spark.read.json(f"{path}/points").where("cluster_id = 1").first().metadata.title == "u"
    ranked = spark.createDataFrame([(1, 7)], "rank int, global_cluster int")
    sinks.write_ranked(ranked, quality.select(F.col("silhouette_sq").alias("threshold")), path)
    assert spark.read.json(f"{path}/threshold").first().threshold == 0.5


def test_csv_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text('Complaint ID,Issue\n1,"two\nlines"\n2,x\n')
    stream = raw.read_complaint_stream(spark, str(tmp_path / "in"), ["Complaint ID", "Issue"])
    out = str(tmp_path / "out")
    query = (
        stream.writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert {(r.complaint_id, r.issue) for r in spark.read.parquet(out).collect()} == {("1", "two\nlines"), ("2", "x")}


def test_one_quoted_file_gives_the_same_rows_from_one_and_many_ranges(spark, tmp_path):
    rng = random.Random(8)
    parts = ["plain", "two\nlines", 'a "quoted" word', "crlf\r\ninside", "", "comma, here", "\n\n", '"', "ü😀\n", "x" * 300, "tail\r"]
    rows = [(str(i), "".join(rng.choices(parts, k=3)), rng.choice(parts)) for i in range(120)]
    path = tmp_path / "one.csv"
    with path.open("w", newline="", encoding="utf-8") as out:
        writer = csv.writer(out, quoting=csv.QUOTE_ALL)
        writer.writerow(["Complaint ID", "a\nname", "Issue"])
        writer.writerows(rows)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "2k", "333", "64"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            found = quoted.read_quoted(spark, str(path))
            assert found.columns == ["Complaint ID", "a\nname", "Issue"]
            # Empty fields are null, quoted or not, as in Spark's own reader.
            assert sorted(tuple(v or "" for v in r) for r in found.collect()) == sorted(rows)
            if size == "64":
                assert spark.read.text(str(path)).rdd.getNumPartitions() > 64
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_quoted_files_with_headers_blank_lines_and_short_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_bytes(b'\xef\xbb\xbfid,text\r\n1,"x\r\ny"\r\n\r\n2\r\n3,z,more\r\n')
    (tmp_path / "in" / "b.csv").write_bytes(b'id,text\n4,"no end of line"')
    (tmp_path / "in" / "c.csv").write_bytes(b"id,text\n")
    with gzip.open(tmp_path / "in" / "d.csv.gz", "wt") as out:
        out.write('id,text\n5,"a\nb"\n')
    found = quoted.read_quoted(spark, str(tmp_path / "in"))
    assert found.columns == ["id", "text"]
    got = sorted(((r.id, r.text) for r in found.collect()), key=lambda r: r[0])
    assert got == [("1", "x\r\ny"), ("2", None), ("3", "z"), ("4", "no end of line"), ("5", "a\nb")]


def test_a_store_encodes_only_new_and_changed_texts(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def encode(new):
        def run(batches):
            for batch in batches:
                seen.add(len(batch))
                yield pd.DataFrame({"entry": batch["entry"], "vector": [[float(len(t))] for t in batch["text"]]})

        return new.mapInPandas(run, "entry binary, vector array<double>")

    def texts(rows):
        return spark.createDataFrame(rows, "complaint_id long, t string")

    def got(store, rows):
        found, missing = store.vectors(texts(rows), "t")
        return {r.complaint_id: r.vector[0] for r in found.collect()}, missing.first().missing

    store = VectorStore(str(tmp_path / "store"), "length", encode, most_batches=4)
    first = [(1, "a"), (2, "bb"), (3, "bb"), (4, None), (5, "")]
    assert got(store, first) == ({}, 5)
    assert store.update(texts(first), "t") == 3 and seen.value == 3
    assert store.update(texts(first), "t") == 0 and seen.value == 3
    changed = [(1, "a"), (2, "changed"), (6, "bb")]
    assert store.update(texts(changed), "t") == 1 and seen.value == 4
    assert got(store, first + changed[1:2]) == ({1: 1.0, 2: 7.0, 3: 2.0, 5: 0.0} | {2: 7.0}, 1)
    # Another encoder shares nothing with it.
    other = VectorStore(store.path, "other", encode, most_batches=4)
    assert other.update(texts(first), "t") == 3 and seen.value == 7
    # The fourth batch compacts; what was there stays, once.
    assert store.state(spark) == (0, 3)
    assert store.update(texts([(9, "ninth text")]), "t") == 1
    assert store.state(spark) == (1, 1)
    assert got(store, [*changed, (9, "ninth text")]) == ({1: 1.0, 2: 7.0, 6: 2.0, 9: 10.0}, 0)
    assert store.entries(spark).count() == 8 == store.entries(spark).select("entry").distinct().count()
    # A batch that was not written to its end is written again.
    spark.createDataFrame([(b"x", [0.0])], "entry binary, vector array<double>").write.parquet(f"{store.path}/generation=1/batch=1")
    (tmp_path / "store/generation=1/batch=1/_SUCCESS").unlink()
    assert store.state(spark) == (1, 1) and store.update(texts([(10, "tenth")]), "t") == 1
    assert got(store, [(10, "tenth")]) == ({10: 5.0}, 0) and store.entries(spark).count() == 9
