import hashlib

import pytest
from fixtures import file_rows
from pyspark.sql import functions as F

from nascent import session
from nascent.operators import numbering, panel, sampling, topk
from nascent.sources import raw, sinks


def key(seed, i):
    return hashlib.md5(f"{seed}:{i}".encode()).hexdigest()


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most of the rows."""
    return spark.range(3000).select(
        F.col("id").alias("complaint_id"),
        F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g"),
    ).persist()


@pytest.mark.parametrize("prefix", [1, 4])
def test_cut_keys_equal_a_full_sort(spark, skewed, prefix):
    keyed = skewed.withColumn("k", F.md5(F.concat(F.lit("5:"), F.col("complaint_id").cast("string")).cast("binary")))
    cuts = {r.g: r.cut_key for r in sampling.cut_keys(keyed, ["g"], "k", F.expr("group_rows div 3"), prefix).collect()}
    groups = {}
    for r in skewed.collect():
        groups.setdefault(r.g, []).append(key(5, r.complaint_id))
    assert cuts == {g: sorted(ks)[len(ks) // 3 - 1] for g, ks in groups.items()}


def test_quota_zero_keeps_nothing_and_large_quota_keeps_all(spark, skewed):
    keyed = skewed.withColumn("k", F.md5(F.col("complaint_id").cast("string").cast("binary")))
    none = sampling.flag_smallest(keyed, ["g"], "k", F.lit(0), "f")
    assert none.where("f").count() == 0 and none.count() == 3000
    assert sampling.flag_smallest(keyed, ["g"], "k", F.lit(10**6), "f").where("f").count() == 3000


def test_exact_target_does_not_depend_on_partitions(spark, skewed):
    one = sampling.stratified_flags(skewed.repartition(1), ["g"], 500).where("sampled")
    many = sampling.stratified_flags(skewed.repartition(13), ["g"], 500).where("sampled")
    ids = {r.complaint_id for r in one.collect()}
    assert len(ids) == 500
    assert ids == {r.complaint_id for r in many.collect()}
    assert one.select("g").distinct().count() == skewed.select("g").distinct().count()


def test_target_above_size_keeps_everything(spark, skewed):
    assert sampling.stratified_flags(skewed, ["g"], 5000).where("sampled").count() == 3000


def test_split_is_stratified(spark, skewed):
    rows = sampling.stratified_split(skewed, "g").groupBy("g").agg(
        F.count("*").alias("n"), F.sum(F.col("is_test").cast("int")).alias("t")
    ).collect()
    assert all(r.t == int(0.2 * r.n + 0.5) for r in rows)
    parts = sampling.three_way_split(skewed, "g").groupBy("part").count().collect()
    assert {r.part for r in parts} == {"train", "validation", "test"} and sum(r["count"] for r in parts) == 3000


def test_sample_of_a_delivered_file(spark, tmp_path):
    import csv

    header, rows = file_rows()
    path = tmp_path / "letters.csv"
    with open(path, "w", newline="") as f:
        csv.writer(f).writerows([header, *rows])
    df = raw.read_complaints(spark, str(path))
    assert df.count() == len(rows)
    assert df.columns == ["complaint_id", "date_received", "product", "issue", "consumer_complaint_narrative", "remarks"]
    long = sum(len(r[4].split()) >= 8 for r in rows)
    sample = sampling.sample_raw(df, target=31, min_words=8)
    ids = sorted(r.complaint_id for r in sample.collect())
    assert len(ids) == len(set(ids)) == 31 < long
    assert ids == sorted(r.complaint_id for r in sampling.sample_raw(df.repartition(5), target=31, min_words=8).collect())
    assert {r.product for r in sample.collect()} == {"Water meter", "Ferry ticket", "Heat pump grant"}
    assert sampling.sample_raw(df, target=10_000, min_words=8).count() == long
    out = str(tmp_path / "sample.csv")
    sinks.write_csv(sample, out, ["date_received", "complaint_id"])
    told = {r[0]: r[4] for r in rows}
    again = raw.read_complaints(spark, out).collect()
    assert {r.complaint_id: r.consumer_complaint_narrative for r in again} == {i: told[i] for i in ids}


def test_columns_under_other_names(spark):
    df = spark.createDataFrame([("t", "n", "1", "d")], "`Narrative text` string, issue string, `Complaint No id` string, `Date it was received` string")
    assert raw.standard_columns(df).columns == ["consumer_complaint_narrative", "issue", "complaint_id", "date_received"]
    assert raw.find_column(df, "issue") == "issue" and raw.find_column(df, "company") is None


def test_null_strata_are_strata(spark):
    rows = [(i, None if i % 4 == 0 else "a") for i in range(200)]
    df = spark.createDataFrame(rows, "complaint_id long, g string")
    split = sampling.stratified_split(df, "g").collect()
    assert len(split) == 200
    assert sum(r.is_test for r in split if r.g is None) == 10 and sum(r.is_test for r in split if r.g) == 30


def test_repeated_ids_do_not_swell_a_sample(spark):
    rows = [(i % 8, f"text {i}") for i in range(40)]
    df = spark.createDataFrame(rows, "complaint_id long, t string")
    assert sampling.random_sample(df, 11, unique_ids=False).count() == 11
    flags = sampling.stratified_flags(df.withColumn("g", F.lit("x")), ["g"], 11)
    assert flags.where("sampled").count() == 11 and flags.count() == 40


def test_top_per_group_under_skew(spark, skewed):
    got = topk.top_per_group(skewed, ["g"], [F.desc("complaint_id")], 3, spread="complaint_id")
    best = {}
    for r in skewed.collect():
        best.setdefault(r.g, []).append(r.complaint_id)
    want = {(g, rank + 1, i) for g, ids in best.items() for rank, i in enumerate(sorted(ids, reverse=True)[:3])}
    assert {(r.g, r["rank"], r.complaint_id) for r in got.collect()} == want


def test_salted_join_equals_broadcast(spark, skewed):
    sizes = skewed.groupBy("g").agg(F.count("*").alias("n"))
    small = session.attach_small(skewed, sizes, ["g"], spread="complaint_id")
    salted = session.attach_small(skewed, sizes, ["g"], spread="complaint_id", limit_bytes=0, how="left")
    assert sorted(small.collect()) == sorted(salted.select(*small.columns).collect())


def test_numbers_are_consecutive(spark, skewed):
    rows = numbering.number_rows(skewed.repartition(7), [F.desc("complaint_id")], "n", 5).collect()
    assert all(r.n == 5 + 2999 - r.complaint_id for r in rows)


def test_panel_sink(spark, tmp_path):
    rows = [(i, f"2021-0{1 + i % 3}-01", "p", f"one two three {i}") for i in range(30)]
    df = spark.createDataFrame(rows, f"complaint_id long, date_received string, product string, {panel.NARRATIVE} string")
    built = panel.build_panel(df, min_words=1)
    sinks.write_panel(built, str(tmp_path / "panel"))
    back = spark.read.parquet(str(tmp_path / "panel"))
    assert back.count() == 30 and back.where("window_id = '2021-02'").count() == 10
