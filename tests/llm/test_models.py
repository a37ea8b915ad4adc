"""Held-out accuracy and edge cases of the two classifiers."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from nascent.llm import quality, queries, toxicity


def corpus(spark, kind):
    """Planted texts: toxic ones hold words with two stems, poor ones symbols and capitals."""
    dice = random.Random(31)
    words = ["".join(dice.choice("abdelmnorst") for _ in range(dice.randint(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(700):
        text = [dice.choice(words) for _ in range(dice.choice([8, 40, 400]))]
        marked = i % 7 == 0
        if kind == "toxic" and marked:
            for _ in range(3):
                text[dice.randrange(len(text))] = dice.choice(["grumf", "zwick"]) + dice.choice(["", "ler", "ata", "os"])
        if kind == "quality" and marked:
            text = [w.upper() + "!!" if i % 2 else w + "%%%" for w in text]
        docs.append((i, " ".join(text)))
        if i % 2 == 0:  # a fair sample, as the prior is taken from it
            labels.append((i, int(marked if kind == "toxic" else not marked)))
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, y int")


def test_toxic_texts_are_told_from_positives_and_unlabelled_ones(spark):
    docs, labels = corpus(spark, "toxic")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    model = toxicity.train(docs.where(~held_out), labels.where(~held_out), label_col="y")
    scored = docs.where(held_out).select("doc_id", toxicity.score_column(model, F.col("text")).alias("s")).collect()
    wrong = [r.doc_id for r in scored if (r.s >= 0.3) != (r.doc_id % 7 == 0)]
    assert len(scored) > 100 and len(wrong) <= 0.03 * len(scored)


def test_negative_risk_is_kept_from_falling_below_zero():
    random_ = np.random.default_rng(0)
    pos, unl = random_.integers(0, 2, (30, 200)).astype(np.float32), random_.integers(0, 2, (60, 200)).astype(np.float32)
    weights, bias = toxicity._descend(pos, unl, 0.4, 0.0, toxicity.ToxicitySettings(epochs=400, ridge=0.0))
    loss = lambda z: np.logaddexp(0, z).mean()
    negative = loss(unl @ weights + bias) - 0.4 * loss(pos @ weights + bias)
    assert negative > -0.2  # without the correction it falls without bound on separable data


def test_toxicity_of_odd_rows(spark):
    docs, labels = corpus(spark, "toxic")
    model = toxicity.train(docs, labels, label_col="y")
    rows = [(1, None), (2, ""), (3, "zwick grumf zwickler grumfos"), (3, "zwick grumf zwickler grumfos"), (4, "zwick grumfata " + "la " * 200_000)]
    odd = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("score", F.lit("own"))
    scores = [r.s for r in odd.select("doc_id", toxicity.score_column(model, F.col("text")).alias("s")).orderBy("doc_id").collect()]
    assert scores[0] == scores[1] < 0.3 and scores[2] == scores[3] > 0.5 and scores[4] > 0.5
    none = toxicity.train(docs, labels.where("y = 0"), label_col="y")
    assert len(none.slots) == 0
    assert len(toxicity.train(docs.limit(0), labels.limit(0), label_col="y").slots) == 0
    assert odd.limit(0).select(toxicity.score_column(none, F.col("text"))).count() == 0


def test_poor_texts_score_low(spark):
    docs, labels = corpus(spark, "quality")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    stats = quality.with_statistics(docs)
    model = quality.train(stats.join(labels.where(~held_out), "doc_id").select("stats", "y"))
    scored = stats.where(held_out).select("doc_id", quality.score_column(model, F.col("stats")).alias("s")).collect()
    wrong = [r for r in scored if (r.s >= 0.5) != (r.doc_id % 7 != 0)]
    assert len(scored) > 150 and len(wrong) <= 0.03 * len(scored)
    assert all(0 <= r.s <= 1 for r in scored)
    assert (np.diff(model.steps) >= 0).all()


def test_normal_equations_do_not_depend_on_partitions(spark):
    docs, labels = corpus(spark, "quality")
    rows = quality.with_statistics(docs).join(labels, "doc_id").select("stats", "y").cache()
    one, many = quality.train(rows.coalesce(1)), quality.train(rows.repartition(37))
    assert np.allclose(one.weights, many.weights, atol=1e-6)
    plain = np.array([r.stats for r in rows.collect()])
    assert np.allclose(one.mean, plain.mean(axis=0))


def test_normal_equations_equal_plain_ones(spark):
    docs, labels = corpus(spark, "quality")
    rows = quality.with_statistics(docs).join(labels, "doc_id").select("stats", "y").cache()
    model = quality.train(rows)
    plain = rows.collect()
    z = model.features(np.array([r.stats for r in plain]))
    y = np.array([r.y for r in plain], dtype=float)
    # Far more tasks than rows, and fewer groups than tasks on every level.
    left, right = quality._normal_equations(rows.repartition(600), model, 4)
    assert np.allclose(left, z.T @ z) and np.allclose(right, z.T @ y)
    settings = quality.QualitySettings()
    ridge = np.diag([settings.ridge * len(y) / settings.features] * settings.features + [1e-9])
    assert np.allclose(np.linalg.solve(z.T @ z + ridge, z.T @ y), model.weights, atol=1e-6)


def test_one_row_of_a_repeated_id_is_drawn(spark):
    rows = [(7, f"word{i} and more") for i in range(500)] + [(i, f"text {i}") for i in range(100, 120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame([(7,), (101,)], "doc_id bigint")
    settings = toxicity.ToxicitySettings()
    drawn = [toxicity.training_rows(docs.repartition(n), marks, settings) for n in (1, 9)]
    assert drawn[0].equals(drawn[1].reset_index(drop=True).set_index(drawn[0].index))
    assert sorted(zip(drawn[0]["positive"], drawn[0]["id"], strict=True)) == sorted(
        [(0, str(i)) for i in (7, *range(100, 120))] + [(1, "7"), (1, "101")]
    )


def test_quality_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "a" * 500_000), (4, "a" * 500_000), (5, "🎉é\u0000")]
    odd = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("stats", F.lit("own"))
    stats = quality.with_statistics(odd)
    empty = quality.train(stats.limit(0).withColumn("y", F.lit(1)).select("stats", "y"))
    scores = [r.s for r in stats.select("doc_id", quality.score_column(empty, F.col("stats")).alias("s")).collect()]
    assert scores == [0.5] * 6
    assert quality.with_statistics(odd.limit(0)).count() == 0
    single = quality.train(stats.withColumn("y", F.lit(1)).select("stats", "y"))
    assert all(r.s == 1.0 for r in stats.select(quality.score_column(single, F.col("stats")).alias("s")).collect())


def test_pooling():
    steps = quality.pool_adjacent(np.array([1.0, 0, 0, 2, 0]), np.array([1.0, 1, 0, 2, 1]), 0.5)
    assert np.allclose(steps, [0.5, 0.5, 0.5, 2 / 3, 2 / 3])
    assert np.allclose(quality.pool_adjacent(np.zeros(3), np.zeros(3), 0.5), 0.5)


@pytest.mark.parametrize(("name", "label", "parts", "fold", "limit"), [("op3_toxicity", "toxic", 4, 2, 0.3), ("op6_quality", "quality", 3, 1, 0.5)])
def test_queries_on_the_whole_table(spark, name, label, parts, fold, limit):
    data = "/root/testdata/sf0.01"  # the smallest tables have too few labels to learn from
    rows = queries.QUERIES[name](spark, data).collect()
    ids = [r.doc_id for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert sorted(r.doc_id for r in rows) == sorted(ids)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == fold)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= limit)
    marks = {r.doc_id: r[label] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    right = [r.predicted == marks[r.doc_id] for r in rows if r.doc_id in marks]
    assert sum(right) >= 0.85 * len(right)
