"""The stages one after another, against brute force on what the stage before kept."""

import re

import pytest
from pyspark.sql import functions as F
from test_near_copies import plain_groups, plain_print, plain_removal
from test_sanitise import plain_spans
from test_tokens import gapless

import __spark_entry__ as entry_points
import corpus_pipeline
from nascent.llm import toxicity
from nascent.session import scratch_path


CLASHING = ["n_words", "n_removed", "kept_text", "__key", "__chunk", "__added", "key", "rows", "others", "fp", "spans", "component", "a.b"]


@pytest.fixture(scope="module")
def stages(spark, data):
    docs, kept = spark.read.parquet(f"{data}/documents.parquet"), {}
    kept["input"] = docs
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, data).write.parquet(path)
        docs = kept[name] = spark.read.parquet(path)
    return kept


def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def test_columns_and_names(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "repeats", "personal_data", "packing"]
    for name in ("toxicity", "near_copies", "repeats", "personal_data"):
        assert stages[name].dtypes == stages["input"].dtypes
    assert entry_points.queries()["pipeline"] is corpus_pipeline.run


def test_toxic_documents_go(spark):
    """On the next larger tables: eleven toxic labels in four languages teach too little."""
    data = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    before, after = texts(docs), texts(corpus_pipeline.drop_toxic(spark, docs, data))
    toxic = {r.doc_id for r in spark.read.parquet(f"{data}/labels.parquet").where("toxic = 1").collect()}
    clean = {r.doc_id for r in spark.read.parquet(f"{data}/labels.parquet").where("toxic = 0").collect()}
    gone = before.keys() - after.keys()
    assert len(gone & toxic) >= 0.7 * len(toxic & before.keys())
    assert len(gone & clean) <= 0.1 * len(clean & before.keys())
    assert all(before[i] == t for i, t in after.items())


def test_one_of_each_group_stays(stages):
    before, after = texts(stages["toxicity"]), texts(stages["near_copies"])
    prints = {i: plain_print(t) for i, t in before.items()}
    label, _ = plain_groups(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    assert after.keys() == set(label.values())


def test_repeats_and_personal_data(stages):
    before, cut, masked = texts(stages["near_copies"]), texts(stages["repeats"]), texts(stages["personal_data"])
    for i, _, gone, kept in plain_removal(sorted(before.items()), 13):
        assert cut[i] == (kept.decode() if gone else before[i])
    assert masked.keys() == cut.keys()
    for i, text in masked.items():
        if not plain_spans(cut[i]):
            assert text == cut[i] or re.search(r"\[TERM\]", text) or len(text) < len(cut[i])
        assert not any(s.startswith(("email", "card")) for s in plain_spans(text).split(","))
    assert all(r.n_chars == len(r.text) for r in stages["personal_data"].collect())


def test_all_that_is_left_is_packed(stages):
    rows = stages["packing"].collect()
    assert {r.doc_id for r in rows} == texts(stages["personal_data"]).keys()
    gapless(rows, corpus_pipeline.MAX_TOKENS)


def test_odd_rows_pass_every_stage(spark, data, monkeypatch):
    monkeypatch.setattr(toxicity, "train", lambda *a, **k: _harmless())
    long = " ".join(f"w{i}" for i in range(3_000))
    rows = [(1, None, "l"), (2, "", "l"), (3, long, None), (3, long, None), (4, long + " end", "l"), (None, "no id here", "l"), (None, "no id here", "l"), (None, "nor one here", "l"), (5, "b@c.de wrote", "l")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("score", F.lit(1)).withColumn("__text", F.lit(2))
    # Names that the operators use themselves.
    for number, taken in enumerate(CLASHING):
        docs = docs.withColumn(taken, F.lit(number))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, data).write.parquet(path)
        docs = spark.read.parquet(path)
        if name == "near_copies":
            # Texts without words are one group, and so are repeated and nearly equal rows.
            assert sorted((r.doc_id or 0, r.text or "") for r in docs.collect()) == [(0, "no id here"), (0, "nor one here"), (1, ""), (3, long), (5, "b@c.de wrote")]
    assert {r.doc_id: r.text for r in docs.collect()}[5] == "[EMAIL] wrote"
    assert all([r[c] for c in CLASHING] == list(range(len(CLASHING))) for r in docs.collect())
    assert corpus_pipeline.pack_sequences(spark, docs, data).where("doc_id = 1").count() == 1
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), data).count() == 0


def _harmless():
    import numpy as np

    return toxicity.ToxicityModel(np.zeros(0, np.int64), np.zeros(0), -5.0)
