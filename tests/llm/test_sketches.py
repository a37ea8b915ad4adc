"""Sketches against plain sets of hashes."""

import hashlib

import pytest
import xxhash
from pyspark.sql import functions as F

from nascent.llm import queries, sketches


def plain_edit(texts, doc_id):
    """Texts by id; the edited text of one of them."""
    order = sorted(texts, reverse=True)
    text, after = texts[doc_id], texts[order[(order.index(doc_id) + 1) % len(order)]]
    third = len(text) // 3
    return text[: len(text) - third] + after[:third]


def chained(hashes):
    """Spark's xxhash64 of several longs: each hashes on with the last as seed."""
    seed = 42
    for h in hashes:
        seed = xxhash.xxh64_intdigest(h.to_bytes(8, "little"), seed)
    return seed


def plain_sketch(text, width=5):
    words = [xxhash.xxh64_intdigest(w, 42) for w in text.encode().split()]
    count = len(words) - width + 1
    shingles = [chained(words[i : i + width]) for i in range(count)] if count > 0 else [chained(words)] if words else []
    signed = {h - (1 << 64) if h >= 1 << 63 else h for h in shingles}
    kept = {h for h in signed if h < sketches.below(sketches.SHARE)}
    return kept or ({min(signed)} if signed else set())


def likeness(a, b):
    least = min(len(a), len(b))
    return len(a & b) / least if least else float(len(a) == len(b))


def test_query_on_the_whole_table(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    texts = {r.doc_id: r.text or "" for r in rows}
    order = sorted(texts, reverse=True)
    plain = {i: plain_sketch(t) for i, t in texts.items()}
    got = queries.QUERIES["op8_fingerprints"](spark, data).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        edited = plain_edit(texts, r.doc_id)
        assert r.n_chars == len(texts[r.doc_id])
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == " ".join(f"{h & (1 << 64) - 1:016x}" for h in sorted(plain[r.doc_id]))
        assert r.near_edited == pytest.approx(likeness(plain[r.doc_id], plain_sketch(edited)))
        after = order[(order.index(r.doc_id) + 1) % len(order)]
        assert r.near_next == pytest.approx(likeness(plain[r.doc_id], plain[after]))


def test_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (2, "", 0), (3, " \n ", 0), (4, "one two", 0), (5, "one two", 0), (6, "ab " * 50_000, 0), (None, "no id at all", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, edited int")
    got = sketches.with_edits(docs)
    assert got.count() == len(rows)
    near = got.select("doc_id", sketches.likeness(F.col("sketch"), F.col("next_sketch")).alias("near"), "edited").collect()
    by_id = {r.doc_id: r for r in near}
    assert by_id[5].near == 1.0  # equal texts
    assert by_id[4].near == 0.0  # an empty text follows
    assert by_id[3].near == 1.0  # two texts without words
    assert by_id[None].near is None and by_id[None].edited == "no id at"
    assert sketches.with_edits(docs.limit(0)).count() == 0
    alone = sketches.with_edits(spark.createDataFrame([(7, "a b c")], "doc_id bigint, text string")).first()
    assert alone.edited == "a b a"  # it follows itself


def test_sketches_merge_and_tell_containment(spark):
    words = [f"w{i}" for i in range(4_000)]
    row = spark.createDataFrame([(" ".join(words), " ".join(words[1_000:1_800]))], "large string, small string")
    large, small = sketches.sketch(F.col("large")), sketches.sketch(F.col("small"))
    r = row.select(
        sketches.contained(small, large).alias("inside"),
        sketches.contained(large, small).alias("around"),
        (sketches.merged(large, small) == large).alias("same"),
    ).first()
    assert r.inside == 1.0 and r.around == pytest.approx(0.2, abs=0.06) and r.same
