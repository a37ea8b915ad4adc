"""Base spans against plain matching, and disclosing terms on a planted corpus."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from nascent.llm import queries, sanitise

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ["email", "ip", "card", "phone"]


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def plain_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))


def odd_texts():
    dice = random.Random(5)
    parts = ["a@b.c", "+d@e.f", "_x", "@", ".", "..", "1.2.3.4", "256.1.1.1", "0001.2.3.255", "4111 1111 1111 1111", "4111-1111-1111-1111", "5", " ", "-", "+49 (30) 123-4567", "+1", "é", "🎉", "\n", "12345678901234567890", "a", "%", "(", "79927398713", "000000000000"]
    texts = ["".join(dice.choice(parts) for _ in range(dice.randint(0, 14))) for _ in range(600)]
    return [*texts, None, "", " ", "9" * 30_000, "a" * 30_000, "a." * 8_000 + "@b" + ".c" * 8_000, "1." * 20_000, "x@y.zz 1.2.3.4 " * 1_500]


def test_base_spans_are_those_of_plain_matching(spark):
    texts = odd_texts()
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    spans = sanitise.base_spans(F.coalesce("text", F.lit("")))
    got = dict(rows.select("doc_id", sanitise.named(spans)).collect())
    assert {i: plain_spans(t) for i, t in enumerate(texts)} == got


def test_query_on_the_whole_table(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    expected = {r.doc_id: plain_spans(r.text) for r in rows}
    got = queries.QUERIES["op2_pii"](spark, data).collect()
    assert len(got) == len(rows)
    for r in got:
        plain = expected[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(plain.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in plain.split(",")) for k in KINDS]
        assert set(plain.split(",")) <= set(r.spans.split(","))


@pytest.fixture(scope="module")
def planted(spark):
    dice = random.Random(9)
    filler = [f"word{i}" for i in range(60)]
    line = lambda n: " ".join(dice.choice(filler) for _ in range(n))
    rows = [(i, line(30)) for i in range(400)]
    for i in range(8):
        rows.append((1000 + i, f"{line(5 + i)} Kestrelbay {line(4)} jo@north.example {line(6)}"))
    rows.append((1000, rows[-8][1]))  # a repeated row
    rows += [(2000 + i, f"copy of one text Pelican near sam@south.example {'x ' * 3}") for i in range(20)]
    rows += [(3000, None), (3001, ""), (None, "nobody@else.example")]
    return spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("spans", F.lit("own"))


def test_terms_that_give_an_entity_away(planted):
    found = {}
    for r in sanitise.find_spans(planted).collect():
        found.setdefault(r.doc_id, []).append({s["value"]: s["kind"] for s in r.added})
    assert all(f == {"kestrelbay": 5} for i in range(1000, 1008) for f in found[i])
    assert len(found[1000]) == 2  # repeated rows stay two
    # Common words tell nothing, and copies of one context are a single piece of evidence.
    assert all(not f for i, fs in found.items() if i is None or i < 1000 or i >= 2000 for f in fs)


def test_masking(planted):
    rows = sanitise.mask_documents(planted)
    assert rows.columns == planted.columns
    texts = {r.doc_id: r.text for r in rows.collect()}
    assert "Kestrelbay" not in texts[1003] and "[EMAIL]" in texts[1003] and "jo@" not in texts[1003]
    assert texts[2000].startswith("copy of one text Pelican near [EMAIL] ")
    assert texts[3000] == "" and texts[3001] == "" and texts[None] == "[EMAIL]"


def test_masking_covers_the_union_of_overlaps(spark):
    text = "see 10.0.0.1@x.yz and 4111 1111 1111 1111, end"
    row = spark.createDataFrame([(text,)], "text string")
    spans = sanitise.base_spans(F.col("text"))
    assert row.select(sanitise.mask(F.col("text"), spans)).first()[0] == "see [EMAIL] and [CARD], end"


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert sanitise.find_spans(empty).count() == 0
    assert sanitise.mask_documents(empty).count() == 0


def test_terms_far_from_the_entity(spark):
    """A term thousands of characters off, and its other occurrences in the text, go as well."""
    dice = random.Random(4)
    line = lambda n: " ".join(dice.choice([f"word{i}" for i in range(60)]) for _ in range(n))
    rows = [(i, line(90)) for i in range(300)]
    rows += [(1000 + i, f"Ospreyfen {line(90)} jo@north.example {line(120)} ospreyfen, {line(20 + i)} Bay-Heronmere {line(3)}") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r for r in sanitise.find_spans(docs).collect()}
    texts = dict(rows)
    for i in range(1000, 1004):
        places = [(s["start"], s["end"]) for s in found[i].added]
        assert {texts[i][a:b].lower() for a, b in places} == {"ospreyfen", "bay", "heronmere"}
        assert len(places) == 4
    masked = {r.doc_id: r.text for r in sanitise.mask_documents(docs).collect()}
    assert not any(re.search("ospreyfen|heronmere|jo@", masked[i], re.I) for i in range(1000, 1004))
    assert all(masked[i] == texts[i] for i in range(300))


def test_blanking_keeps_places(spark):
    texts = [t for t in odd_texts() if t and len(t) < 1000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    spans = sanitise.base_spans(F.col("text"))
    for r in rows.select("doc_id", spans.alias("s")).select("doc_id", sanitise.named(F.col("s")).alias("n")).join(rows.withColumn("b", sanitise.blanked(F.col("text"), spans)), "doc_id").collect():
        expected = list(r.text)
        for a, b in ((int(x), int(y)) for _, x, y in (n.split(":") for n in r.n.split(",") if n)):
            expected[a:b] = " " * (b - a)
        assert r.b == "".join(expected)
