from fixtures import COLUMNS, blank_letters, letters
from pyspark.sql import functions as F

from nascent.functions import dates, text
from nascent.operators import panel, products


def test_blank_letters_leave_the_panel_and_months_follow_the_days(spark):
    given = letters() + blank_letters()
    built = panel.build_panel(spark.createDataFrame(given, COLUMNS), min_words=6).collect()
    assert {r.complaint_id for r in built} == {row[0] for row in letters()}
    assert set(built[0].asDict()) == set(panel.PANEL_COLUMNS)
    ferry = [r for r in built if r.product == "Ferry ticket"]
    assert all(r.window_id == r.date_received.strftime("%Y-%m") for r in ferry)
    assert min(r.window_id for r in built if r.product == "Heat pump grant") == "2018-09"
    quarters = panel.build_panel(spark.createDataFrame(given, COLUMNS), "Q", min_words=6)
    assert {r.window_id for r in quarters.collect()} == {"2018Q1", "2018Q2", "2018Q3", "2018Q4", "2019Q1"}


def test_word_filter_equals_word_count(spark):
    texts = ["", " ", "a", " a b ", "a\tb\nc", "one  two three four", None, "x" * 500, "a b c d e f"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for least in range(0, 6):
        rows = df.select(
            text.has_words(F.col("t"), least).alias("fast"), (text.word_count(F.col("t")) >= least).alias("slow")
        ).collect()
        assert all(bool(r.fast) == bool(r.slow) for r in rows), least


def test_unicode_spaces_are_optional(spark):
    df = spark.createDataFrame([("a b c",)], "t string")
    row = df.select(text.word_count(F.col("t")).alias("a"), text.word_count(F.col("t"), True).alias("u")).first()
    assert (row.a, row.u) == (2, 3)


def test_many_layouts_of_one_day(spark):
    written = [
        "2021-03-01", " 2021-03-01\t", "2021-3-1", "3/1/2021", "03/01/2021", "3/1/21", "2021/03/01", "Mar 1, 2021", "1 Mar 2021",
        "2021-03-01T00:00:00Z", "2021-03-01T00:00:00-05:00", "2021-03-01 00:00:00.000", "2021-03-01T07:08:09.123456",
        "03/01/2021 10:00:00", "3/1/2021 9:05",
    ]
    bad = ["soon", "", "2021", "31/31/2021", "2021-02-30", "10:00"]
    rows = [(i, d, "p", "i", "s", "one two three", "post", False) for i, d in enumerate([*written, *bad, None])]
    raw = spark.createDataFrame(rows, COLUMNS)
    built = panel.build_panel(raw, "D", min_words=3).collect()
    assert {(r.complaint_id, r.window_id) for r in built} == {(i, "2021-03-01") for i in range(len(written))}
    assert tuple(panel.unparsed_dates(raw).first()) == (len(rows), 1, len(bad))


def test_window_labels(spark):
    row = spark.createDataFrame([("2021-01-03",)], "d string").select(
        *[dates.window_label(F.to_date("d"), f).alias(f) for f in "DWMQY"]
    ).first()
    assert tuple(row) == ("2021-01-03", "2020-12-28/2021-01-03", "2021-01", "2021Q1", "2021")


def test_rate_counts_every_letter_with_its_date_as_written(spark):
    undated = (7_777, "some day", "Other", None, None, "Written without a date", "post", False)
    raw = spark.createDataFrame([*letters(), *blank_letters(), undated], COLUMNS)
    rows = {r.window_id: r for r in panel.narrative_rate(raw).collect()}
    blank = sum(1 for row in blank_letters() if not (row[5] or "").strip())
    total = len(letters()) + len(blank_letters()) + 1
    assert (rows["all"].complaints, rows["all"].with_narrative) == (total, total - blank)
    assert (rows["undated"].complaints, rows["undated"].with_narrative) == (1, 1)
    assert len(rows) == 2 + 12


def test_histogram_with_a_single_length(spark):
    df = spark.createDataFrame([(7,)] * 3, f"{panel.WORDS} int")
    rows = panel.length_histogram(df).collect()
    assert [(r.bin, r.complaints) for r in rows] == [(25, 3)]


def test_integrity_counts_duplicates_and_missing_text(spark):
    rows = [(1, "a"), (1, "b"), (2, None)]
    df = spark.createDataFrame(
        [(i, t, "2021-01", "p") for i, t in rows],
        f"complaint_id long, {panel.NARRATIVE} string, window_id string, product string",
    )
    row = panel.integrity(df).first()
    assert (row.n_rows, row.unique_ids, row.duplicate_ids, row.null_narratives) == (3, 2, 1, 1)


def test_canonical_products(spark):
    cases = {
        "Credit card or prepaid card": "Credit card",
        "Debt or credit management": "Debt management",
        "Checking or savings account": "Bank account",
        " buy now, pay later (bnpl)": "Buy Now, Pay Later (Bnpl)",
        "student LOAN": "Student loan",
        "o'neil's 2nd thing": "O'Neil'S 2Nd Thing",
        None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    got = {r.p: r.c for r in df.select("p", products.canonical_product(F.col("p")).alias("c")).collect()}
    assert got == cases


def test_display_products(spark):
    cases = {"Mortgage": "Mortgage", "Virtual currency, other": "Virtual Currency", None: "Other"}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    got = {r.p: r.c for r in df.select("p", products.display_product(F.col("p")).alias("c")).collect()}
    assert got == cases


def test_masking(spark):
    row = spark.createDataFrame([("On XX/12/2020 XXXX paid $50 xx",)], "t string").select(
        text.redact(F.col("t")).alias("r"), text.drop_masked(F.col("t")).alias("d")
    ).first()
    assert row.r == "On [Redacted]/12/2020 [Redacted] paid $50 xx"
    assert "$50" in row.d and "XXXX" not in row.d


def test_term_counts(spark):
    df = spark.createDataFrame([(1, "b a b c a b"), (2, ""), (3, "x")], "i int, t string")
    rows = df.select("i", text.term_counts(text.space_tokens(F.col("t"))).alias("c")).collect()
    got = {r.i: None if r.c is None else {x.term: x.tf for x in r.c} for r in rows}
    assert got == {1: {"a": 2, "b": 3, "c": 1}, 2: None, 3: {"x": 1}}


def test_bigrams_follow_the_words(spark):
    row = spark.createDataFrame([(["a", "b", "c"], ["a"], [])], "x array<string>, y array<string>, z array<string>")
    got = row.select(*[text.with_bigrams(F.col(c)) for c in "xyz"]).first()
    assert list(got) == [["a", "b", "c", "a b", "b c"], ["a"], []]
