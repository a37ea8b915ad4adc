import math
import random
import re

import pytest
from pyspark.sql import functions as F

from nascent.functions import text
from nascent.operators import casework, dashboard, novelty, terms
from nascent.operators.containment import contained
from nascent.operators.panel import NARRATIVE


def cases(spark, rows):
    return spark.createDataFrame(
        rows, "name string, product string, sub_issue string, recognition_date string, recognition_basis string"
    )


def test_terms_of_the_default_cases(spark):
    got = {r["name"]: r.terms for r in casework.case_terms(casework.default_cases(spark)).collect()}
    assert got == {"buy-now-pay-later": ["bnpl", "later"], "earned-wage-access": ["access", "earned", "wage"]}


def ranked(spark):
    return spark.createDataFrame(
        [(1, 7, "2021-05", True), (2, 8, "2021-01", False), (3, 9, "2021-03", True)],
        "rank int, global_cluster int, first_window string, alert boolean",
    )


def test_matching_inside_words_best_rank_and_lead(spark):
    narratives = spark.createDataFrame(
        [(7, 1, "nothing here"), (8, 2, "my bnplus plan"), (9, 3, "Paid BNPL, collaterally"), (9, 4, None)],
        f"global_cluster int, complaint_id long, {NARRATIVE} string",
    )
    wanted = cases(spark, [("a", "BNPL later", None, "2021-12-01", "x"), ("b", "zzzz", None, "2021-12-01", "x"), ("c", "to", None, "2021-12-01", "x")])
    free = {r["name"]: r for r in casework.match_cases(wanted, ranked(spark), narratives).collect()}
    assert (free["a"].matched_cluster, free["a"].hits) == (8, 1)
    assert not free["b"].matched and not free["c"].matched
    strict = casework.match_cases(wanted, ranked(spark), narratives, alerts_only=True)
    assert {r["name"]: r.matched_cluster for r in strict.collect()} == {"a": 9, "b": None, "c": None}
    lead = {r["name"]: r for r in casework.lead_times(wanted, strict, ranked(spark)).collect()}
    assert lead["a"].lead_time_months == 9.0 and lead["b"].lead_time_months is None
    late = cases(spark, [("a", "BNPL later", None, "2021-01-01", "x")])
    assert casework.lead_times(late, strict, ranked(spark)).first().lead_time_months == -2.0


def test_false_alarms(spark):
    labels = spark.createDataFrame([(7, "fees"), (9, "bnpl")], "global_cluster int, term string")
    row = casework.false_alarm_rate(ranked(spark), labels, casework.default_cases(spark)).first()
    assert (row.alerts_total, row.candidate_false_alarms, row.rate) == (2, 1, 0.5)
    none = casework.false_alarm_rate(ranked(spark).where("rank = 2"), labels, casework.default_cases(spark)).first()
    assert (none.alerts_total, none.rate) == (0, 0.0)


CLUSTERS = [(0, "Mortgage", ["escrow", "servicer"]), (1, "Credit Card", ["charge", "statement"])]


def novelty_input(spark, rows, clusters=CLUSTERS):
    known = spark.createDataFrame(clusters, "id int, label string, keywords array<string>")
    return spark.createDataFrame(rows, f"complaint_id long, {NARRATIVE} string, category string"), known


def scored(spark, rows):
    return novelty.score_novelty(*novelty_input(spark, rows))


def test_novelty_rules(spark):
    rows = [
        (1, "my escrow servicer is wrong", ""),  # two keywords: 6
        (2, "the escrow is wrong", ""),  # exactly 3 stays novel
        (3, "mischarged again", ""),  # substring only: 1.5
        (4, "They used AI on me", ""),  # short emerging term
        (5, "plain text", None),  # empty category adds nothing
        (6, "plain text", "mortgage"),
    ]
    got = {r.complaint_id: r for r in scored(spark, rows).collect()}
    assert (got[1].assigned_cluster, got[1].novelty_score, got[1].is_novel) == (0, 0.4, False)
    assert (got[2].novelty_score, got[2].is_novel) == (0.571, True)
    assert (got[3].assigned_cluster, got[3].novelty_score) == (1, 0.65)
    assert got[4].novelty_score == 0.88 and got[4].has_emerging_term
    assert got[5].probability == 0.5 and got[5].assigned_cluster == 0 and got[5].familiar_confidence == 0.95
    assert (got[6].assigned_cluster, got[6].is_novel) == (0, False)
    assert got[5].spawn_keywords == ["plain"] and got[4].spawn_keywords == novelty.SPAWN_KEYWORDS
    top = novelty.top_assignments(*novelty_input(spark, rows), 1)
    assert top.count() == len(rows)


def test_novelty_equals_every_text_against_every_cluster(spark):
    rng = random.Random(11)
    stems = ["loan", "loans", "card", "debit card", "ai", "x", "mortgage", "été", "credit", "edit", "re", ""]
    clusters = [(i * 3, rng.choice(["Loan", "Card Fees", "Credit", "été", "Misc"]), rng.choices(stems[:-1], k=rng.randrange(4))) for i in range(9)]
    rows = [(i, " ".join(rng.choices([*stems, "😀loan", "Cards", "voice"], k=rng.randrange(7))), rng.choice(["", "Loan", "fees", None])) for i in range(60)]
    rows += [(60, None, "loan"), (61, rows[0][1], rows[0][2]), (61, rows[0][1], rows[0][2])]
    got = {}
    for r in novelty.top_assignments(*novelty_input(spark, rows, clusters), 4).collect():
        got.setdefault(r.complaint_id, {})[r.place] = (r.cluster, r.probability)
    best = {r.complaint_id: r for r in novelty.score_novelty(*novelty_input(spark, rows, clusters)).collect()}
    for key, body, category in rows:
        low = (body or "").lower()
        words = {w for w in re.findall(r"\w+", low) if re.fullmatch("[a-z]{3,}", w)}
        scores = []
        for number, label, keywords in clusters:
            score = sum(3.0 if k in words else 1.5 if k in low else 0.0 for k in keywords)
            scores.append(score + 5.0 * (label.lower() in low or bool(category) and category.lower() in label.lower()))
        weights = [math.exp(min(8.0, 0.7 * s)) for s in scores]
        ranked = sorted((-round(w / sum(weights), 3), number) for w, (number, _, _) in zip(weights, clusters))[:4]
        assert [(c, p) for _, (c, p) in sorted(got[key].items())] == [(c, -p) for p, c in ranked], (body, category)
        top = max(scores)
        want = max(0.12, round(1 - top / (top + 4), 3)) if top >= 3 else 0.65
        assert best[key].novelty_score == (0.88 if set(re.findall(r"\w+", low)) & set(novelty.EMERGING_TERMS) else want)


def test_novelty_without_clusters_or_texts(spark):
    row = novelty.score_novelty(*novelty_input(spark, [(1, "plain text", "")], [])).first()
    assert (row.assigned_cluster, row.probability, row.novelty_score) == (None, None, 0.65)
    assert novelty.score_novelty(*novelty_input(spark, [])).count() == 0
    assert novelty.top_assignments(*novelty_input(spark, [(1, "plain text", "")], [])).count() == 0


def test_words_of_a_text_are_those_of_all_its_words(spark):
    """Reading only as far as the words that count gives what all words of the text give."""
    rng = random.Random(7)
    parts = ["ai", "voice", "crypto", "said", "\U0001d400", "\U0001f600", "é", "_", "7", "phone", "account", "Wallets", "longer", "abcde", "wort", "İstanbul", "-", "\n", "\u3000", "渡し船"]
    bodies = ["".join(rng.choice(parts) + rng.choice(["", " ", " ", "."]) for _ in range(rng.randrange(16))) for _ in range(600)]
    bodies += [None, "", "ai", "x" * 300_000, "Phone " * 50_000 + "ferry", "\U0001d400ai \U0001f600ai", "first second third fourth fifth"]
    low = F.lower("body")
    read = spark.createDataFrame([(b,) for b in bodies], "body string").select(
        "body", F.coalesce(novelty._emerging(low), F.lit(False)).alias("emerging"), novelty._picked(low).alias("picked"),
        F.regexp_extract_all(low, F.lit(text.WORD), F.lit(0)).alias("tokens"), text.latin_words(F.col("body")).alias("words"),
    )
    seen = set()
    for row in read.collect():
        assert row.emerging == bool(set(row.tokens or []) & set(novelty.EMERGING_TERMS)), row.body
        assert (row.picked or []) == [w for w in row.words or [] if len(w) > 4 and w not in novelty.SPAWN_STOP_WORDS][:4], row.body
        seen.add((row.emerging, len(row.picked or [])))
    assert len(seen) == 10
    # Only the head of a long text is read.
    long = spark.range(1).select(F.concat(F.lit("first second third fourth "), F.repeat(F.lit("more "), 9)).alias("body"))
    assert long.select(F.regexp_substr("body", F.lit(novelty._HEAD))).first()[0] == "first second third fourth"


def test_patterns_inside_texts(spark):
    rng = random.Random(3)
    texts = [(i % 40, "".join(rng.choices("abcd \n😀", k=rng.randrange(60)))) for i in range(50)] + [(99, None), (98, ""), (97, "abab" * 3000 + "dcba")]
    patterns = [("".join(rng.choices("abcd 😀", k=rng.randrange(10))),) for _ in range(150)] + [(None,), ("",), ("dcba",), ("abababababab",)]
    found = contained(
        spark.createDataFrame(texts, "k int, t string"), "k", F.col("t"), spark.createDataFrame(patterns, "p string"), "p"
    )
    want = {(k, p) for k, t in texts for (p,) in patterns if t and p and p in t}
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_point_filters(spark):
    points = spark.createDataFrame(
        [("a", 0, 0.1, ("Mortgage Dispute", "fees", None, "text")), ("b", 1, 0.9, ("Card Dispute", None, "late", "other"))],
        "id string, cluster_id int, x double, metadata struct<title:string,issue:string,sub_issue:string,snippet:string>",
    ).withColumn("y", F.col("x"))
    assert [r.id for r in dashboard.filter_points(points, [0, 1], query=" LATE ").collect()] == ["b"]
    assert [r.id for r in dashboard.filter_points(points, [0], query="").collect()] == ["a"]
    chosen = dashboard.select_box(points, "x", "y", (0.5, 1.0), (0.5, 1.0))
    assert [r.id for r in dashboard.filter_points(points, ids=chosen).collect()] == ["b"]


def test_projection_is_the_principal_one(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 6)) * np.array([5, 3, 1, 1, 1, 1]) + 2
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "complaint_id long, vector array<double>")
    got = np.array([[r.pca_x, r.pca_y] for r in dashboard.project_2d(df).orderBy("complaint_id").collect()])
    _, _, axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    for i in range(2):
        axis = axes[i] * np.sign(axes[i][abs(axes[i]).argmax()])
        assert np.allclose(got[:, i], (x - x.mean(axis=0)) @ axis, atol=1e-3)


def test_npmi_bounds(spark):
    docs = spark.createDataFrame([(1, "aa bb"), (2, "aa bb"), (3, "cc"), (4, "dd")], "complaint_id long, t string")
    topics = spark.createDataFrame([(0, "aa"), (0, "bb"), (1, "cc"), (1, "dd")], "topic int, term string")
    got = {r.topic: r.coherence for r in terms.npmi(docs, topics, "topic", F.split("t", " ")).collect()}
    assert got == {0: 1.0, 1: -1.0}


def test_keywords_and_labels_by_brute_force(spark, monkeypatch):
    """Few common terms, few first ones, repeated and null ids, a null group, texts of one word."""
    monkeypatch.setattr(terms, "COMMON_TERMS", 12)
    monkeypatch.setattr(terms, "FIRST_TERMS", 5)
    rng = random.Random(11)
    many = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    rows = [(rng.choice([None, 5, i]) if i % 9 == 0 else i, rng.choice(["a", "a", "a", "b", None]),
             " ".join(rng.choices(many, [1 / (1 + j) for j in range(60)], k=rng.randrange(12)))) for i in range(120)]
    rows += [(1000, "c", "lone"), (1001, "c", "lone pair lone"), (1002, "d", ""), (1003, "d", None)]
    docs = spark.createDataFrame(rows, f"complaint_id long, grp string, {NARRATIVE} string")
    for got, whole in (
        (terms.top_terms(docs, "grp", F.col(NARRATIVE), 3), True),
        (terms.export_keywords(docs, "grp", F.col(NARRATIVE), 3), False),
    ):
        def cut(body):
            words = (body or "").split()
            return words if whole else words + [f"{x} {y}" for x, y in zip(words, words[1:])]

        df, weight, norm, sums, size = {}, [], {}, {}, {}
        for _, grp, body in rows:
            size[grp] = size.get(grp, 0) + 1
            for term in set(cut(body)):
                df[grp if whole else 0, term] = df.get((grp if whole else 0, term), 0) + 1
        for key, grp, body in rows:
            if whole and grp is None:
                continue
            for term in set(cut(body)):
                n = size[grp] if whole else len(rows)
                w = cut(body).count(term) * (math.log((1 + n) / (1 + df[grp if whole else 0, term])) + 1)
                weight.append((key, grp, term, w))
                norm[key] = norm.get(key, 0) + w * w
        for key, grp, term, w in weight:
            if grp is not None:
                sums[grp, term] = sums.get((grp, term), 0) + w / math.sqrt(norm[key])
        want = set()
        for grp in "abc":
            mine = sorted((-round(s if whole else s / size[grp], 6), term) for (g, term), s in sums.items() if g == grp)
            want |= {(grp, term, rank) for rank, (_, term) in enumerate(mine[:3], 1)}
        assert {(r.grp, r.term, r["rank"]) for r in got.collect()} == want


@pytest.mark.parametrize("together", [1, 4, 1 << 20])
def test_pairs_are_counted_like_tokens(spark, monkeypatch, together):
    monkeypatch.setattr(terms, "COUNTED_TOKENS", together)
    bodies = [None, "", "one", "one two", "two one two one", "é é é", "a b a b c", "b"]
    docs = spark.createDataFrame(list(enumerate(bodies)), "complaint_id long, body string").coalesce(1)
    tokens = F.filter(F.split("body", " "), lambda t: t != "")
    got = terms.counted_rows(docs, tokens, ["complaint_id"], pairs=True).orderBy("complaint_id").collect()
    want = docs.select("complaint_id", text.term_counts(text.with_bigrams(tokens)).alias("_t")).orderBy("complaint_id").collect()
    assert got == want
    assert terms.counted_rows(docs.limit(0), tokens, ["complaint_id"], pairs=True).count() == 0


def test_rare_terms_are_counted_where_they_meet(spark):
    """The same weights as by the joined vocabulary, which is not sorted any more."""
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None]), t, rng.randrange(1, 5)) for i in range(80) for t in {f"same beginning {rng.randrange(1 + i)}" for _ in range(6)}]
    words = spark.createDataFrame(rows, "complaint_id long, grp string, term string, tf long")
    with_idf = lambda found: found.withColumn("idf", 1 / F.col("df"))
    for on in (["term"], ["grp", "term"]):
        vocabulary = with_idf(words.dropna(subset=on).groupBy(*on).agg(F.count("*").alias("df")))
        columns = ["complaint_id", "grp", "term", "tf", "w"]
        sized = lambda found: with_idf(found.dropna(subset=on))  # noqa: B023, E731
        for least in (1, 4, 1000):
            got = terms._all_weighted(words, vocabulary, on, least, sized)
            want = terms._weighted(words, vocabulary, on, least)
            assert sorted(map(repr, got.select(columns).collect())) == sorted(map(repr, want.select(columns).collect()))
            assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_large_sets_of_patterns_keep_texts_of_a_key_apart(spark):
    texts = spark.createDataFrame([(1, "abcdxxxx"), (1, "yyyyefgh"), (2, "abcdefgh"), (2, "abcdefgh")], "k int, t string")
    patterns = spark.createDataFrame([("abcdefgh",), ("xyyy",), ("dxx",)], "p string")
    for limit in (0, 1 << 20):
        rows = contained(texts, "k", F.col("t"), patterns, "p", limit).collect()
        assert sorted(tuple(r) for r in rows) == [(1, "dxx"), (2, "abcdefgh")]
