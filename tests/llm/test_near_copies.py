"""SimHash, repeated windows and embeddings against brute force and SQL."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from nascent.llm import common, components, queries, simhash, substrings, vectors
from nascent.plans import checking


def plain_groups(ids, linked):
    """Smallest id reachable, by repeated minimum over all pairs."""
    label = dict(zip(ids, ids, strict=True))
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if linked(a, b)]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label, pairs


def plain_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash_query_on_the_whole_table(spark, data):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    prints = {i: plain_print(t) for i, t in texts.items()}
    label, _ = plain_groups(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op9_simhash"](spark, data).collect()}
    assert got == {i: (f"{prints[i]:016x}", label[i]) for i in prints}


def signed(value):
    return value - (1 << 64) if value >= 1 << 63 else value


@pytest.mark.parametrize("parts", [2, 3, 4, 5])
def test_every_partition_finds_every_link(spark, monkeypatch, parts):
    """All thresholds, crowded blocks and chains; the links are those of all pairs."""
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 16)
    dice = random.Random(parts)
    base = [dice.getrandbits(64) for _ in range(6)]
    prints = {0, (1 << 64) - 1}
    for value in base:
        for _ in range(40):
            for bit in dice.sample(range(64), dice.randint(0, 6)):
                value ^= 1 << bit if dice.random() < 0.6 else 0
            prints.add(value)
    prints = sorted(prints)
    nodes = spark.createDataFrame([(signed(p), i) for i, p in enumerate(prints)], "fp bigint, rep bigint")
    rows, both = simhash.bit_counts(nodes)
    assert rows == len(prints)
    groups = simhash.correlated_parts(rows, both, parts)
    assert sorted(b for g in groups for b in g) == list(range(64))
    costs = [[1.0, 2.0 + i, 9.0] for i in range(parts)]
    thresholds, _ = simhash.allocate(costs, [[0.0] * 3] * parts, 4 - parts + 1)
    assert sum(thresholds) == 4 - parts + 1
    plan = simhash.Plan(groups, thresholds, 0.0)
    label, _ = plain_groups(list(range(len(prints))), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    links = simhash.linked(nodes, plan, 4, rows)
    found = {r.node: r.component for r in components.components(links, "left", "right").collect()}
    assert {i: found.get(i, i) for i in label} == label


def test_simhash_of_odd_rows(spark):
    rows = [(5, None), (3, ""), (9, " \n"), (4, "One two"), (7, "one TWO"), (7, "one TWO"), (None, "one two"), (None, "alone here now then"), (8, "x " * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("fp", F.lit("own"))
    got = simhash.near_duplicates(docs)
    assert got.count() == len(rows)
    by_id = {r.doc_id: r for r in got.where("doc_id is not null").collect()}
    assert [by_id[i].component for i in (5, 3, 9, 4, 7, 8)] == [3, 3, 3, 4, 4, 8]
    assert by_id[3].fp == 0
    assert sorted(r.component or -1 for r in got.where("doc_id is null").collect()) == [-1, 4]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_a_text_without_an_id_links_two_others(spark):
    words = [f"w{i}" for i in range(80)]
    chain = [" ".join(words[:n] + [f"x{i}" for i in range(n, 80)]) for n in range(80, 0, -1)]
    prints = [plain_print(t) for t in chain]
    apart = lambda a, b: (prints[a] ^ prints[b]).bit_count()
    a, b, c = next(
        (a, b, c)
        for b in range(1, 79) for a in range(b) for c in range(b + 1, 80)
        if apart(a, b) <= 4 and apart(b, c) <= 4 and apart(a, c) > 4
    )
    rows = [(9, chain[a]), (5, chain[c]), (3, "something else, quite far from the others in all its words"), (None, "alone " * 9)]
    got = lambda extra: {r.doc_id: r.component for r in simhash.near_duplicates(spark.createDataFrame(rows + extra, "doc_id bigint, text string")).collect()}
    assert got([]) == {9: 9, 5: 5, 3: 3, None: None}
    linked = got([(None, chain[b]), (None, chain[b])])
    assert (linked[9], linked[5], linked[3]) == (5, 5, 3)


@pytest.mark.parametrize("name", ["op4_embeddings", "op7_substrings"])
def test_queries_against_sql(spark, data, name):
    con = checking.connect(data)
    assert checking.differences(queries.QUERIES[name](spark, data), con, queries.CHECKS[name]) == []


def plain_removal(rows, window):
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, words in docs:
        for k in range(len(words) - window + 1):
            seq = tuple(words[k : k + window])
            first[seq] = min(i, first.get(seq, i))
    out = []
    for i, words in docs:
        gone = {k + j for k in range(len(words) - window + 1) if first[tuple(words[k : k + window])] < i for j in range(window)}
        out.append((i, len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(out)


@pytest.mark.parametrize(("chunk", "entries"), [((300, 300), 200), ((10**6, 10**6), 10**6)])
def test_windows_in_many_chunks_and_blocks(spark, monkeypatch, chunk, entries):
    monkeypatch.setattr(substrings, "CHUNK_CHARS", chunk)
    monkeypatch.setattr(substrings, "BLOCK_ENTRIES", entries)
    dice = random.Random(3)
    shared = [" ".join(dice.choice("abcdefgh") for _ in range(40)) for _ in range(6)]
    rows = []
    for i in range(90):
        words = [dice.choice(["p", "q", "r", f"u{dice.randint(0, 999)}"]) for _ in range(dice.randint(0, 30))]
        words.insert(dice.randint(0, len(words)), dice.choice(shared) if i % 3 else "é x")
        rows.append((i - 20, dice.choice([" ", "\n", " \t\x0b "]).join(words)))
    rows += [(500, None), (501, ""), (502, rows[5][1]), (502, rows[5][1]), (503, "z " * 5_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_words", F.lit("own")).withColumn("lang", F.lit("l"))
    got = substrings.repeated_windows(docs, window=5)
    assert set(got.columns) == {"doc_id", "text", "lang", "n_words", "n_removed", "kept_text"}
    found = sorted((r.doc_id, r.n_words, r.n_removed, bytes(r.kept_text)) for r in got.collect())
    assert found == plain_removal(rows, 5)


def test_windows_of_null_ids_and_of_nothing(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(None, text), (4, text), (6, text)], "doc_id bigint, text string")
    got = {r.doc_id: r.n_removed for r in substrings.repeated_windows(docs).collect()}
    assert got == {None: 0, 4: 0, 6: 20}
    monkeypatch.setattr(substrings, "CHUNK_CHARS", (300, 300))
    # A hot id and a hot null: their rows are dealt by text, and compared by id all the same.
    words = [f"{text} s{i} {'t' * (i % 7)}" for i in range(200)]
    rows = [(8, w) for w in words[:90]] + [(None, w) for w in words[90:160]] + [(11, words[0]), (2, words[150])]
    found = substrings.repeated_windows(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    with_id = sorted((r.doc_id, r.n_words, r.n_removed, bytes(r.kept_text)) for r in found if r.doc_id is not None)
    assert with_id == plain_removal([r for r in rows if r[0] is not None], 13)
    assert [r.n_removed for r in found if r.doc_id is None] == [0] * 70
    assert substrings.repeated_windows(docs.limit(0)).count() == 0


def plain_vectors(rows, threshold):
    def cosine(a, b):
        a, b = (np.array(v, dtype=float) / max(map(abs, v)) for v in (a, b))
        return a @ b / np.linalg.norm(a) / np.linalg.norm(b)

    fit = {i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    near = lambda a, b: a in fit and b in fit and len(rows[a][1]) == len(rows[b][1]) and cosine(rows[a][1], rows[b][1]) >= threshold
    label, pairs = plain_groups(list(range(len(rows))), near)
    degree = [sum(i in p for p in pairs) for i in range(len(rows))]
    return sorted((rows[i][0], degree[i], rows[label[i]][0]) for i in range(len(rows)))


@pytest.mark.parametrize("hashing", [None, vectors.Hashing(2, 6)])
def test_vectors_against_all_pairs(spark, monkeypatch, hashing):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 16)
    random_ = np.random.default_rng(4)
    rows = []
    for group in range(12):
        centre = random_.normal(size=24)
        noise = 0.06 if group % 2 else 0.22
        rows += [(centre + noise * random_.normal(size=24)).tolist() for _ in range(5 + 4 * group)]
    rows += [rows[0], rows[0], [0.0] * 24, [1e300] * 24, [1e-300] * 24, [1.0] * 23]
    table = list(enumerate(rows, 100)) + [(900, None), (901, []), (902, [1.0, None, 2.0]), (903, [float("nan")] * 24), (904, [float("inf")] + [0.0] * 23)]
    frame = spark.createDataFrame(table, "vec_id bigint, embedding array<double>").withColumn("rep", F.lit("own"))
    got = sorted(tuple(r) for r in vectors.near_vectors(frame, threshold=0.95, hashing=hashing).collect())
    assert got == plain_vectors(table, 0.95)


def test_vectors_of_one_row_and_none(spark):
    frame = spark.createDataFrame([(3, [1.0, 2.0])], "vec_id bigint, embedding array<float>")
    assert vectors.near_vectors(frame).collect() == [(3, 0, 3)]
    assert vectors.near_vectors(frame.limit(0)).count() == 0


def test_runs_are_never_parted():
    import pandas as pd

    frame = pd.DataFrame({"k": [1, 1, 2, 2, 2, 3, 4, 4], "v": range(8)})
    for size in (1, 2, 3, 8):
        batches = [frame.iloc[i : i + size] for i in range(0, 8, size)]
        parts = list(common.complete_runs(iter(batches), ["k"], 2))
        assert pd.concat(parts)["v"].tolist() == list(range(8))
        ends = [set(p["k"]) for p in parts]
        assert sum(map(len, ends)) == len(set().union(*ends))
    assert list(common.complete_runs(iter([]), ["k"])) == []


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    dice = random.Random(1)
    dice.shuffle(links)
    found = components.components(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b")
    assert {r.node: r.component for r in found.collect()} == {**{i: 0 for i in range(1, 61)}, **{i: 100 for i in range(101, 160)}}


def test_hash_of_kept_words(spark, data):
    rows = queries.QUERIES["op7_substrings"](spark, data).where("n_words = n_removed").collect()
    assert all(r.kept_sha256 == hashlib.sha256(b"").hexdigest() for r in rows)
