"""One query per operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nascent.llm import bpe, curves, manifest, packing, pages, quality, sanitise, simhash, sketches, substrings, toxicity, vectors, whitening
from nascent.llm.common import clean_text, in_fold, table
from nascent.session import settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]):
    QUERIES[function.__name__] = function
    return function


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held_out = in_fold("doc_id", 4, 2)
    model = toxicity.train(docs.where(~held_out), labels.where(~held_out))
    scored = docs.select("doc_id", held_out.alias("held_out"), toxicity.score_column(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    stats = settle(quality.with_statistics(docs))
    marked = labels.where(F.col("y").isNotNull() & ~in_fold("doc_id", 3, 1))
    model = quality.train(settle(stats.join(marked, "doc_id").select("stats", "y")))
    scored = stats.select(
        "doc_id",
        in_fold("doc_id", 3, 1).alias("held_out"),
        quality.score_column(model, F.col("stats")).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    numbers = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(numbers.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(bpe.decode_column(F.col("ids"), ranks), 256).alias("decoded_sha256"),
    )


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, path, public_tokenizers.PATTERN)


@query
def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = substrings.repeated_windows(docs)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    groups = simhash.near_duplicates(docs)
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return groups.select("doc_id", digits.alias("fingerprint"), F.col("component").alias("component_id"))


@query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = sanitise.find_spans(docs)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return spans.select(
        "doc_id",
        *(count(i).alias(f"n_{name}") for i, name in enumerate(sanitise.KINDS)),
        F.sha2(sanitise.named(F.col("base")), 256).alias("base_sha256"),
        sanitise.named(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


@query
def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    edits = sketches.with_edits(docs)
    following = F.coalesce(sketches.likeness(F.col("sketch"), F.col("next_sketch")), F.lit(0.0))
    return edits.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        sketches.as_text(F.col("sketch")).alias("fingerprint"),
        sketches.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        sketches.likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        following.alias("near_next"),
    )


@query
def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = vectors.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return groups.withColumn("kept", F.col("vec_id") == F.col("component_id"))


@query
def op1_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))


@query
def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    leaf = manifest.leaf_digest([F.col(c) for c in columns])
    other = manifest.leaf_digest([more if c == "n_chars" else F.col(c) for c in columns])
    changed = F.when(in_fold("doc_id", 7, 0), other).otherwise(leaf)
    leaves = manifest.place_leaves(docs, F.col("lang"), [F.col("doc_id")], leaf, {"doc_id": F.col("doc_id"), "changed": changed})
    found = manifest.manifest(leaves, "changed", ["doc_id"])
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.col("proof").alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
        "n_copied",
    )


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whitening.whiten(rows, "embedding", "vec_id").withColumnRenamed("id", "vec_id")


@query
def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = curves.nearest_neighbours(rows, "embedding", "vec_id", F.col("id") % 100 == 0)
    return found.withColumnRenamed("id", "vec_id")


CHECKS["op4_embeddings"] = """
    WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    links AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
        ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
    ),
    reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
    groups AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
    counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
    SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
    FROM v JOIN groups USING (vec_id) LEFT JOIN counts USING (vec_id)
"""

CHECKS["op7_substrings"] = r"""
    WITH split AS (
        SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
        FROM documents
    ),
    windows AS (
        SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS seq FROM split, unnest(range(1, len(ws) - 11)) AS t(i)
    ),
    firsts AS (SELECT seq, min(doc_id) AS first_id FROM windows GROUP BY seq),
    hits AS (SELECT doc_id, i FROM windows JOIN firsts USING (seq) WHERE first_id < doc_id),
    gone AS (SELECT DISTINCT doc_id, i + k AS j FROM hits, range(0, 13) AS r(k)),
    words AS (SELECT doc_id, j, ws[j] AS word FROM split, unnest(range(1, len(ws) + 1)) AS t(j)),
    kept AS (
        SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS txt, count(*) AS n
        FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id
    )
    SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
           sha256(coalesce(txt, '')) AS kept_sha256
    FROM split LEFT JOIN kept USING (doc_id)
"""

# crc32 by its polynomial, eight bits at a time, over the digits of the id.
CHECKS["op11_manifest"] = r"""
    WITH RECURSIVE enc AS (
        SELECT doc_id, lang,
          coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
            || coalesce(strlen(lang) || ':' || lang, '-') AS head,
          n_chars::HUGEINT AS n, coalesce(strlen(text) || ':' || text, '-') AS tail
        FROM documents
    ),
    crc(doc_id, digits, c) AS (
        SELECT DISTINCT doc_id, doc_id::VARCHAR, 4294967295::BIGINT FROM documents WHERE doc_id IS NOT NULL
        UNION
        SELECT doc_id, substr(digits, 2), list_reduce(list_prepend(xor(c, ascii(digits)::BIGINT), [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]),
          lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END)
        FROM crc WHERE digits <> ''
    ),
    tampered AS (SELECT doc_id FROM crc WHERE digits = '' AND xor(c, 4294967295::BIGINT) % 7 = 0),
    leaves AS (
        SELECT doc_id, lang, sha256(head || coalesce(strlen(n::VARCHAR) || ':' || n, '-') || tail) AS leaf,
          sha256(head || coalesce(strlen((n + 1)::VARCHAR) || ':' || (n + 1), '-') || tail) AS other
        FROM enc
    ),
    placed AS (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
          dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree
        FROM leaves
    ),
    up(level, tree, pos, digest) AS (
        SELECT 0, tree, pos, leaf FROM placed
        UNION ALL
        SELECT level + 1, tree, pos // 2, sha256(string_agg(digest, '' ORDER BY pos))
        FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM up) WHERE n > 1 GROUP BY level, tree, pos // 2
    ),
    subroots AS (SELECT tree, level AS height, digest FROM up QUALIFY level = max(level) OVER (PARTITION BY tree)),
    top(level, pos, digest) AS (
        SELECT 0, tree, digest FROM subroots
        UNION ALL
        SELECT level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos))
        FROM (SELECT *, count(*) OVER () AS n FROM top) WHERE n > 1 GROUP BY level, pos // 2
    ),
    root AS (SELECT digest FROM top QUALIFY level = max(level) OVER ()),
    steps AS (
        SELECT p.tree, p.pos, l.level AS k, s.digest AS partner, (p.pos >> l.level) % 2 = 1 AS before
        FROM placed p JOIN subroots r USING (tree) JOIN (SELECT DISTINCT level FROM up) l ON l.level < r.height
        LEFT JOIN up s ON s.tree = p.tree AND s.level = l.level AND s.pos = xor(p.pos >> l.level, 1)
        UNION ALL
        SELECT p.tree, p.pos, 1000 + l.level, s.digest, (p.tree >> l.level) % 2 = 1
        FROM placed p JOIN (SELECT DISTINCT level FROM top) l ON l.level < (SELECT max(level) FROM top)
        LEFT JOIN top s ON s.level = l.level AND s.pos = xor(p.tree >> l.level, 1)
    ),
    paths AS (
        SELECT tree, pos, list({'partner': coalesce(partner, ''), 'before': before} ORDER BY k) AS path FROM steps GROUP BY 1, 2
    ),
    folded AS (
        SELECT p.*, coalesce(path, []) AS path, CASE WHEN p.doc_id IN (SELECT doc_id FROM tampered) THEN other ELSE leaf END AS now
        FROM placed p LEFT JOIN paths USING (tree, pos)
    ),
    ends AS (
        SELECT *, CASE WHEN len(path) = 0 THEN now ELSE list_reduce(
            list_prepend({'partner': now, 'before': false}, path),
            lambda a, b: {'partner': sha256(CASE WHEN b.before THEN b.partner || a.partner ELSE a.partner || b.partner END), 'before': false}
          ).partner END AS folded_root
        FROM folded
    )
    SELECT doc_id, leaf, r.digest AS subroot, (SELECT digest FROM root) AS root,
      sha256(list_aggregate(list_prepend('', list_transform(path, lambda s: s.partner)), 'string_agg', '')) AS proof_sha256,
      folded_root, folded_root = (SELECT digest FROM root) AS verified,
      CASE WHEN now = leaf THEN 0 ELSE len(path) + 1 END::BIGINT AS n_copied
    FROM ends JOIN subroots r USING (tree)
"""
