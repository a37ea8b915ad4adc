"""Personal data and the terms that give it away; DataFrame functions only.

Base spans are e-mail addresses, IP addresses, card and phone numbers. The values found
are the protected entities. A term in the text of an entity discloses it as far as knowing the term
makes the entity likelier: with counts over all documents, the disclosure is

    PMI(term, entity) / IC(entity) = 1 + log2 P(entity | term) / IC(entity),

with IC(entity) = -log2 P(entity): 1 if the term never occurs without the entity, 0 if it
tells nothing (Sanchez and Batet, 2016). Terms from ``generalise_from`` on are replaced by
their kind, from ``remove_from`` on they are taken out, wherever they stand in a document
that holds the entity. A term must meet its entity in ``min_contexts`` different texts;
copies of one text count once.

Terms are runs of letters and digits anywhere in a text that holds an entity, outside the
base spans. A document's terms are counted once, not once per entity: only entities in
enough texts, and only terms rare enough to disclose one of them by exact bounds, are
paired. Pairs and terms are counted with partial sums before the shuffle.

Defined results: a null or empty text has no spans; repeated rows have equal spans and
count each in the shares, but as one text; spans of different kinds may overlap, and masking covers their
union; ties are sorted by start, kind and end; extra columns are ignored here and kept by
``mask``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nascent.functions.vectors import let
from nascent.llm.common import clean_text
from nascent.session import settle

# The patterns find what plain left-to-right matching finds. Possessive repeats and the
# look-behinds only keep a failed match from being tried again at each character of a run.
LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
IP_PART = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
ADDED = ("general", "removed")
BLOCK = 512
SPAN = "struct<start:int,kind:int,end:int,value:string>"


@dataclass(frozen=True)
class DisclosureSettings:
    min_contexts: int = 3
    generalise_from: float = 0.9
    remove_from: float = 0.98
    min_length: int = 3


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Folded values before each element, starting with 0, for a step such as sum or maximum.

    Blocks first, then inside each: the work is in proportion to the length.
    """
    zero = F.lit(0)

    def before(start: Column, items: Column) -> Column:
        grown = F.aggregate(items, F.array(start), lambda done, x: F.concat(done, F.array(step(F.element_at(done, -1), x))))
        return F.slice(grown, 1, F.size(items))

    def of_blocks(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, zero, step))
        return F.flatten(F.zip_with(blocks, before(zero, totals), lambda b, start: before(start, b)))

    blocks = F.transform(F.sequence(F.lit(1), F.size(values), F.lit(BLOCK)), lambda i: F.slice(values, i, BLOCK))
    return F.when(F.size(values) > 0, let(blocks, of_blocks)).otherwise(F.array().cast("array<int>"))


def found(text: Column, pattern: str, kind: int, valid: Callable[[Column], Column]) -> Column:
    """Valid matches of a pattern with their places in code points."""

    def place(matches: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(matches))
        widths = F.zip_with(gaps, matches, lambda g, m: F.length(g) + F.length(m))
        starts = F.zip_with(running(widths, lambda a, b: a + b), gaps, lambda s, g: s + F.length(g))
        spans = F.zip_with(
            starts,
            matches,
            lambda s, m: F.struct(s.alias("start"), F.lit(kind).alias("kind"), (s + F.length(m)).alias("end"), m.alias("value")),
        )
        return F.filter(spans, lambda s: valid(s["value"]))

    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.rlike(pattern), let(matches, place)).otherwise(F.array().cast(f"array<{SPAN}>"))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(value: Column) -> Column:
    def add(total: Column, i: Column, digits: Column) -> Column:
        digit = F.substring(digits, i, F.lit(1)).cast("int")
        doubled = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, doubled).otherwise(digit)

    def check(digits: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda t, i: add(t, i, digits)) % 10 == 0

    return let(F.reverse(digits_of(value)), check)


def base_spans(text: Column) -> Column:
    """All base spans of a text, sorted by start, kind and end."""
    phone_digits = lambda v: F.length(digits_of(v)).between(9, 15)
    ip_parts = lambda v: F.forall(F.split(v, r"\."), lambda p: p.rlike(IP_PART))
    return F.array_sort(
        F.concat(
            F.when(F.contains(text, F.lit("@")), found(text, EMAIL, 0, lambda v: F.lit(True))).otherwise(F.array().cast(f"array<{SPAN}>")),
            found(text, IP, 1, ip_parts),
            found(text, CARD, 2, passes_luhn),
            F.when(F.contains(text, F.lit("+")), found(text, PHONE, 3, phone_digits)).otherwise(F.array().cast(f"array<{SPAN}>")),
        )
    )


def text_key(text: Column) -> Column:
    """Equal texts share it, and so do their spans."""
    return F.xxhash64(text)


def entity(span: Column) -> Column:
    """The protected value, written alike wherever it stands."""
    plain = F.when(span["kind"] >= 2, digits_of(span["value"])).otherwise(F.lower(span["value"]))
    return F.concat(span["kind"].cast("string"), F.lit(":"), plain)


def blanked(text: Column, spans: Column) -> Column:
    """The text with a space for every character of its sorted spans: places stay."""

    def pieces(reached: Column) -> Column:
        kept = F.zip_with(
            spans,
            reached,
            lambda s, r: F.concat(
                F.when(s["start"] >= r, F.substring(text, r + 1, s["start"] - r)).otherwise(""),
                F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(s["start"], r), F.lit(0))),
            ),
        )
        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(kept, ""), F.substring(text, last + 1, F.length(text)))

    reached = running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    return F.when(F.size(spans) > 0, let(reached, pieces)).otherwise(text)


def _words(text: Column, least: int) -> Column:
    """Terms of a text with their places."""
    pattern = r"[^\p{L}\p{N}]*[\p{L}\p{N}]+"

    def place(tokens: Column) -> Column:
        starts = running(F.transform(tokens, lambda t: F.length(t)), lambda a, b: a + b)
        plain = F.zip_with(
            starts,
            tokens,
            lambda s, t: let(
                F.regexp_replace(t, r"^[^\p{L}\p{N}]+", ""),
                lambda w: F.struct(F.lower(w).alias("term"), (s + F.length(t) - F.length(w)).alias("start"), (s + F.length(t)).alias("end")),
            ),
        )
        return F.filter(plain, lambda w: F.length(w["term"]) >= least)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)


def occurrences(docs: DataFrame, id_col: str, text_col: str, settings: DisclosureSettings) -> DataFrame:
    """``(id, __key, spans, entities, words)`` of every row, in one pass without a shuffle.

    ``words`` has all terms outside the base spans with their places; texts without an entity have none.
    """
    text = F.col("__text")
    rows = docs.select(F.col(id_col), clean_text(text_col).alias("__text"))
    rows = rows.select(id_col, "__text", base_spans(text).alias("spans"))
    words = F.when(F.size("spans") > 0, _words(blanked(text, F.col("spans")), settings.min_length))
    entities = F.array_distinct(F.transform("spans", entity))
    return rows.select(id_col, text_key(text).alias("__key"), "spans", entities.alias("entities"), words.alias("words"))


def disclosing(docs: DataFrame, rows: DataFrame, text_col: str, settings: DisclosureSettings) -> DataFrame | None:
    """``(__key, term, disclosure)``: for every text the terms that give one of its entities away.

    ``rows`` are settled ``occurrences``. None if no term qualifies; documents are scanned for
    the frequencies of terms only if some entity stands in enough texts.
    """
    marked = rows.where(F.size("spans") > 0)
    held = marked.select("__key", F.explode("entities").alias("entity")).groupBy("__key", "entity").agg(F.count("*").alias("weight"))
    entities = held.groupBy("entity").agg(F.count("*").alias("texts"), F.sum("weight").alias("with_entity"))
    total = docs.count()
    surprise = -F.log2(F.col("with_entity") / total)
    # A term meets its entity in no more rows than the entity has. One in more rows than this falls short.
    most = F.col("with_entity") * F.pow(F.lit(2.0), (1 - settings.generalise_from) * surprise) * (1 + 1e-9)
    entities = settle(entities.where((F.col("texts") >= settings.min_contexts) & (surprise > 0)).select("entity", "with_entity", most.alias("most")))
    if entities.isEmpty():
        return None
    held = settle(held.join(entities, "entity"))
    wanted = held.groupBy("__key").agg(F.max("weight").alias("weight"), F.max("most").alias("most"))
    once = marked.select("__key", F.array_distinct("words.term").alias("terms")).join(wanted, "__key").dropDuplicates(["__key"])
    stands = settle(once.select("__key", "weight", "most", F.explode("terms").alias("term")))
    # A term is in at least the rows in which it stands beside some entity. What is too
    # frequent with that many is so with all, so common words need not be counted.
    least = stands.groupBy("term").agg(F.count("*").alias("texts"), F.sum("weight").alias("rows"), F.max("most").alias("most"))
    least = least.where((F.col("texts") >= settings.min_contexts) & (F.col("rows") <= F.col("most")))
    terms = settle(least.select("term", "most"))
    words = F.array_distinct(F.split(F.lower(clean_text(text_col)), r"[^\p{L}\p{N}]+"))
    # All words are counted, summed before the shuffle: which of them are wanted depends on how
    # many entities there are, and with many it is nearly every word.
    counted = docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("with_term"))
    frequency = counted.join(terms, "term")
    frequency = frequency.where(F.col("with_term") <= F.col("most")).select("term", "with_term")
    rare = settle(stands.select("__key", "term").join(frequency, "term"))
    met = rare.join(held, "__key").where(F.col("with_term") <= F.col("most"))
    scored = met.groupBy("entity", "term", "with_entity", "with_term").agg(F.count("*").alias("texts"), F.sum("weight").alias("together"))
    disclosure = 1 + F.log2(F.least(F.col("together") / F.col("with_term"), F.lit(1.0))) / surprise
    scored = scored.where((F.col("texts") >= settings.min_contexts) & (disclosure >= settings.generalise_from))
    scored = settle(scored.select("entity", "term", disclosure.alias("disclosure")))
    if scored.isEmpty():
        return None
    found = met.select("__key", "entity", "term").join(scored, ["entity", "term"])
    return found.groupBy("__key", "term").agg(F.max("disclosure").alias("disclosure"))


def find_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: DisclosureSettings | None = None
) -> DataFrame:
    """``(id, __key, base, added)``: the base spans of every row and those of disclosing terms."""
    settings = settings or DisclosureSettings()
    rows = settle(occurrences(docs, id_col, text_col, settings))
    base = rows.select(id_col, "__key", F.col("spans").alias("base"))
    found = disclosing(docs, rows, text_col, settings)
    if found is None:
        return base.withColumn("added", F.array().cast(f"array<{SPAN}>"))
    found = settle(found)
    once = rows.where(F.size("spans") > 0).join(found.select("__key").distinct(), "__key", "left_semi")
    once = once.select("__key", "words").dropDuplicates(["__key"])
    kind = F.when(F.col("disclosure") >= settings.remove_from, len(KINDS) + 1).otherwise(len(KINDS))
    hit = once.select("__key", F.explode("words").alias("w")).select("__key", "w.*").join(found, ["__key", "term"])
    hit = hit.select("__key", F.struct("start", kind.alias("kind"), "end", F.col("term").alias("value")).cast(SPAN).alias("s"))
    spans = hit.groupBy("__key").agg(F.collect_list("s").alias("added"))
    joined = base.join(spans, "__key", "left")
    return joined.withColumn("added", F.coalesce("added", F.array().cast(f"array<{SPAN}>")))


def named(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, joined by commas."""
    names = F.array(*(F.lit(k) for k in (*KINDS, *ADDED)))
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def mask(text: Column, spans: Column) -> Column:
    """The text with every span replaced: a base span and a general term by its kind, others by nothing.

    Of overlapping spans the first by start and kind is named, and the rest of their union goes with it.
    """
    marks = F.array(F.lit("[EMAIL]"), F.lit("[IP]"), F.lit("[CARD]"), F.lit("[PHONE]"), F.lit("[TERM]"), F.lit(""))

    def pieces(sorted_spans: Column) -> Column:
        reached = running(F.transform(sorted_spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
        kept = F.zip_with(
            sorted_spans,
            reached,
            lambda s, r: F.when(s["start"] >= r, F.concat(F.substring(text, r + 1, s["start"] - r), F.get(marks, s["kind"]))).otherwise(""),
        )
        last = F.array_max(F.transform(sorted_spans, lambda s: s["end"]))
        return F.concat(F.array_join(kept, ""), F.substring(text, last + 1, F.length(text)))

    return F.when(F.size(spans) > 0, let(F.array_sort(spans), pieces)).otherwise(text)


def mask_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: DisclosureSettings | None = None
) -> DataFrame:
    """``docs`` with base spans and disclosing terms masked in the text; other columns as they are.

    Base spans are found where the text is; only added spans have to meet it, by a join
    that is left out if there are none.
    """
    added = find_spans(docs, id_col, text_col, settings).where(F.size("added") > 0)
    added = settle(added.groupBy("__key").agg(F.first("added").alias("__added")))
    text = clean_text(text_col)
    if added.isEmpty():
        return docs.withColumn(text_col, mask(text, base_spans(text)))
    keyed = docs.withColumn("__key", text_key(text)).join(added, "__key", "left")
    spans = F.concat(base_spans(text), F.coalesce("__added", F.array().cast(f"array<{SPAN}>")))
    return keyed.withColumn(text_col, mask(text, spans)).select(*docs.columns)
