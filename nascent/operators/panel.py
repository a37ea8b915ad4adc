"""Panel building and the summaries computed from a panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nascent.functions import dates, text

ID = "complaint_id"
DATE = "date_received"
WINDOW = "window_id"
NARRATIVE = "consumer_complaint_narrative"
WORDS = "narrative_word_count"

# Fixed order of the panel's columns.
PANEL_COLUMNS = (ID, DATE, WINDOW, "product", "issue", "sub_issue", NARRATIVE, WORDS)


def with_dates(raw: DataFrame) -> DataFrame:
    """``raw`` with its date as a timestamp; a date that arrives as text is parsed leniently."""
    if dict(raw.dtypes)[DATE] != "string":
        return raw
    return raw.withColumn(DATE, dates.lenient_timestamp(F.col(DATE)))


def unparsed_dates(raw: DataFrame) -> DataFrame:
    """One row: how many rows there are, have no date, and have one that cannot be read."""
    read = with_dates(raw.withColumn("_given", F.col(DATE).isNotNull()))
    return read.agg(
        F.count("*").alias("complaints"),
        F.count(F.when(~F.col("_given"), 1)).alias("without_date"),
        F.count(F.when(F.col("_given") & F.col(DATE).isNull(), 1)).alias("unparsed"),
    )


def with_narratives(raw: DataFrame, min_words: int = 10, strict: bool = False) -> DataFrame:
    """Rows whose narrative is present and long enough, with its word count.

    A date that arrives as text is parsed leniently; rows without a usable date go.
    The length test reads only the first ``min_words`` words, so a plan that never
    uses the count never counts.
    """
    kept = raw.where(text.has_words(F.col(NARRATIVE), max(min_words, 1)))
    if strict:
        kept = kept.where(text.is_present(F.col(NARRATIVE), strict=True))
    kept = with_dates(kept)
    return kept.where(F.col(DATE).isNotNull()).withColumn(WORDS, text.word_count(F.col(NARRATIVE)))


def build_panel(raw: DataFrame, window: str = "M", min_words: int = 10) -> DataFrame:
    """Filter, derive the window and keep the panel columns that exist.

    Everything is a narrow transformation, so the panel is one pass over the scan.
    Order by date is left to the sink (see ``sources.sinks.write_panel``).
    """
    labelled = with_narratives(raw, min_words).withColumn(
        WINDOW, dates.window_label(F.col(DATE), window)
    )
    return labelled.select(*[c for c in PANEL_COLUMNS if c in labelled.columns])


def before_cutoff(panel: DataFrame, cutoff: str) -> DataFrame:
    """Only what was received before the recognition date."""
    return panel.where(F.col(DATE) < F.lit(cutoff).cast(dict(panel.dtypes)[DATE]))


def volume_per_window(panel: DataFrame) -> DataFrame:
    return panel.groupBy(WINDOW).agg(F.count("*").alias("complaints"))


def volume_with_share(panel: DataFrame) -> DataFrame:
    """Volume per window, its share of the whole and its rank by size.

    The windows over all rows see one row per time window, never the complaints.
    """
    everything = Window.partitionBy()
    return volume_per_window(panel).select(
        WINDOW,
        "complaints",
        F.round(F.col("complaints") / F.sum("complaints").over(everything), 6).alias("share"),
        F.row_number()
        .over(Window.orderBy(F.desc("complaints"), F.col(WINDOW)))
        .cast("long")
        .alias("size_rank"),
    )


def top_values(panel: DataFrame, column: str, n: int = 15) -> DataFrame:
    """The ``n`` most frequent values, ties in value order."""
    return (
        panel.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("complaints"))
        .orderBy(F.desc("complaints"), F.col(column))
        .limit(n)
    )


def length_histogram(panel: DataFrame, clip: int = 600, bins: int = 50) -> DataFrame:
    """Histogram of clipped word counts, edges taken from the clipped data.

    Complaints are first reduced to at most ``clip + 1`` distinct lengths; only
    those reach the step that knows the overall minimum and maximum.
    """
    lengths = (
        panel.select(F.least(F.col(WORDS), F.lit(clip)).alias("length"))
        .groupBy("length")
        .agg(F.count("*").alias("n"))
    )
    everything = Window.partitionBy()
    spread = lengths.select(
        "length", "n", F.min("length").over(everything).alias("lo"), F.max("length").over(everything).alias("hi")
    )
    # All lengths equal: a unit-wide range around the value, as numpy does.
    bin_of = F.when(F.col("lo") == F.col("hi"), F.lit(bins // 2)).otherwise(
        F.least(
            F.expr(f"(length - lo) * {bins} div nullif(hi - lo, 0)"), F.lit(bins - 1)
        )
    )
    low_edge = F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo").cast("double"))
    width = F.when(F.col("lo") == F.col("hi"), F.lit(1.0)).otherwise(
        (F.col("hi") - F.col("lo")).cast("double")
    )
    return (
        spread.withColumn("bin", bin_of.cast("int"))
        .withColumn("low_edge", F.round(low_edge + width * F.col("bin") / bins, 6))
        .groupBy("bin", "low_edge")
        .agg(F.sum("n").alias("complaints"))
    )


def narrative_rate(raw: DataFrame, freq: str = "M") -> DataFrame:
    """Share of complaints with a narrative, per window and overall.

    Computed before the narrative filter. The overall row has window ``all``; rows whose
    date cannot be read are counted under ``undated``.
    """
    label = F.coalesce(dates.window_label(F.col(DATE), freq), F.lit("undated"))
    counts = (
        with_dates(raw).select(
            label.alias(WINDOW),
            text.is_present(F.col(NARRATIVE)).cast("int").alias("present"),
        )
        .groupBy(WINDOW)
        .agg(F.count("*").alias("complaints"), F.sum("present").alias("with_narrative"))
    )
    rolled = counts.rollup(WINDOW).agg(
        F.sum("complaints").alias("complaints"),
        F.sum("with_narrative").alias("with_narrative"),
        F.grouping(WINDOW).alias("overall"),
    )
    return rolled.select(
        F.when(F.col("overall") == 1, F.lit("all")).otherwise(F.col(WINDOW)).alias(WINDOW),
        "complaints",
        "with_narrative",
        F.round(F.col("with_narrative") / F.col("complaints"), 6).alias("narrative_rate"),
    )


def summarize(panel: DataFrame) -> DataFrame:
    """One row describing the panel.

    Complaints are first counted per (window, product, length), which combines on
    the map side; distinct counts and the exact median then run on those counts.
    """
    cells = panel.groupBy(WINDOW, "product", WORDS).agg(F.count("*").alias("n"))
    return cells.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_complaints"),
        F.countDistinct(WINDOW).alias("n_windows"),
        F.min(WINDOW).alias("first_window"),
        F.max(WINDOW).alias("last_window"),
        F.countDistinct("product").alias("n_products"),
        F.coalesce(F.percentile(WORDS, 0.5, F.col("n")), F.lit(0.0)).alias("median_narrative_words"),
    )


def integrity(panel: DataFrame) -> DataFrame:
    """One row: size, unique and duplicate ids, missing texts, window range.

    One shuffle on the id, combined before it; distinct counts of windows and
    products come from a second, tiny aggregate.
    """
    per_id = panel.groupBy(ID).agg(
        F.count("*").alias("n"), F.sum(F.col(NARRATIVE).isNull().cast("int")).alias("missing")
    )
    ids = per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count(F.when(F.col(ID).isNotNull(), 1)).alias("unique_ids"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_ids"),
        F.coalesce(F.sum("missing"), F.lit(0)).alias("null_narratives"),
        F.lit(1).alias("one"),
    )
    spans = (
        panel.groupBy(WINDOW, "product")
        .agg(F.count("*").alias("n"))
        .agg(
            F.countDistinct(WINDOW).alias("n_windows"),
            F.min(WINDOW).alias("first_window"),
            F.max(WINDOW).alias("last_window"),
            F.countDistinct("product").alias("n_products"),
            F.lit(1).alias("one"),
        )
    )
    return ids.join(spans, "one").drop("one")


def edge_windows(panel: DataFrame, head: int = 4, tail: int = 8) -> DataFrame:
    """Sizes of the first and last windows."""
    sizes = volume_per_window(panel).select(
        WINDOW,
        "complaints",
        F.row_number().over(Window.orderBy(WINDOW)).alias("from_start"),
        F.row_number().over(Window.orderBy(F.desc(WINDOW))).alias("from_end"),
    )
    return sizes.where((F.col("from_start") <= head) | (F.col("from_end") <= tail)).select(
        WINDOW,
        "complaints",
        (F.col("from_start") <= head).alias("in_head"),
        (F.col("from_end") <= tail).alias("in_tail"),
    )


def drill_down(facts: DataFrame, dimensions: list[str], alert: str | None = None) -> DataFrame:
    """Volume (and alert volume) over every combination of ``dimensions``.

    Facts are reduced to one row per full combination before the cube expands them.
    """
    flag = F.col(alert).cast("int") if alert else F.lit(0)
    base = facts.groupBy(*dimensions).agg(F.count("*").alias("n"), F.sum(flag).alias("a"))
    return base.cube(*dimensions).agg(
        F.grouping_id().cast("int").alias("level"),
        F.sum("n").alias("complaints"),
        F.sum("a").alias("alerts"),
    )
