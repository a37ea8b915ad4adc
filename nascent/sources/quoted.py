"""CSV whose quoted fields hold line breaks, read by byte ranges.

A file is split at line ends, wherever they are. Whether a line starts inside quotes follows
from the number of quotes before it: each range counts its own in one pass, the counts of
the ranges are summed in order of the file, and in a second pass every line knows its place.
A line that neither starts nor ends inside quotes is a record; the others are put together
by the record in which they start, also over the ends of ranges. Only these are shuffled.

Quotes inside fields are doubled, as RFC 4180 says; a quote in an unquoted field, or one that
is never closed, joins what follows, as with any reader that goes by quotes. Records end with
``\\n`` or ``\\r\\n``; line breaks inside quotes stay as they are. Blank lines are skipped,
missing and empty fields are null, and surplus ones
are dropped. Every file has its own header. Files
that cannot be split, such as gzip, are one range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nascent.session import attach_small, settle

OPTIONS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}
RANGE = ["file", "block"]


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, block, odd, line)``; ``odd`` tells an odd number of quotes."""
    lines = spark.read.option("lineSep", "\n").text(path).withColumnRenamed("value", "line")
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    quotes = F.length("line") - F.length(F.replace(F.col("line"), F.lit('"'), F.lit("")))
    return lines.select(*place, (quotes % 2 == 1).alias("odd"), "line")


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, bool, np.ndarray, np.ndarray]]:
    """Parts of ranges, whether each goes on with the last one's, and quotes before and after its lines."""
    key, held = None, False
    for batch in batches:
        change = (batch["file"] != batch["file"].shift()) | (batch["block"] != batch["block"].shift())
        for _, part in batch.groupby(change.cumsum(), sort=False):
            now = (part["file"].iloc[0], part["block"].iloc[0])
            again, key = now == key, now
            held = held and again
            after = np.logical_xor.accumulate(np.append(held, part["odd"].to_numpy(bool)))
            held = bool(after[-1])
            yield part, again, after[:-1], after[1:]


def _totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row a range: its lines that start after an even and after an odd number of quotes, and the parity."""
    rows: list[list] = []
    for part, again, before, after in _runs(batches):
        inside = int(before.sum())
        if not again:
            rows.append([part["file"].iloc[0], part["block"].iloc[0], 0, 0, 0])
        rows[-1][2] += len(before) - inside
        rows[-1][3] += inside
        rows[-1][4] = int(after[-1])
    yield pd.DataFrame(rows, columns=[*RANGE, "outside", "inside", "parity"])


def _numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines with their number in the range, and the records begun so far in both cases."""
    line = outside = inside = 0
    for part, again, before, after in _runs(batches):
        if not again:
            line = outside = inside = 0
        out = part[[*RANGE, "line"]].copy()
        out["n"] = line + np.arange(len(part))
        out["before"], out["after"] = before, after
        out["outside"], out["inside"] = outside + np.cumsum(~before), inside + np.cumsum(before)
        line, outside, inside = line + len(part), int(out["outside"].iloc[-1]), int(out["inside"].iloc[-1])
        yield out


def records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, block, number, record)``: the text of every record, and where it starts.

    ``number`` counts the records that start in a range, from 1.
    """
    lines = _lines(spark, path)
    counts = "file string, block long, outside long, inside long, parity int"
    ranges = settle(lines.select(*RANGE, "odd").mapInPandas(_totals, counts))
    # A file scan may hand a range to its task in one piece only; windows see a row a range.
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.coalesce(F.sum("parity").over(earlier) % 2, F.lit(0)) == 1
    begun = F.when(F.col("opened"), F.col("inside")).otherwise(F.col("outside"))
    ranges = ranges.withColumn("opened", opened).withColumn("begun", begun)
    last = F.last(F.when(F.col("begun") > 0, F.struct("block", "begun")), ignorenulls=True).over(earlier)
    ranges = ranges.withColumn("last", last).select(*RANGE, "opened", "last")
    numbered = lines.mapInPandas(
        _numbered, "file string, block long, line string, n long, before boolean, after boolean, outside long, inside long"
    )
    known = attach_small(numbered, ranges, RANGE, spread="n")
    number = F.when(F.col("opened"), F.col("inside")).otherwise(F.col("outside"))
    placed = known.select(
        "file", "block", "n", "line", number.alias("number"), "last",
        (F.col("before") != F.col("opened")).alias("before"), (F.col("after") != F.col("opened")).alias("after"),
    )
    whole = placed.where(~F.col("before") & ~F.col("after")).select("file", "block", "number", F.col("line").alias("record"))
    parts = placed.where(F.col("before") | F.col("after")).select(
        "file",
        F.when(F.col("number") > 0, F.col("block")).otherwise(F.col("last.block")).alias("start"),
        F.when(F.col("number") > 0, F.col("number")).otherwise(F.col("last.begun")).alias("number"),
        F.struct("block", "n", "line").alias("part"),
    )
    joined = parts.groupBy("file", "start", "number").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["line"]), "\n")
    return whole.unionByName(joined.select("file", F.col("start").alias("block"), "number", text.alias("record")))


def read_quoted(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All columns as text, named by the header of the first file."""
    head = spark.read.options(**OPTIONS, header="true", multiLine="true").csv(path)
    names = [c.lstrip("﻿") for c in head.columns]
    found = records(spark, path)
    rows = found.where((F.col("block") > 0) | (F.col("number") > 1)).select(F.regexp_replace("record", "\r$", "").alias("record"))
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    fields = F.from_csv("record", F.lit(schema), {**OPTIONS, "multiLine": "true"})
    return rows.where("record != ''").select(fields.alias("fields")).select(*[F.col("fields")[n].alias(n) for n in names])
