"""Date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Layouts seen in raw complaint files beside ISO dates; parts may have one digit.
TIME = "[ H:mm[:ss[.SSSSSS]]]"
DATE_LAYOUTS = (f"M/d/yyyy{TIME}", f"M/d/yy{TIME}", f"yyyy/M/d{TIME}", f"MMM d, yyyy{TIME}", f"d MMM yyyy{TIME}")
ISO_DATE = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"


def lenient_timestamp(text: Column, layouts: tuple[str, ...] = DATE_LAYOUTS) -> Column:
    """Parse ISO dates with any time, fraction and zone, else the first layout that fits.

    Null where nothing fits. White space around the date is ignored.
    """
    plain = F.regexp_replace(text, r"^\s+|\s+$", "")
    iso = F.when(plain.rlike(ISO_DATE), plain.try_cast("timestamp"))
    return F.coalesce(iso, *[F.try_to_timestamp(plain, F.lit(layout)) for layout in layouts])


def window_label(when: Column, freq: str = "M") -> Column:
    """Period label that sorts in time order: day, week, month, quarter or year."""
    if freq == "M":
        return F.date_format(when, "yyyy-MM")
    if freq == "D":
        return F.date_format(when, "yyyy-MM-dd")
    if freq == "Y":
        return F.date_format(when, "yyyy")
    if freq == "Q":
        return F.concat(F.date_format(when, "yyyy"), F.lit("Q"), F.quarter(when).cast("string"))
    if freq == "W":
        monday = F.date_trunc("week", when).cast("date")
        return F.concat_ws(
            "/",
            F.date_format(monday, "yyyy-MM-dd"),
            F.date_format(F.date_add(monday, 6), "yyyy-MM-dd"),
        )
    raise ValueError(f"unknown window {freq!r}")


def month_index(label_or_date: Column) -> Column:
    """Months since year zero, from anything whose text starts with ``yyyy-MM``."""
    text = label_or_date.cast("string")
    return F.substring(text, 1, 4).cast("int") * 12 + F.substring(text, 6, 2).cast("int")
