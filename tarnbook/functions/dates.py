"""Dates as surveyors write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two date formats, each with the text that may stand for it.  Text after the date is
# ignored; a month may be spelled out, its first three letters count.
DATE_SHAPES = {
    "d-MMM-yy": r"^\s*(\d{1,2})-([A-Za-z]{3})[A-Za-z]*-(\d{2})",
    "d MMM yyyy": r"^\s*(\d{1,2})\s+([A-Za-z]{3})[A-Za-z]*\s+(\d{4})",
}


def to_day(c: Column, fmt: str = "d MMM yyyy", pivot: int = 2025) -> Column:
    """Parse a day, null where the text is none; two-digit years never land after ``pivot``."""
    shape = DATE_SHAPES[fmt]
    parts = [F.regexp_extract(c, shape, i) for i in (1, 2, 3)]
    pattern = fmt.replace(" ", "-")
    day = F.try_to_date(F.concat_ws("-", *parts), pattern)
    if fmt.endswith("yyyy"):
        return day
    return F.when(F.year(day) > pivot, F.add_months(day, -1200)).otherwise(day)


def first_of_january(year: Column) -> Column:
    return F.make_date(year.cast("int"), F.lit(1), F.lit(1))
