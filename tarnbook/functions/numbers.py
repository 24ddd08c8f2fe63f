"""Numbers written as text, packed coordinates, year arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(c: Column) -> Column:
    """A double, or null where the text is no number (a plain cast would stop the job)."""
    return F.trim(c.cast("string")).try_cast("double")


def ddmm_to_degrees(c: Column) -> Column:
    """Packed degrees and minutes (``4430`` is 44° 30′) as decimal degrees."""
    packed = c.cast("double")
    return F.floor(packed / 100) + F.pmod(packed, F.lit(100.0)) / 60


def west(c: Column, mode: str = "always") -> Column:
    """Longitude with a western sign: negate ``always``, or only where it is positive (``if_positive``)."""
    if mode == "always":
        return -c
    if mode == "if_positive":
        return -F.abs(c)
    raise ValueError(f"unknown mode {mode!r}")


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def decade_label(year: Column) -> Column:
    """``1980s``; null for an unknown year."""
    return F.concat(decade(year).cast("string"), F.lit("s"))


def fix_century(year: Column, pivot: int = 2025) -> Column:
    """Years after ``pivot`` came from two digits and belong to the century before."""
    return F.when(year > pivot, year - 100).otherwise(year)
