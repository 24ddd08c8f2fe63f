"""Name keys and text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that do not tell one water body from another.
GENERIC_SITE_WORDS = ("LAKE", "RIVER")


def squish(c: Column) -> Column:
    """Trim, and turn every run of white space into one blank."""
    return F.trim(F.regexp_replace(c, r"[\s\p{Z}]+", " "))


def title_case(c: Column) -> Column:
    """First letter of every word in upper case; hyphens and brackets start words too."""
    return F.collate(F.initcap(F.collate(c, "UNICODE")), "UTF8_BINARY")


def site_name_key(c: Column, words: tuple[str, ...] = GENERIC_SITE_WORDS) -> Column:
    """Comparison key of a site name: upper case without generic words, punctuation and extra blanks."""
    # \p{P} is punctuation only; \p{Punct} would also take symbols such as $ and +.
    dropped = r"(?U)\b(?:" + "|".join(words) + r")\b|\p{P}"
    return squish(F.regexp_replace(F.upper(c), dropped, ""))


def area_name_key(c: Column) -> Column:
    """Comparison key of an area name: ``&`` spelled out, punctuation blanked, title case."""
    key = F.regexp_replace(F.lower(c), "&", "and")
    return title_case(squish(F.regexp_replace(key, r"\p{P}", " ")))


def blank_as_null(c: Column) -> Column:
    """Null for text that is empty or only blanks."""
    return F.when(F.trim(c) != "", c)


def paste(*cols: Column, sep: str = " ") -> Column:
    """Join as text, a null printing as ``NA``."""
    return F.concat_ws(sep, *[F.coalesce(c.cast("string"), F.lit("NA")) for c in cols])


def contains_ignoring_case(text: Column, part: Column) -> Column:
    return F.contains(F.upper(text), F.upper(part))


def name_as_pattern(name: Column) -> Column:
    """A name read as a pattern in the one way that makes sense for names.

    ``.`` stands for any character and brackets only group; everything else is literal.
    """
    literal = F.regexp_replace(name, r"[()]", "")
    return F.regexp_replace(literal, r"([\\\[\]{}*+?|^$])", r"\\$1")


def length_gap(a: Column, b: Column) -> Column:
    return F.abs(F.length(a) - F.length(b))
