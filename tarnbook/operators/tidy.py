"""Shaping single tables: selection, order of columns, blanks, unions, long and wide."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnbook.functions.numbers import to_number
from tarnbook.functions.text import blank_as_null


def canonical_columns(df: DataFrame, mapping: Mapping[str, str] | None = None) -> DataFrame:
    """Snake-case names; ``mapping`` (old to new) wins where it has an entry."""
    mapping = mapping or {}

    def snake(name: str) -> str:
        cleaned = "".join(ch if ch.isalnum() else " " for ch in name)
        return "_".join(cleaned.lower().split())

    return df.toDF(*[mapping.get(name, snake(name)) for name in df.columns])


def select_span(df: DataFrame, *spans: str | tuple[str, str]) -> DataFrame:
    """Select columns; a pair stands for every column from the first to the last of it."""
    names: list[str] = []
    for span in spans:
        if isinstance(span, str):
            names.append(span)
            continue
        start, end = df.columns.index(span[0]), df.columns.index(span[1])
        names.extend(df.columns[start : end + 1])
    return df.select(*[F.col(f"`{n}`") for n in dict.fromkeys(names)])


def drop_index_column(df: DataFrame, name: str = "X") -> DataFrame:
    """Drop a row-number column left by an earlier export, if it is there."""
    return df.drop(name)


def relocate(df: DataFrame, cols: Sequence[str], after: str | None = None, before: str | None = None) -> DataFrame:
    """Move columns next to another one (to the front without one)."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    rest = [c for c in df.columns if c not in cols]
    at = 0
    if after is not None:
        at = rest.index(after) + 1
    elif before is not None:
        at = rest.index(before)
    return df.select(*rest[:at], *cols, *rest[at:])


def blank_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Turn blank text into null, in the given columns or in every text column."""
    if cols is None:
        cols = [name for name, kind in df.dtypes if kind == "string"]
    return df.withColumns({c: blank_as_null(F.col(c)) for c in cols})


def sentinel_to_null(df: DataFrame, col: str, sentinel) -> DataFrame:
    return df.withColumn(col, F.nullif(F.col(col), F.lit(sentinel)))


def bbox_filter(df: DataFrame, x: str, y: str, xmin: float, xmax: float, ymin: float, ymax: float) -> DataFrame:
    """Rows inside a window, edges included."""
    return df.where(F.col(x).between(xmin, xmax) & F.col(y).between(ymin, ymax))


def stack(*dfs: DataFrame, fill: bool = True) -> DataFrame:
    """Union by name; ``fill`` gives missing columns nulls, without it the names must agree."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=fill), dfs)


def lengthen(df: DataFrame, prefix: str, name_col: str, value_col: str) -> DataFrame:
    """One row per filled cell of the columns whose name starts with ``prefix`` (in any case)."""
    wide = [c for c in df.columns if c.lower().startswith(prefix.lower())]
    keep = [c for c in df.columns if c not in wide]
    return df.unpivot(keep, wide, name_col, value_col).where(F.trim(value_col) != "")


def widen(df: DataFrame, keys: Sequence[str], names_from: str, values: Mapping[str, str], agg: Column) -> DataFrame:
    """One column per listed category; a category nobody has still gives its column.

    ``values`` maps a category to the name of its column.
    """
    pivoted = df.groupBy(*keys).pivot(names_from, list(values)).agg(agg)
    return pivoted.withColumnsRenamed(dict(values))


def explode_codes(df: DataFrame, col: str, sep: str = ",") -> DataFrame:
    """One row per code of a list; rows with no list, and codes that are no number, stay as nulls."""
    split = df.withColumn(col, F.explode_outer(F.split(F.col(col), sep)))
    return split.withColumn(col, to_number(F.col(col)))
