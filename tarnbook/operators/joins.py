"""Joins on site and area keys.

A null key counts as a value here: sites without a watershed form one group, and find each other.
Spark plans ``<=>`` as an equi join, so these are hash or sort-merge joins; which of them, and whether
a side is small enough to broadcast, is decided by Spark from measured sizes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Keys = str | Sequence[str] | Mapping[str, str]


def key_pairs(keys: Keys) -> dict[str, str]:
    """Left to right key names, from one name, a list of names or a mapping."""
    if isinstance(keys, str):
        return {keys: keys}
    return dict(keys) if isinstance(keys, Mapping) else {k: k for k in keys}


def _aliased(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    # Aliases give the columns new identities, so a table can be joined to something made from it.
    return df.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns])


def _match(pairs: Mapping[str, str], null_safe: bool) -> tuple[dict[str, str], Column]:
    renamed = {right: f"__key_{i}" for i, right in enumerate(pairs.values())}
    conditions = [
        F.col(left).eqNullSafe(F.col(renamed[right])) if null_safe else F.col(left) == F.col(renamed[right])
        for left, right in pairs.items()
    ]
    return renamed, reduce(lambda a, b: a & b, conditions)


def lookup(df: DataFrame, other: DataFrame, keys: Keys, how: str = "left", null_safe: bool = True) -> DataFrame:
    """Join columns of ``other`` on; its key columns are dropped, other names must not clash."""
    pairs = key_pairs(keys)
    extra = set(other.columns) - set(pairs.values())
    clash = sorted(extra & set(df.columns))
    if clash and how not in ("left_semi", "left_anti"):
        raise ValueError(f"both sides have {clash}")
    renamed, condition = _match(pairs, null_safe)
    if how in ("left_semi", "left_anti"):
        right = other.select(*[F.col(r).alias(n) for r, n in renamed.items()]).distinct()
        return df.join(right, condition, how)
    return df.join(_aliased(other, renamed), condition, how).drop(*renamed.values())


def left_lookup(df: DataFrame, other: DataFrame, keys: Keys) -> DataFrame:
    """Left join on one or many keys; every match is kept."""
    return lookup(df, other, keys, "left")


def decode(df: DataFrame, code: str, table: DataFrame, table_code: str) -> DataFrame:
    """Replace a code by the columns the table has for it."""
    return left_lookup(df, table, {code: table_code}).drop(code)


def full_merge(
    a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str], suffixes=("_meta", "_fish")
) -> DataFrame:
    """Full outer join; of every column in ``cols`` both versions and the first one present."""
    left = a.select(*keys, *[F.col(c).alias(c + suffixes[0]) for c in cols])
    right = b.select(
        *[F.col(k).alias(f"__key_{i}") for i, k in enumerate(keys)], *[F.col(c).alias(c + suffixes[1]) for c in cols]
    )
    condition = reduce(lambda p, q: p & q, [F.col(k).eqNullSafe(F.col(f"__key_{i}")) for i, k in enumerate(keys)])
    return left.join(right, condition, "full").select(
        *[F.coalesce(F.col(k), F.col(f"__key_{i}")).alias(k) for i, k in enumerate(keys)],
        *[F.col(c + s) for s in suffixes for c in cols],
        *[F.coalesce(F.col(c + suffixes[0]), F.col(c + suffixes[1])).alias(c) for c in cols],
    )


def with_group_agg(df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """Aggregate per group and put the result on every row of it.

    The groups are aggregated before they are shuffled and then joined on, so that a group holding
    much of the table is never gathered in one place as a window over it would do.
    """
    return left_lookup(df, df.groupBy(*keys).agg(*aggs), keys)


def overlay(df: DataFrame, other: DataFrame, keys: Keys, cols: Sequence[str], when: Column) -> DataFrame:
    """Where ``when`` holds, take ``cols`` from ``other`` (null if it has no such key)."""
    pairs = key_pairs(keys)
    replacement = other.select(*pairs.values(), *[F.col(c).alias(f"__new_{c}") for c in cols])
    joined = left_lookup(df, replacement, pairs)
    for c in cols:
        joined = joined.withColumn(c, F.when(when, F.col(f"__new_{c}")).otherwise(F.col(c)))
    return joined.drop(*[f"__new_{c}" for c in cols])


def apply_crosswalk(df: DataFrame, col: str, crosswalk: DataFrame, from_col="from_name", to_col="to_name") -> DataFrame:
    """Rename values of a column by a table of names; names without an entry stay.  Of two entries for a name the smaller counts."""
    entries = crosswalk.groupBy(F.col(from_col).alias("__from")).agg(F.min(to_col).alias("__to"))
    return (
        left_lookup(df, entries, {col: "__from"}).withColumn(col, F.coalesce("__to", col)).drop("__to")
    )
