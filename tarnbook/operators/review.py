"""The round trip to a person: cases out, decisions back, known mistakes overridden."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnbook.operators.joins import Keys, key_pairs, left_lookup, lookup

AUTOMATIC_BAND = "confident"


def automatic_decisions(df: DataFrame, band: str = "match_status") -> DataFrame:
    """Decide what needs no person: confident matches are matches."""
    sure = F.col(band) == AUTOMATIC_BAND
    return df.withColumns(
        {
            "match_decision": F.when(sure, "automatic").cast("string"),
            "match_status_confirmed": F.when(sure, "match").cast("string"),
        }
    )


def review_queue(df: DataFrame, band: str = "match_status") -> DataFrame:
    """Cases a person has to look at."""
    return df.where(F.col(band) != AUTOMATIC_BAND)


DECISION = ("match_decision", "match_status_confirmed")


DECIDED_AT = "decided_at"


def decisions_as_of(log: DataFrame, record_id: str = "record_id", order_by: Sequence[str] | None = None, time: str = DECIDED_AT, as_of=None) -> DataFrame:
    """One decision per record from a log of them: the last one, or the last one up to the time ``as_of``.

    The order is ``order_by``, or the log's column ``time`` and, among decisions of one time, the other columns.  A log without
    either must not hold different decisions for one record.
    """
    if as_of is not None:
        log = log.where(F.col(time) <= F.lit(as_of))
    cols = list(DECISION)
    if order_by is None and time not in log.columns:
        several = log.select(record_id, *cols).distinct().groupBy(record_id).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if not several.isEmpty():
            raise ValueError(f"records with several decisions need an order: give order_by, or a column {time}")
    order = list(order_by) if order_by is not None else [c for c in (time, *cols) if c in log.columns]
    # A null time is before all others.
    rest = [c for c in log.columns if c != record_id]
    made = log.groupBy(record_id).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__made"))
    return made.select(record_id, "__made.*")


def apply_decisions(df: DataFrame, decisions: DataFrame, record_id: str = "record_id", order_by: Sequence[str] | None = None, time: str = DECIDED_AT, as_of=None) -> DataFrame:
    """Enter decisions by record id; decisions for unknown records are ignored, undecided cases stay.

    Of several decisions for one record the last one counts, as in :func:`decisions_as_of`.
    """
    cols = list(DECISION)
    made = decisions_as_of(decisions, record_id, order_by, time, as_of).select(record_id, *[F.col(c).alias(f"__{c}") for c in cols])
    joined = left_lookup(df, made, record_id)
    return joined.withColumns({c: F.coalesce(f"__{c}", c) for c in cols}).drop(*[f"__{c}" for c in cols])


def relink_orphans(df: DataFrame, decisions: DataFrame, by: Sequence[str], record_id: str = "record_id") -> DataFrame:
    """Decisions whose record changed its id, entered under the id of the record that is like it in the columns ``by``.

    Record ids are made from content, so a record whose comment was mended has a new one.  An orphan is linked if exactly one record
    without a decision of its own is like it, and if no other orphan record is; the others come back as they are, with
    ``relinked`` false.  Nulls in ``by`` are alike.
    """
    orphans = orphan_decisions(df, decisions, record_id)
    free = lookup(df, decisions.select(record_id).distinct(), record_id, "left_anti").select(record_id, *by).distinct()
    one = free.groupBy(*by).agg(F.min(record_id).alias("__new"), F.count(F.lit(1)).alias("__n")).where("__n = 1").drop("__n")
    alike = orphans.select(record_id, *by).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("__m")).where("__m = 1").drop("__m")
    known = left_lookup(left_lookup(orphans, one, list(by)), alike.withColumn("__single", F.lit(True)), list(by))
    found = F.col("__new").isNotNull() & F.coalesce("__single", F.lit(False))
    return known.withColumn(record_id, F.when(found, F.col("__new")).otherwise(F.col(record_id))).withColumn("relinked", found).drop("__new", "__single")


def orphan_decisions(df: DataFrame, decisions: DataFrame, record_id: str = "record_id") -> DataFrame:
    """Decisions whose record is not there (any more); their number belongs in the report of a job."""
    return lookup(decisions, df, record_id, "left_anti")


def apply_overrides(
    df: DataFrame,
    overrides: DataFrame,
    keys: Keys,
    null_cols: Sequence[str],
    set_cols: Mapping[str, str],
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """Where a row is listed in ``overrides``: null some columns and set others.

    ``set_cols`` maps a column to the one of ``overrides`` that holds its new value.  Of several overrides with one key the
    first in the order of ``order_by`` (the new values, if not given) counts.
    """
    pairs = key_pairs(keys)
    values = list(dict.fromkeys(set_cols.values()))
    first = F.min_by(F.struct(*values), F.struct(*(order_by or values))).alias("__first")
    listed = overrides.groupBy(*pairs.values()).agg(first).select(
        *pairs.values(), *[F.col(f"__first.{v}").alias(f"__set_{k}") for k, v in set_cols.items()], F.lit(True).alias("__listed")
    )
    joined = left_lookup(df, listed, pairs)
    hit = F.coalesce("__listed", F.lit(False))
    changes = {c: F.when(~hit, F.col(c)) for c in null_cols}
    changes |= {c: F.when(hit, F.col(f"__set_{c}")).otherwise(F.col(c)) for c in set_cols}
    return joined.withColumns(changes).drop("__listed", *[f"__set_{c}" for c in set_cols])
