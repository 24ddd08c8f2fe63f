"""Is a watched species present at a site, credibly absent, or unknown?

Rule sets: ``v3`` is the current one; ``v2`` does not tell a present species with an unknown partner apart and
treats undated detections as unknown arrival; ``v1`` only asks whether a site was visited after the first
arrival of either species in its area.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnbook.functions.dates import to_day
from tarnbook.operators.groups import crosstab, source_label
from tarnbook.operators.joins import left_lookup
from tarnbook.operators.tidy import relocate


@dataclass(frozen=True)
class Focal:
    """The two watched species: the values in the data, and short names for labels."""

    a: str
    b: str
    a_short: str
    b_short: str

    # Labels of a site's status (fixed values around the species names).
    both = "Both"
    none = "No AIS"
    unknown = "Unknown"
    unknown_v1 = "Unknown / insufficient data"

    @property
    def a_only(self) -> str:
        return f"{self.a} only"

    @property
    def b_only(self) -> str:
        return f"{self.b} only"

    @property
    def a_present_b_unknown(self) -> str:
        return f"{self.a_short} Present_{self.b_short} unknown"

    @property
    def b_present_a_unknown(self) -> str:
        return f"{self.b_short} Present_{self.a_short} unknown"

    @property
    def no_a_b_unknown(self) -> str:
        return f"No {self.a_short}_{self.b_short} unknown"

    @property
    def no_b_a_unknown(self) -> str:
        return f"No {self.b_short}_{self.a_short}_unknown"

    def labels(self, rules: str) -> list[str]:
        """All statuses a rule set can give."""
        common = [self.both, self.a_only, self.b_only, self.none]
        if rules == "v1":
            return [*common, self.unknown_v1]
        partial = [self.a_present_b_unknown, self.b_present_a_unknown] if rules == "v3" else []
        return [*common, *partial, self.no_a_b_unknown, self.no_b_a_unknown, self.unknown]


# The two watched species of the survey.
WATCHED = Focal("Smallmouth Bass", "Chain Pickerel", "SMB", "CP")

# Status of one species at one site.
PRESENT, ABSENT, INSUFFICIENT = "Present", "Absent", "Data insufficient"


def area_first(
    df: DataFrame, area: str, species: str, year: str, focal: Focal = WATCHED, rules: str = "v3"
) -> DataFrame:
    """First year of each watched species per area, one column each (null: no dated detection).

    ``ws_seen_a/b`` tell whether the species was detected at all, dated or not.  ``v3`` has no row for
    detections without an area.
    """
    seen = df.where(F.col(species).isin(focal.a, focal.b))
    if rules == "v3":
        seen = seen.where(F.col(area).isNotNull())
    is_a, is_b = F.col(species) == focal.a, F.col(species) == focal.b
    return seen.groupBy(area).agg(
        F.min(F.when(is_a, F.col(year))).alias("ws_first_a"),
        F.min(F.when(is_b, F.col(year))).alias("ws_first_b"),
        F.bool_or(is_a).alias("ws_seen_a"),
        F.bool_or(is_b).alias("ws_seen_b"),
    )


def _species_status(first: str, ws_first: str, ws_seen: str, rules: str) -> tuple[Column, Column]:
    """(absence believable, status) of one species; absence is null where the species is present."""
    present = F.col(first).isNotNull()
    never = F.col(ws_first).isNull()
    if rules == "v2":  # undated detections in the area: arrival unknown, so no absence can be believed
        never = never & ~F.coalesce(F.col(ws_seen), F.lit(False))
    visited_after = F.coalesce(F.col("last_sampled_year") >= F.col(ws_first), F.lit(False))
    believable = F.when(~present, never | visited_after)
    status = F.when(present, PRESENT).when(believable, ABSENT).otherwise(INSUFFICIENT)
    return believable, status


def combined_status(a: Column, b: Column, focal: Focal = WATCHED, rules: str = "v3") -> Column:
    """Site status from the status of each species."""
    here_a, here_b = a == PRESENT, b == PRESENT
    gone_a, gone_b = a == ABSENT, b == ABSENT
    status = F.when(here_a & here_b, focal.both)
    if rules == "v3":
        status = (
            status.when(here_a & gone_b, focal.a_only)
            .when(gone_a & here_b, focal.b_only)
            .when(here_a, focal.a_present_b_unknown)
            .when(here_b, focal.b_present_a_unknown)
        )
    else:
        status = status.when(here_a, focal.a_only).when(here_b, focal.b_only)
    return (
        status.when(gone_a & gone_b, focal.none)
        .when(gone_a, focal.no_a_b_unknown)
        .when(gone_b, focal.no_b_a_unknown)
        .otherwise(focal.unknown)
    )


def site_status(
    df: DataFrame,
    site: Sequence[str],
    area: str,
    species: str,
    year: str,
    focal: Focal = WATCHED,
    rules: str = "v3",
    source: tuple[str, str, str] | None = None,
) -> DataFrame:
    """One row per site with first and last years and the status; ``area`` must be one of the ``site`` columns.

    ``source`` = (column, first database, second database) adds where the site's rows come from.
    """
    if area not in site:
        raise ValueError(f"{area} must be part of the site's identity")
    value, is_a, is_b = F.col(year), F.col(species) == focal.a, F.col(species) == focal.b
    aggs = [
        F.max(value).alias("last_sampled_year"),
        F.min(F.when(is_a, value)).alias("first_a"),
        F.min(F.when(is_b, value)).alias("first_b"),
        F.bool_or(is_a).alias("__seen_a"),
        F.bool_or(is_b).alias("__seen_b"),
    ]
    if source:
        aggs.append(source_label(*source).alias("data_source"))
    # Detections are read and shuffled once: a site lies in one area, so the area's first year is the
    # smallest of its sites'.
    summary = df.groupBy(*site).agg(*aggs)
    hit = summary.where(F.col("__seen_a") | F.col("__seen_b"))
    if rules == "v3":
        hit = hit.where(F.col(area).isNotNull())
    arrivals = hit.groupBy(area).agg(
        F.min("first_a").alias("ws_first_a"),
        F.min("first_b").alias("ws_first_b"),
        F.bool_or("__seen_a").alias("ws_seen_a"),
        F.bool_or("__seen_b").alias("ws_seen_b"),
    )
    sites = left_lookup(summary.drop("__seen_a", "__seen_b"), arrivals, area)
    if rules == "v1":
        a, b = F.col("first_a").isNotNull(), F.col("first_b").isNotNull()
        after = F.col("last_sampled_year") >= F.col("ws_first_any")
        status = (
            F.when(a & b, focal.both).when(a, focal.a_only).when(b, focal.b_only).when(after, focal.none)
            .otherwise(focal.unknown_v1)
        )
        return (
            sites.withColumn("ws_first_any", F.least("ws_first_a", "ws_first_b"))
            .withColumn("sampled_post_invasion", after)
            .withColumn("site_status", status)
            .drop("ws_seen_a", "ws_seen_b")
        )
    believable_a, status_a = _species_status("first_a", "ws_first_a", "ws_seen_a", rules)
    believable_b, status_b = _species_status("first_b", "ws_first_b", "ws_seen_b", rules)
    return (
        sites.withColumns(
            {"absence_a_believable": believable_a, "absence_b_believable": believable_b, "status_a": status_a, "status_b": status_b}
        )
        .withColumn("site_status", combined_status(F.col("status_a"), F.col("status_b"), focal, rules))
        .drop("ws_seen_a", "ws_seen_b")
    )


def area_status(
    status: DataFrame,
    key: str,
    rules: str = "v3",
    focal: Focal = WATCHED,
    name: str = "area_status",
    count_partial: bool = False,
) -> DataFrame:
    """Status of an area from the statuses of its sites (``rules="map"`` for the map's variant).

    Sites with one species present and the other unknown do not count, unless ``count_partial``.
    """
    flags = status.groupBy(key).agg(*_flags(focal, count_partial))
    return flags.select(key, _area_label(rules, focal).alias(name))


def _flags(focal: Focal, count_partial: bool) -> list[Column]:
    """What is known of an area's sites, as aggregates."""
    s = F.col("site_status")
    a_labels = [focal.a_only] + ([focal.a_present_b_unknown] if count_partial else [])
    b_labels = [focal.b_only] + ([focal.b_present_a_unknown] if count_partial else [])
    return [
        F.bool_or(s == focal.both).alias("any_both"),
        F.bool_or(s.isin(a_labels)).alias("any_a"),
        F.bool_or(s.isin(b_labels)).alias("any_b"),
        F.bool_or(s == focal.unknown_v1).alias("any_unknown"),
        F.bool_and(s == focal.none).alias("all_none"),
    ]


def _area_label(rules: str, focal: Focal) -> Column:
    label = (
        F.when(F.col("any_both") | (F.col("any_a") & F.col("any_b")), focal.both)
        .when(F.col("any_b"), focal.b_only)
        .when(F.col("any_a"), focal.a_only)
    )
    if rules == "map":
        return label.when(F.col("any_unknown"), focal.unknown_v1).otherwise(focal.none)
    return label.when(F.col("all_none"), focal.none).otherwise(focal.unknown)


def area_levels(
    status: DataFrame,
    levels: Mapping[str, str],
    rules: str = "v3",
    focal: Focal = WATCHED,
    whole: str | None = "province",
    count_partial: bool = False,
) -> DataFrame:
    """``level, area, area_status, n_sites`` of every area of all levels, in one pass over the site summary.

    ``levels`` maps a level's name to its column; ``whole`` names the level that all sites make up (None: without it).  The site
    summary is read and shuffled once, as grouping sets; which set a row belongs to is told by its grouping id, so that
    the sites without an area are an area of their own and not mistaken for the whole.
    """
    columns = list(levels.values())
    sets = [[c] for c in columns] + ([[]] if whole else [])
    grouped = status.groupingSets(sets, *columns).agg(F.grouping_id().alias("__set"), F.count(F.lit(1)).alias("n_sites"), *_flags(focal, count_partial))
    # A column's bit in the grouping id is 0 where the row is grouped by it.
    every = (1 << len(columns)) - 1
    level, area = F.when(F.col("__set") == every, F.lit(whole)), F.lit(None).cast("string")
    for k, (name, column) in enumerate(levels.items()):
        own = F.col("__set") == every - (1 << (len(columns) - 1 - k))
        level, area = level.when(own, F.lit(name)), F.when(own, F.col(column).cast("string")).otherwise(area)
    return grouped.select(level.alias("level"), area.alias("area"), _area_label(rules, focal).alias("area_status"), "n_sites")


def status_crosstab(status: DataFrame, key: str, focal: Focal = WATCHED, rules: str = "v3") -> DataFrame:
    """Sites per area and status, one column per status."""
    return crosstab(status, key, "site_status", focal.labels(rules))


def with_status(df: DataFrame, status: DataFrame, site: Sequence[str]) -> DataFrame:
    """Put a site's status columns on each of its rows."""
    keep = [c for c in status.columns if c in site or c not in df.columns]
    return left_lookup(df, status.select(*keep), site)


def enrich_catches(
    catches: DataFrame,
    sites: DataFrame,
    keys: Sequence[str],
    captured: str = "captured_date_raw",
    visit: str = "assessment_date_raw",
    cols: Sequence[str] = ("surface_area_ha",),
    fmt: str = "d MMM yyyy",
    undated_too: bool = False,
) -> DataFrame:
    """Add what the site table recorded on the same visit, a date and a year.

    Two visits on one date give two rows, as they should.  A catch without a date is on no visit, unless ``undated_too``
    lets it meet every visit of its site that has no date either.
    """
    visits = sites.select(*keys, visit, *cols)
    if not undated_too:
        visits = visits.where(F.col(visit).isNotNull())
    pairs: Mapping[str, str] = {**{k: k for k in keys}, captured: visit}
    joined = left_lookup(catches, visits, pairs)
    dated = joined.withColumn("date", to_day(F.col(captured), fmt)).withColumn("year", F.year("date"))
    return relocate(dated, ["date", "year"], after=captured)
