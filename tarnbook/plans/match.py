"""Matching the records of a second database to sites, by name, by distance, and with a person's help.

Records have ``record_id, species_name, name, county, year`` and plane coordinates; sites have a unique
``site_id``, their identity columns and plane coordinates.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnbook.functions.geo import county_relation, lonlat_to_utm, match_band, utm_to_lonlat
from tarnbook.functions.numbers import to_number
from tarnbook.functions.text import paste, site_name_key, title_case
from tarnbook.operators.groups import top_row, with_record_id
from tarnbook.operators.names import name_match
from tarnbook.operators.nearest import nearest_join
from tarnbook.operators.review import apply_decisions, apply_overrides, automatic_decisions
from tarnbook.operators.tidy import blank_to_null, stack
from tarnbook.plans.status import WATCHED
from tarnbook.session import cut_lineage
from tarnbook.sources.schemas import OVERRIDES

# A nearest site farther away than this is no match (metres).
TOLERANCE_M = 200.0

SITE_COLUMNS = ("county", "site_code", "name", "primary_watershed", "watershed_code")

# Confident matches a person found wrong.
FALSE_MATCHES = (("BANOOK", "MORRIS"), ("LITTLE CHEZETCOOK FIRE HALL", "LITTLE"))
FALSE_MATCH_STATUS = "review_name_mismatch"


def site_column(c: str) -> str:
    """Name of a site's column on a record: ``name`` is ``site_name``, ``site_code`` stays."""
    return c if c.startswith("site_") else f"site_{c}"


def overrides_table(spark) -> DataFrame:
    """The listed false matches as an override table."""
    rows = [(record, site, FALSE_MATCH_STATUS) for record, site in FALSE_MATCHES]
    return spark.createDataFrame(rows, OVERRIDES)


def prepare_records(
    utm: DataFrame,
    lonlat: DataFrame,
    province: str = "NS",
    species=(WATCHED.b, WATCHED.a),
    zone: int = 20,
    clean: Callable[[Column], Column] = site_name_key,
) -> DataFrame:
    """Bring the two parts of the second database to one shape.

    Ids are made from the columns as they were read, before anything is computed, so that they are the same on every
    machine and a review finds its records again.  ``clean`` brings names to the form they are compared in: the key of a
    site's name, or ``F.upper`` as earlier policies did.
    """
    lon, lat = utm_to_lonlat(F.col("easting"), F.col("northing"), zone)
    utm, lonlat = with_record_id(utm.where(F.col("province") == province)), with_record_id(lonlat)
    first = utm.select(
        "record_id", F.lit(species[0]).alias("species_name"), clean(F.col("location")).alias("name"),
        title_case(F.col("country")).alias("county"), to_number(F.col("year")).cast("int").alias("year"),
        lon.alias("lon"), lat.alias("lat"), "easting", "northing",
    )
    easting, northing = lonlat_to_utm(F.col("lon"), F.col("lat"), zone)
    second = lonlat.select(
        "record_id", F.lit(species[1]).alias("species_name"), clean(F.col("system")).alias("name"),
        title_case(F.col("county")).alias("county"), to_number(F.col("year")).cast("int").alias("year"),
        "lon", "lat", easting.alias("easting"), northing.alias("northing"),
    )
    return blank_to_null(stack(first, second), ["county"])


def match(
    records: DataFrame,
    sites: DataFrame,
    policy: str = "distance_county",
    xy: tuple[str, str] = ("easting", "northing"),
    site_columns: Sequence[str] = SITE_COLUMNS,
    decisions: DataFrame | None = None,
    overrides: DataFrame | None = None,
    tolerance_m: float = TOLERANCE_M,
    regex: bool = False,
) -> DataFrame:
    """Records with the columns of their site, named ``site_…``.

    * ``name_all``: every site of the same county with a fitting name; without one, the nearest within the tolerance
    * ``name_best``: likewise, but only the best name
    * ``distance_county``: every record with its nearest site, a band saying how sure that is, and decisions
    """
    targets = sites.select("site_id", *[F.col(c).alias(site_column(c)) for c in site_columns], *xy)
    if policy == "distance_county":
        return settle_matches(match_by_distance(records, targets, xy), overrides, decisions, site_columns)
    named = cut_lineage(name_match(
        records, targets, "record_id", "site_id", ("county", "site_county"), ("name", "site_name"),
        {"name_all": "all", "name_best": "best"}[policy], regex,
    ))
    by_name = records.join(named, "record_id").withColumn("matched_by", F.lit("name"))
    rest = cut_lineage(left_unmatched(records, named))
    by_place = nearest_join(rest, targets.select("site_id", *xy), "site_id", xy, max_distance_m=tolerance_m, how="inner")
    # The sites' columns are joined once to both, since there are far more sites than records.
    found = stack(by_name, by_place.withColumn("matched_by", F.lit("distance"))).join(targets.drop(*xy), "site_id")
    told = [c for c in targets.columns if c not in ("site_id", *xy)]
    return found.select("site_id", "record_id", *[c for c in records.columns if c != "record_id"], *told, "matched_by", "distance_m")


def left_unmatched(records: DataFrame, named: DataFrame) -> DataFrame:
    """Records without a name match, told by their id."""
    return records.join(named.select("record_id").distinct(), "record_id", "left_anti")


def match_by_distance(records: DataFrame, targets: DataFrame, xy: tuple[str, str]) -> DataFrame:
    """Every record with its nearest site, a band, and the automatic decisions.

    This is where the first job ends: store it, send its review queue to a person, and settle it later.
    """
    near = nearest_join(records, targets, "site_id", xy)
    relation = county_relation(F.col("county"), F.col("site_county"))
    banded = near.withColumn("county_match", relation).withColumn(
        "match_status", match_band(F.col("distance_m"), F.col("county_match"))
    )
    return automatic_decisions(banded)


def settle_matches(
    matched: DataFrame,
    overrides: DataFrame | None = None,
    decisions: DataFrame | None = None,
    site_columns: Sequence[str] = SITE_COLUMNS,
) -> DataFrame:
    """Undo confident matches listed as false, then enter a person's decisions."""
    if overrides is not None:
        listed = overrides.select(
            "record_name", F.col("site_name").alias("wrong_site"), F.lit("confident").alias("band"), "new_status",
            F.lit("not_a_match").alias("decision"),
        )
        matched = apply_overrides(
            matched,
            listed,
            {"name": "record_name", "site_name": "wrong_site", "match_status": "band"},
            ["site_id", *[site_column(c) for c in site_columns]],
            {"match_status": "new_status", "match_decision": "decision", "match_status_confirmed": "decision"},
        )
    return matched if decisions is None else apply_decisions(matched, decisions)


def dedupe_records(df: DataFrame, keep: str = "latest") -> DataFrame:
    """One record per true identity and species: the latest (or ``earliest``) year, undated ones last."""
    confirmed = F.coalesce(F.col("match_status_confirmed") == "match", F.lit(False))
    identity = F.when(confirmed, F.col("site_name")).otherwise(paste(F.col("name"), F.col("county"), sep="_"))
    year = F.desc_nulls_last("year") if keep == "latest" else F.asc_nulls_last("year")
    keyed = df.withColumn("__identity", identity)
    return top_row(keyed, ["__identity", "species_name"], [year, "record_id"]).drop("__identity")


def resolve_identity(records: DataFrame, database: str = "records", site_columns: Sequence[str] = SITE_COLUMNS) -> DataFrame:
    """The site's identity for confirmed matches, the record's own name and county for all others.

    Unconfirmed records carry no other site column: a nearest site that is no match says nothing about them.
    """
    confirmed = F.coalesce(F.col("match_status_confirmed") == "match", F.lit(False))

    def final(c: str):
        site = F.when(confirmed, F.col(site_column(c)))
        return (site.otherwise(F.col(c)) if c in ("name", "county") else site).alias(c)

    others = [c for c in ("easting", "northing", "lon", "lat", "x", "y") if c in records.columns]
    return records.select(
        *[final(c) for c in site_columns], "species_name", "year", F.lit(database).alias("database"), "record_id", *others
    )


def matched_detections(matched: DataFrame, database: str = "records", site_columns: Sequence[str] = SITE_COLUMNS) -> DataFrame:
    """Matched records as detections at their site; they keep their own place."""
    others = [c for c in ("easting", "northing", "lon", "lat", "x", "y") if c in matched.columns]
    return matched.select(
        *[F.col(site_column(c)).alias(c) for c in site_columns],
        "species_name", "year", F.lit(database).alias("database"), "record_id", *others,
    )


def with_records(main: DataFrame, records: DataFrame, site_columns: Sequence[str] = SITE_COLUMNS) -> DataFrame:
    """Detections of both databases in one table."""
    cols = [*site_columns, "species_name", "year", "database"]
    return main.select(*cols).unionByName(records.select(*cols))


