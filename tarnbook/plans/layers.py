"""Site tables and map layers from the survey files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnbook.functions.dates import to_day
from tarnbook.functions.geo import MAP_WINDOW, utm_to_lonlat
from tarnbook.functions.numbers import ddmm_to_degrees, decade, decade_label, to_number, west
from tarnbook.functions.text import area_name_key, title_case
from tarnbook.operators.groups import breaks, distinct_count, group_richness, name_diff, side_by_side, with_level_rank
from tarnbook.operators.joins import apply_crosswalk, decode, left_lookup, lookup
from tarnbook.operators.polygons import located_places, sampled_shapes, spatial_join
from tarnbook.operators.tidy import bbox_filter, explode_codes, lengthen, stack
from tarnbook.plans.status import WATCHED, Focal

# Names of watershed polygons and the names the survey uses for them.
WATERSHED_NAMES = {
    "Barrington Clyde": "Barrington and Clyde",
    "Cheticamp River": "Cheticamp",
    "Clam Hrb St Francis": "Clam Harbour/ St. Francis",
    "Costal Island": "Coastal Island",
    "East Indian River": "East and Indian",
    "East Middle West Pictou": "East, Middle, West (Pictou)",
    "East West Sheet Hbr": "East (Sheet Harbour)",
    "Herring Cove Medway": "Herring Cove and Medway",
    "Kelly Maccan Hebert": "Kelley, Maccan and Hebert",
    "Lahave": "LaHave",
    "New Hbr Salmon": "New Hbr./ Salmon (Guys.)",
    "North Baddeck Middle": "Baddeck and Middle",
    "Philip Wallace": "Philip and Wallace",
    "River Denys Big": "Denys and Big",
    "River Inhabitants": "Inhabitants",
    "River John": "John",
    "Roseway Sable Jordan": "Roseway and Sable and Jordan",
    "Salmon Debert": "Salmon and Debert",
    "Salmon Mira": "Salmon and Mira",
    "Shubenacadie Stewiacke": "Shubenacadie and Stewiacke",
    "Sissiboo Bear": "Sissiboo and Bear",
    "South West": "South and West (Antigonish)",
    "St Croix": "St. Croix",
    "St Marys": "St. Mary's",
    "Tidnish Shinimicas": "Tidnish and Shinimicas",
    "Tusket River": "Tusket",
}
# The one name that is right on the polygons and wrong in the survey.
SURVEY_NAMES = {"Missaguas": "Missaguash"}


def crosswalk_table(spark, names: Mapping[str, str]) -> DataFrame:
    return spark.createDataFrame(list(names.items()), "from_name string, to_name string")


def decimal_sites(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """Sites with packed coordinates turned into decimal degrees, west negative; others are dropped."""
    numbers = df.withColumns({lat: to_number(F.col(lat)), lon: to_number(F.col(lon))}).dropna(subset=[lat, lon])
    return numbers.withColumns(
        {"latitude_dec": ddmm_to_degrees(F.col(lat)), "longitude_dec": west(ddmm_to_degrees(F.col(lon)))}
    )


def long_detections(df: DataFrame, prefix: str = "species", lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """One row per site and species seen, with decimal coordinates."""
    return decimal_sites(lengthen(df, prefix, "species_column", "species_detection"), lat, lon)


def richness_layer(df: DataFrame, loc: Sequence[str], species: str, name: str = "unique_species_count") -> DataFrame:
    """Number of species of its location on every row."""
    return left_lookup(df, group_richness(df, loc, species, name), loc)


def richness_breaks(layer: DataFrame, name: str = "unique_species_count", step: int = 3) -> DataFrame:
    return breaks(layer, name, step)


def focal_layer(df: DataFrame, species: str, focal: Sequence[str] = (WATCHED.a, WATCHED.b), window=None, xy=("longitude_dec", "latitude_dec")) -> DataFrame:
    """Rows of the watched species, inside a map window if one is given."""
    rows = df.where(F.col(species).isin(*focal))
    return bbox_filter(rows, *xy, **window) if window else rows


def first_detection(
    df: DataFrame, site: Sequence[str], species: str, date: str, focal: Sequence[str] = (WATCHED.a, WATCHED.b),
    fmt: str = "d-MMM-yy", bucket: int = 10,
) -> DataFrame:
    """Every detection of a watched species with its own decade, the first year at its site, and that year's decade in order.

    ``date`` is a text to parse, or a date.  ``bucket`` is the width of a "decade" in years.
    """
    rows = df.where(F.col(species).isin(*focal))
    day = to_day(F.col(date), fmt) if dict(df.dtypes)[date] == "string" else F.col(date).cast("date")
    dated = rows.withColumn("day", day).withColumn("year", F.year("day"))
    dated = dated.withColumn("decade", (F.floor(F.col("year") / bucket) * bucket).cast("int"))
    firsts = dated.groupBy(*site, species).agg(F.min("year").alias("first_year"))
    placed = firsts.withColumn("decade_of_first", (F.floor(F.col("first_year") / bucket) * bucket).cast("int"))
    return left_lookup(dated, with_level_rank(placed, "decade_of_first", "decade_rank"), [*site, species])


def locate_in_layer(points: DataFrame, layer: DataFrame, xy=("longitude_dec", "latitude_dec")) -> DataFrame:
    """Detections with the polygon they lie in; those in none are dropped."""
    return spatial_join(points, layer, "inner", xy)


def decode_species(df: DataFrame, codes: str, table: DataFrame, table_code: str = "species_code", common: str = "common_name") -> DataFrame:
    """One row per listed species code, with the species' names in place of the code."""
    decoded = decode(explode_codes(df, codes), codes, table, table_code)
    return decoded.withColumn(common, title_case(F.col(common)))


def shortlist(sites: DataFrame, key: Sequence[str], size: str, limit: float = 100, inclusive: bool = False) -> DataFrame:
    """Distinct sites smaller than ``limit``."""
    small = F.col(size) <= limit if inclusive else F.col(size) < limit
    return sites.where(small).select(*key).distinct()


def coverage_report(layer: DataFrame, points: DataFrame, site: Sequence[str], xy=("x", "y")) -> DataFrame:
    """How many polygons there are, how many hold a point, how many sites there are, how many lie in no polygon.

    A site lies in a polygon if one of its points does.  No row is made for a point and a polygon holding it.
    """
    located = lookup(points, located_places(points, layer, xy), list(xy), "left_semi").select(*site).distinct()
    sampled = sampled_shapes(layer, points, xy)
    measures = [
        ("polygons_total", layer.agg(F.count(F.lit(1)).alias("n"))),
        ("polygons_sampled", sampled.agg(F.count(F.lit(1)).alias("n"))),
        ("sites_total", distinct_count(points, site)),
        ("sites_unlocated", distinct_count(points.select(*site).subtract(located), site)),
    ]
    return stack(*[df.select(F.lit(label).alias("measure"), "n") for label, df in measures])


def decade_layers(
    df: DataFrame, species: str, focal: Sequence[str] = (WATCHED.a, WATCHED.b), year: str = "year",
    xy=("easting", "northing"), zone: int = 20,
) -> DataFrame:
    """Detections of the watched species in longitude and latitude, with their decade and its place in time."""
    lon, lat = utm_to_lonlat(F.col(xy[0]), F.col(xy[1]), zone)
    rows = df.where(F.col(species).isin(*focal)).withColumns(
        {"longitude": lon, "latitude": lat, "decade_num": decade(F.col(year)), "decade": decade_label(F.col(year))}
    )
    return with_level_rank(rows, "decade_num", "decade_rank")


def area_layer(
    areas: DataFrame, status: DataFrame, area_name: str, key: str,
    crosswalk: DataFrame | None = None, status_crosswalk: DataFrame | None = None,
) -> DataFrame:
    """Area polygons with the roll-up of their sites, joined by reconciled name."""
    named = areas.withColumn("area_key", area_name_key(F.col(area_name)))
    if crosswalk is not None:
        named = apply_crosswalk(named, "area_key", crosswalk)
    if status_crosswalk is not None:
        status = apply_crosswalk(status, key, status_crosswalk)
    return left_lookup(named, status, {"area_key": key})


def name_report(areas: DataFrame, status: DataFrame, area_name: str, key: str) -> tuple[DataFrame, DataFrame]:
    """What is left to reconcile: names one side lacks, and both sorted lists next to each other."""
    have = areas.select(area_name_key(F.col(area_name)).alias("area_name"))
    want = status.select(F.col(key).alias("area_name"))
    return name_diff(have, want, "area_name"), side_by_side(have, want, "area_name")


def effort_layer(df: DataFrame, window: Mapping[str, float] | None = MAP_WINDOW, zone: int = 20) -> DataFrame:
    """Resampling effort in longitude and latitude; rows without coordinates are dropped."""
    lon, lat = utm_to_lonlat(F.col("easting"), F.col("northing"), zone)
    placed = df.dropna(subset=["easting", "northing"]).withColumns({"longitude": lon, "latitude": lat})
    return bbox_filter(placed, "longitude", "latitude", **window) if window else placed


def category_layer(df: DataFrame, category: str, x: str, y: str, window: Mapping[str, float] | None = MAP_WINDOW) -> DataFrame:
    """Site points with the category they are coloured by."""
    placed = df.dropna(subset=[x, y]).select(category, x, y)
    return bbox_filter(placed, x, y, **window) if window else placed


def species_layers(df: DataFrame, species: str, focal: Focal = WATCHED) -> dict[str, DataFrame]:
    """One layer per watched species."""
    return {name: df.where(F.col(species) == name) for name in (focal.a, focal.b)}
