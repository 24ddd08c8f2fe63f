"""Point tables: two double columns that know their coordinate system."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnbook.functions.geo import lonlat_to_utm, utm_to_lonlat
from tarnbook.functions.numbers import to_number

# Codes of the coordinate systems in use.  The geographic ones (WGS84, NAD83 and its Canadian
# realisation) are treated as equal, which is right within 1 to 2 metres.
GEOGRAPHIC = (4326, 4269, 4617)
UTM_ZONES = {26919: 19, 26920: 20, 26921: 21, 32619: 19, 32620: 20, 32621: 21, 2961: 20}


def as_points(df: DataFrame, x: str, y: str, crs: int) -> DataFrame:
    """Make two columns a point: doubles, tagged with the coordinate system; rows without a place are dropped."""
    _check(crs)
    tagged = {c: to_number(F.col(c)) for c in (x, y)}
    placed = df.withColumns(tagged).dropna(subset=[x, y])
    return placed.withMetadata(x, {"crs": crs, "axis": "x"}).withMetadata(y, {"crs": crs, "axis": "y"})


def crs_of(df: DataFrame, x: str) -> int | None:
    return df.schema[x].metadata.get("crs")


def reproject(df: DataFrame, x: str, y: str, source: int | None = None, target: int = 4326) -> DataFrame:
    """Bring a point table to another coordinate system, in place; ``source`` defaults to the points' tag."""
    source = source or crs_of(df, x)
    if source is None:
        raise ValueError(f"{x} has no coordinate system")
    _check(source)
    _check(target)
    px, py = F.col(x), F.col(y)
    if source in UTM_ZONES and UTM_ZONES[source] != UTM_ZONES.get(target):
        px, py = utm_to_lonlat(px, py, UTM_ZONES[source])
    if target in UTM_ZONES and UTM_ZONES[target] != UTM_ZONES.get(source):
        px, py = lonlat_to_utm(px, py, UTM_ZONES[target])
    moved = df.withColumns({x: px, y: py})
    return moved.withMetadata(x, {"crs": target, "axis": "x"}).withMetadata(y, {"crs": target, "axis": "y"})


def _check(crs: int) -> None:
    if crs not in GEOGRAPHIC and crs not in UTM_ZONES:
        raise ValueError(f"unknown coordinate system {crs}")
