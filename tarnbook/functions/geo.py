"""Coordinates: planar distance, and the Krüger series between longitude/latitude and UTM metres."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# GRS80 ellipsoid and the UTM projection.
SEMI_MAJOR_AXIS_M = 6378137.0
INVERSE_FLATTENING = 298.257222101
UTM_SCALE = 0.9996
UTM_FALSE_EASTING_M = 500000.0

# The map window used for province-wide layers (degrees).
MAP_WINDOW = {"xmin": -66.7, "xmax": -59.5, "ymin": 43.2, "ymax": 47.0}

_N = 1 / (2 * INVERSE_FLATTENING - 1)  # third flattening
_RECTIFYING_RADIUS = SEMI_MAJOR_AXIS_M / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)

# Series coefficients in powers n, n^2, n^3, n^4 of the third flattening.
_ALPHA_POWERS = [
    (1 / 2, -2 / 3, 5 / 16, 41 / 180),
    (0, 13 / 48, -3 / 5, 557 / 1440),
    (0, 0, 61 / 240, -103 / 140),
    (0, 0, 0, 49561 / 161280),
]
_BETA_POWERS = [
    (1 / 2, -2 / 3, 37 / 96, -1 / 360),
    (0, 1 / 48, 1 / 15, -437 / 1440),
    (0, 0, 17 / 480, -37 / 840),
    (0, 0, 0, 4397 / 161280),
]
_DELTA_POWERS = [
    (2, -2 / 3, -2, 116 / 45),
    (0, 7 / 3, -8 / 5, -227 / 45),
    (0, 0, 56 / 15, -136 / 35),
    (0, 0, 0, 4279 / 630),
]


def _series(powers):
    return [sum(c * _N ** (i + 1) for i, c in enumerate(row)) for row in powers]


ALPHA, BETA, DELTA = _series(_ALPHA_POWERS), _series(_BETA_POWERS), _series(_DELTA_POWERS)


def central_meridian(zone: int) -> float:
    return zone * 6.0 - 183.0


def _sum(terms):
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def lonlat_to_utm(lon: Column, lat: Column, zone: int = 20) -> tuple[Column, Column]:
    """Easting and northing (metres, northern hemisphere) of a point in degrees."""
    phi = F.radians(lat)
    lam = F.radians(lon - central_meridian(zone))
    root = 2 * math.sqrt(_N) / (1 + _N)
    sin_phi = F.sin(phi)
    t = F.sinh(F.atanh(sin_phi) - root * F.atanh(root * sin_phi))
    xi = F.atan2(t, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    scale = UTM_SCALE * _RECTIFYING_RADIUS
    easting = eta + _sum([a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(ALPHA, 1)])
    northing = xi + _sum([a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(ALPHA, 1)])
    return UTM_FALSE_EASTING_M + scale * easting, scale * northing


def utm_to_lonlat(easting: Column, northing: Column, zone: int = 20) -> tuple[Column, Column]:
    """Longitude and latitude (degrees) of a point in UTM metres, northern hemisphere."""
    scale = UTM_SCALE * _RECTIFYING_RADIUS
    xi = northing / scale
    eta = (easting - UTM_FALSE_EASTING_M) / scale
    xi0 = xi - _sum([b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(BETA, 1)])
    eta0 = eta - _sum([b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(BETA, 1)])
    chi = F.asin(F.sin(xi0) / F.cosh(eta0))
    lat = chi + _sum([d * F.sin(2 * j * chi) for j, d in enumerate(DELTA, 1)])
    lon = F.atan2(F.sinh(eta0), F.cos(xi0))
    return central_meridian(zone) + F.degrees(lon), F.degrees(lat)


def planar_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x1 - x2, y1 - y2
    return F.sqrt(dx * dx + dy * dy)


# Fixed values: (largest distance in metres, relation of the counties, band); the first hit wins.
MATCH_BANDS = (
    (200, "same", "confident"),
    (300, "missing", "review_missing_county"),
    (200, "different", "review_county_mismatch"),
    (500, "same", "review_possible_match"),
)
LAST_BAND = "unlikely"


def county_relation(own: Column, other: Column) -> Column:
    """``missing`` without an own county, else ``same`` or ``different``."""
    return (
        F.when(F.coalesce(F.trim(own), F.lit("")) == "", "missing").when(own == other, "same").otherwise("different")
    )


def match_band(distance: Column, relation: Column, bands=MATCH_BANDS, last: str = LAST_BAND) -> Column:
    """How far a nearest-site match can be trusted, from its distance and the counties' relation."""
    band = None
    for limit, wanted, label in bands:
        hit = (distance <= limit) & (relation == wanted)
        band = F.when(hit, label) if band is None else band.when(hit, label)
    return band.otherwise(last)
