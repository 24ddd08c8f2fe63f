"""Coordinates, polygons and map layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnbook.catalog.registry import query
from tarnbook.catalog.roles import (
    CATCHES_SQL, FOCAL, IN_SHAPE_SQL, LAYER_SQL, POINTS_SQL, boundary, catches, layer, points,
)
from tarnbook.catalog.statuses import area_sql, status_ctes, statuses
from tarnbook.functions.geo import lonlat_to_utm, planar_distance, utm_to_lonlat
from tarnbook.functions.text import area_name_key
from tarnbook.operators.groups import mean_point
from tarnbook.operators.points import as_points, reproject
from tarnbook.operators.polygons import clip_to_window, ring_area, spatial_join
from tarnbook.operators.tidy import bbox_filter
from tarnbook.plans.layers import (
    area_layer, category_layer, coverage_report, decade_layers, decimal_sites, effort_layer, focal_layer, locate_in_layer,
    long_detections,
)
from tarnbook.plans.status import area_status
from tarnbook.session import scratch_path
from tarnbook.sources.layers import read_layer

HITS_SQL = f"FROM ({POINTS_SQL}) p JOIN ({LAYER_SQL}) s ON {IN_SHAPE_SQL}"

_LON = "(-66.7 + (x + 1000) / 11000 * 7.2)"
_LAT = "(43.2 + y / 10000 * 3.8)"


def _lonlat(t):
    return points(t).select(
        "point_id", (-66.7 + (F.col("x") + 1000) / 11000 * 7.2).alias("lon"), (43.2 + F.col("y") / 10000 * 3.8).alias("lat")
    )


# The forward projection spelled out once more, from the published series.
UTM_SQL = f"""WITH k AS (SELECT *, 1 / (2 * 298.257222101 - 1) AS n FROM ({POINTS_SQL})),
a AS (SELECT point_id, n, radians({_LAT}) AS phi, radians({_LON} + 63) AS lam, 2 * sqrt(n) / (1 + n) AS e,
  n/2 - 2*n*n/3 + 5*pow(n,3)/16 + 41*pow(n,4)/180 AS a1, 13*n*n/48 - 3*pow(n,3)/5 + 557*pow(n,4)/1440 AS a2,
  61*pow(n,3)/240 - 103*pow(n,4)/140 AS a3, 49561*pow(n,4)/161280 AS a4,
  0.9996 * 6378137 / (1 + n) * (1 + n*n/4 + pow(n,4)/64) AS r FROM k),
b AS (SELECT *, sinh(atanh(sin(phi)) - e * atanh(e * sin(phi))) AS t FROM a),
c AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM b)
SELECT point_id, round(500000 + r * (eta + a1*cos(2*xi)*sinh(2*eta) + a2*cos(4*xi)*sinh(4*eta) + a3*cos(6*xi)*sinh(6*eta) + a4*cos(8*xi)*sinh(8*eta)), 3) AS easting,
  round(r * (xi + a1*sin(2*xi)*cosh(2*eta) + a2*sin(4*xi)*cosh(4*eta) + a3*sin(6*xi)*cosh(6*eta) + a4*sin(8*xi)*cosh(8*eta)), 3) AS northing FROM c"""


@query("utm_forward", UTM_SQL)
def _(t):
    easting, northing = lonlat_to_utm(F.col("lon"), F.col("lat"))
    return _lonlat(t).select("point_id", F.round(easting, 3).alias("easting"), F.round(northing, 3).alias("northing"))


@query("reprojected_points", UTM_SQL)
def _(t):
    metres = reproject(as_points(_lonlat(t), "lon", "lat", 4326), "lon", "lat", 4326, 26920)
    return metres.select("point_id", F.round("lon", 3).alias("easting"), F.round("lat", 3).alias("northing"))


@query("utm_round_trip", f"SELECT point_id, round({_LON}, 6) AS lon, round({_LAT}, 6) AS lat, CAST(0 AS DOUBLE) AS error_mm FROM ({POINTS_SQL})")
def _(t):
    easting, northing = lonlat_to_utm(F.col("lon"), F.col("lat"))
    there = _lonlat(t).withColumns({"e": easting, "n": northing})
    lon, lat = utm_to_lonlat(F.col("e"), F.col("n"))
    back = there.withColumns({"lon2": lon, "lat2": lat})
    e2, n2 = lonlat_to_utm(F.col("lon2"), F.col("lat2"))
    error = F.round(planar_distance(F.col("e"), F.col("n"), e2, n2) * 1000, 1)
    return back.select("point_id", F.round("lon2", 6).alias("lon"), F.round("lat2", 6).alias("lat"), error.alias("error_mm"))


@query("points_in_polygons", f"SELECT point_id, category, x, y, layer_id, layer_name {HITS_SQL}")
def _(t):
    return locate_in_layer(points(t), layer(t), ("x", "y"))


@query("sampled_polygons", f"SELECT DISTINCT layer_id, layer_name {HITS_SQL}")
def _(t):
    return spatial_join(layer(t), points(t), "semi").select("layer_id", "layer_name")


@query("unlocated_sites", f"SELECT * FROM ({POINTS_SQL}) WHERE point_id NOT IN (SELECT point_id {HITS_SQL})")
def _(t):
    return spatial_join(points(t), layer(t), "anti")


@query(
    "coverage_report",
    f"""SELECT 'polygons_total' AS measure, count(*) AS n FROM supplier
UNION ALL SELECT 'polygons_sampled', count(DISTINCT layer_id) {HITS_SQL}
UNION ALL SELECT 'sites_total', count(DISTINCT point_id) FROM ({POINTS_SQL})
UNION ALL SELECT 'sites_unlocated', count(*) FROM ({POINTS_SQL}) WHERE point_id NOT IN (SELECT point_id {HITS_SQL})""",
)
def _(t):
    return coverage_report(layer(t), points(t), ["point_id"])


_OVERLAP = "(bx <= {x2} AND {x1} <= bx + 1200 AND b_y <= {y2} AND {y1} <= b_y + 2000)"
_IN_HOLE = "(holed AND bx > lx + w / 4 AND bx + 1200 < lx + w / 2 AND b_y > ly + h / 4 AND b_y + 2000 < ly + h / 2)"


@query(
    "layer_in_boundary",
    f"""SELECT DISTINCT layer_id, layer_name FROM ({LAYER_SQL})
JOIN (SELECT r_regionkey * 2500 - 1000 AS bx, r_regionkey * 1500 AS b_y FROM region) ON
({_OVERLAP.format(x1='lx', x2='lx + 2 * w', y1='ly', y2='ly + h')} OR {_OVERLAP.format(x1='lx', x2='lx + w', y1='ly', y2='ly + 2 * h')}) AND NOT {_IN_HOLE}""",
)
def _(t):
    return spatial_join(layer(t), boundary(t), "semi").select("layer_id", "layer_name")


_WINDOW = (500.25, 1000.25, 5000.75, 6000.75)


def _cut_sql(x1: str, x2: str, y1: str, y2: str) -> str:
    """Sides of a rectangle's part in the window."""
    a, b, c, d = _WINDOW
    return f"greatest({x1}, {a}), least({x2}, {c}), greatest({y1}, {b}), least({y2}, {d})"


@query(
    "layer_clipped",
    f"""WITH parts AS (
SELECT layer_id, layer_name, 1 AS sign, {_cut_sql('lx', 'lx + 2 * w', 'ly', 'ly + h')} FROM ({LAYER_SQL})
UNION ALL SELECT layer_id, layer_name, 1, {_cut_sql('lx', 'lx + w', 'ly + h', 'ly + 2 * h')} FROM ({LAYER_SQL})
UNION ALL SELECT layer_id, layer_name, -1, {_cut_sql('lx + w / 4', 'lx + w / 2', 'ly + h / 4', 'ly + h / 2')} FROM ({LAYER_SQL}) WHERE holed),
cut(layer_id, layer_name, sign, x1, x2, y1, y2) AS (SELECT * FROM parts)
SELECT layer_id, layer_name, round(sum(sign * (x2 - x1) * (y2 - y1)), 3) AS area, count(*) FILTER (sign < 0) AS n_holes,
  min(x1) AS xmin, min(y1) AS ymin, max(x2) AS xmax, max(y2) AS ymax FROM cut WHERE x1 < x2 AND y1 < y2 GROUP BY ALL""",
)
def _(t):
    clipped = clip_to_window(layer(t), *_WINDOW)
    # The first ring is the outer one, the others are holes.
    areas = F.transform("rings", ring_area)
    area = F.aggregate(areas, F.lit(0.0), lambda a, b: a + b)
    return clipped.select(
        "layer_id", "layer_name", F.round(areas[0] * 2 - area, 3).alias("area"), (F.size("rings") - 1).cast("long").alias("n_holes"), "xmin", "ymin", "xmax", "ymax"
    )


@query(
    "layer_round_trip",
    f"SELECT layer_id, lx AS xmin, ly AS ymin, lx + 2 * w AS xmax, ly + 2 * h AS ymax, 6 + CASE WHEN holed THEN 4 ELSE 0 END AS corners FROM ({LAYER_SQL})",
)
def _(t):
    path = scratch_path(t.spark, "layer")
    # Shapes with heights and measures, as a survey stores them.
    raised = F.transform("rings", lambda ring: F.transform(ring, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.lit(12.5).alias("z"), F.col("layer_id").alias("m"))))
    layer(t).drop("xmin", "ymin", "xmax", "ymax").withColumn("rings", raised).write.parquet(path)
    read = read_layer(t.spark, path)
    return read.select("layer_id", "xmin", "ymin", "xmax", "ymax", F.size(F.flatten("rings")).alias("corners"))


@query("layer_by_attribute", f"SELECT layer_id, layer_name, lx AS xmin, ly AS ymin FROM ({LAYER_SQL}) WHERE layer_name LIKE '%7'")
def _(t):
    return layer(t).where(F.col("layer_name").endswith("7")).select("layer_id", "layer_name", "xmin", "ymin")


@query("bbox_layer", f"SELECT * FROM ({POINTS_SQL}) WHERE x BETWEEN 100 AND 5000.5 AND y BETWEEN 2500 AND 9000")
def _(t):
    return bbox_filter(points(t), "x", "y", 100, 5000.5, 2500, 9000)


@query(
    "category_layer",
    f"SELECT category, x, y FROM ({POINTS_SQL}) WHERE x BETWEEN 0 AND 8000 AND y BETWEEN 0 AND 8000",
)
def _(t):
    return category_layer(points(t), "category", "x", "y", {"xmin": 0, "xmax": 8000, "ymin": 0, "ymax": 8000})


@query("focal_layer", f"SELECT name, species_name, x, y FROM ({CATCHES_SQL}) WHERE species_name IN ('Brand#1', 'Brand#2') AND x BETWEEN 0 AND 5000 AND y BETWEEN 0 AND 5000")
def _(t):
    window = {"xmin": 0, "xmax": 5000, "ymin": 0, "ymax": 5000}
    rows = catches(t).select("name", "species_name", "x", "y")
    return focal_layer(rows, "species_name", (FOCAL.a, FOCAL.b), window, ("x", "y"))


# The way back, likewise.
def _lonlat_ctes(source: str) -> str:
    """WITH clauses up to ``l``: longitude and latitude of the rows (point_id, easting, northing) of a query."""
    return f"""WITH k AS (SELECT *, 1 / (2 * 298.257222101 - 1) AS n FROM ({source})),
a AS (SELECT point_id, easting, northing, n/2 - 2*n*n/3 + 37*pow(n,3)/96 - pow(n,4)/360 AS b1, n*n/48 + pow(n,3)/15 - 437*pow(n,4)/1440 AS b2,
  17*pow(n,3)/480 - 37*pow(n,4)/840 AS b3, 4397*pow(n,4)/161280 AS b4,
  2*n - 2*n*n/3 - 2*pow(n,3) + 116*pow(n,4)/45 AS d1, 7*n*n/3 - 8*pow(n,3)/5 - 227*pow(n,4)/45 AS d2,
  56*pow(n,3)/15 - 136*pow(n,4)/35 AS d3, 4279*pow(n,4)/630 AS d4,
  northing / r AS xi, (easting - 500000) / r AS eta
  FROM (SELECT *, 0.9996 * 6378137 / (1 + n) * (1 + n*n/4 + pow(n,4)/64) AS r FROM k)),
b AS (SELECT *, xi - b1*sin(2*xi)*cosh(2*eta) - b2*sin(4*xi)*cosh(4*eta) - b3*sin(6*xi)*cosh(6*eta) - b4*sin(8*xi)*cosh(8*eta) AS p,
  eta - b1*cos(2*xi)*sinh(2*eta) - b2*cos(4*xi)*sinh(4*eta) - b3*cos(6*xi)*sinh(6*eta) - b4*cos(8*xi)*sinh(8*eta) AS q FROM a),
c AS (SELECT *, asin(sin(p) / cosh(q)) AS chi FROM b),
l AS (SELECT point_id, easting, northing, -63 + degrees(atan2(sinh(q), cos(p))) AS longitude,
  degrees(chi + d1*sin(2*chi) + d2*sin(4*chi) + d3*sin(6*chi) + d4*sin(8*chi)) AS latitude FROM c)"""


LONLAT_SQL = f"""{_lonlat_ctes(f'SELECT point_id, 300000 + x * 30 AS easting, 4800000 + y * 30 AS northing FROM ({POINTS_SQL}) WHERE point_id % 5 <> 0')}
SELECT point_id, round(longitude, 8) AS longitude, round(latitude, 8) AS latitude, CAST(point_id % 9 AS INT) AS resample_count FROM l
WHERE longitude BETWEEN -66.7 AND -63 AND latitude BETWEEN 43.2 AND 45"""


_FOCAL_PLACES = f"""SELECT name, species_name, year, 300000 + x AS easting, 4800000 + y AS northing,
  CAST(floor(year / 10) * 10 AS INT) AS decade_num FROM ({CATCHES_SQL}) WHERE species_name IN ('Brand#1', 'Brand#2')"""


@query(
    "decade_layers",
    f"""{_lonlat_ctes(f'SELECT DISTINCT 0 AS point_id, easting, northing FROM ({_FOCAL_PLACES})')}
SELECT d.*, decade_num || 's' AS decade, dense_rank() OVER (ORDER BY decade_num) AS decade_rank,
  round(longitude, 8) AS longitude, round(latitude, 8) AS latitude
FROM ({_FOCAL_PLACES}) d JOIN l ON d.easting = l.easting AND d.northing = l.northing""",
)
def _(t):
    rows = catches(t).select("name", "species_name", "year", (300000 + F.col("x")).alias("easting"), (4800000 + F.col("y")).alias("northing"))
    placed = decade_layers(rows, "species_name", (FOCAL.a, FOCAL.b))
    return placed.withColumns({c: F.round(c, 8) for c in ("longitude", "latitude")})


@query("mean_points", f"SELECT category, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM ({POINTS_SQL}) GROUP BY 1")
def _(t):
    return mean_point(points(t), ["category"], "x", "y").select("category", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("effort_layer", LONLAT_SQL)
def _(t):
    missing = F.col("point_id") % 5 == 0
    rows = points(t).select(
        "point_id", F.when(~missing, 300000 + F.col("x") * 30).alias("easting"), (4800000 + F.col("y") * 30).alias("northing"),
        (F.col("point_id") % 9).cast("int").alias("resample_count"),
    )
    placed = effort_layer(rows, {"xmin": -66.7, "xmax": -63, "ymin": 43.2, "ymax": 45})
    return placed.select(
        "point_id", F.round("longitude", 8).alias("longitude"), F.round("latitude", 8).alias("latitude"), "resample_count"
    )


@query(
    "decimal_sites",
    """SELECT o_orderkey, lat AS latitude, lon AS longitude, round(floor(lat / 100) + (lat - floor(lat / 100) * 100) / 60, 6) AS latitude_dec,
  round(-(floor(lon / 100) + (lon - floor(lon / 100) * 100) / 60), 6) AS longitude_dec FROM
(SELECT o_orderkey, CAST(4400 + o_orderkey % 60 AS DOUBLE) AS lat, CAST(6300 + o_custkey % 60 AS DOUBLE) AS lon FROM orders WHERE o_orderstatus <> 'P')""",
)
def _(t):
    rows = t.orders.select(
        "o_orderkey", (4400 + F.col("o_orderkey") % 60).cast("string").alias("latitude"),
        F.when(F.col("o_orderstatus") == "P", "n/a").otherwise((6300 + F.col("o_custkey") % 60).cast("string")).alias("longitude"),
    )
    return _rounded(decimal_sites(rows, "latitude", "longitude"))


def _rounded(df):
    return df.withColumns({"latitude_dec": F.round("latitude_dec", 6), "longitude_dec": F.round("longitude_dec", 6)})


@query(
    "long_detections",
    """WITH r AS (SELECT p_partkey, CAST(4400 + p_partkey % 60 AS DOUBLE) AS latitude, CAST(6300 + p_size % 60 AS DOUBLE) AS longitude, p_brand, p_type, p_size FROM part)
SELECT p_partkey, latitude, longitude, species_column, species_detection, round(44 + (p_partkey % 60) / 60, 6) AS latitude_dec,
  round(-(63 + (p_size % 60) / 60), 6) AS longitude_dec
FROM (SELECT *, 'Species1' AS species_column, p_brand AS species_detection FROM r UNION ALL SELECT *, 'Species2', p_type FROM r WHERE p_size % 2 = 0)""",
)
def _(t):
    wide = t.part.select(
        "p_partkey", (4400 + F.col("p_partkey") % 60).cast("string").alias("latitude"), (6300 + F.col("p_size") % 60).cast("string").alias("longitude"),
        F.col("p_brand").alias("Species1"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("").alias("Species2"),
    )
    return _rounded(long_detections(wide))


@query(
    "area_layer",
    status_ctes("v1")
    + f""", rolled AS ({area_sql('primary_watershed', 'ws_status', 'map')}),
areas AS (SELECT DISTINCT c_nationkey, c_mktsegment, o_orderpriority FROM customer JOIN orders ON c_custkey = o_custkey)
SELECT 'NATION ' || c_nationkey || ' & ' || c_mktsegment AS layer_name, o_orderpriority AS part,
  n_name || '-' || c_mktsegment || '-' || o_orderpriority AS area_key, ws_status
FROM areas JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN rolled ON n_name || '-' || c_mktsegment || '-' || o_orderpriority = primary_watershed""",
)
def _(t):
    areas = (
        t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_nationkey", "c_mktsegment", "o_orderpriority", "n_name").distinct()
    )
    named = areas.select(
        F.concat(F.lit("NATION "), F.col("c_nationkey").cast("string"), F.lit(" & "), F.col("c_mktsegment")).alias("layer_name"),
        F.col("o_orderpriority").alias("part"), F.concat_ws("-", "n_name", "c_mktsegment", "o_orderpriority").alias("survey_name"),
    )
    spelled = named.withColumn("spelled", F.concat_ws(" / ", "layer_name", "part"))
    crosswalk = spelled.select(area_name_key(F.col("spelled")).alias("from_name"), F.col("survey_name").alias("to_name"))
    rolled = area_status(statuses(t, "v1"), "primary_watershed", "map", FOCAL, "ws_status")
    joined = area_layer(spelled.drop("survey_name"), rolled, "spelled", "primary_watershed", crosswalk)
    return joined.drop("spelled")
