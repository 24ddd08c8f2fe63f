"""The given tables in the roles of a survey, as DataFrames and as SQL.

An order is a visit to a site, its lines are the catches, a part's brand is the species.  A site is a customer
and an order priority; its watershed is nation, market segment and priority; its county is the region.
Suppliers are the records of a second database, and the polygons.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnbook.catalog.registry import Tables
from tarnbook.plans.status import Focal

FOCAL = Focal("Brand#1", "Brand#2", "B1", "B2")
SITE = ["county", "site_code", "name", "primary_watershed"]
SITE_COLUMNS = [*SITE, "watershed_code"]
DATABASES = ("main", "records")


def _place_y(key: str):
    return (F.col(key) * 7919 % 10000).cast("double")


def sites(t: Tables) -> DataFrame:
    """One row per visit."""
    digit = F.substr("o_orderpriority", F.lit(1), F.lit(1)).cast("int")
    return (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("o_orderkey").alias("site_id"),
            F.col("r_name").alias("county"),
            F.col("c_custkey").alias("site_code"),
            F.concat_ws(" ", "c_name", "o_orderpriority").alias("name"),
            F.concat_ws("-", "n_name", "c_mktsegment", "o_orderpriority").alias("primary_watershed"),
            F.col("n_name").alias("watershed_code"),
            F.date_format("o_orderdate", "d MMM yyyy").alias("assessment_date_raw"),
            F.year("o_orderdate").alias("visit_year"),
            F.col("o_totalprice").alias("surface_area_ha"),
            F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("volume_m3"),
            F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey") % 97).alias("max_depth_m"),
            F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey") % 31).alias("mean_depth_m"),
            F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice") / 2).alias("area_under_6m_ha"),
            F.when(F.col("o_orderkey") % 6 != 0, F.col("o_custkey") % 13).alias("shoreline_dev"),
            (F.col("c_acctbal") + (digit * 3 + F.col("o_orderkey") % 2)).alias("x"),
            (_place_y("c_custkey") + digit * 5).alias("y"),
        )
    )


SITES_SQL = """
SELECT o_orderkey AS site_id, r_name AS county, c_custkey AS site_code, c_name || ' ' || o_orderpriority AS name,
       n_name || '-' || c_mktsegment || '-' || o_orderpriority AS primary_watershed, n_name AS watershed_code,
       strftime(o_orderdate, '%-d %b %Y') AS assessment_date_raw, year(o_orderdate) AS visit_year,
       o_totalprice AS surface_area_ha,
       CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS volume_m3,
       CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey % 97 END AS max_depth_m,
       CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey % 31 END AS mean_depth_m,
       CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice / 2 END AS area_under_6m_ha,
       CASE WHEN o_orderkey % 6 <> 0 THEN o_custkey % 13 END AS shoreline_dev,
       c_acctbal + (CAST(substr(o_orderpriority, 1, 1) AS INT) * 3 + o_orderkey % 2) AS x,
       CAST(c_custkey * 7919 % 10000 AS DOUBLE) + CAST(substr(o_orderpriority, 1, 1) AS INT) * 5 AS y
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey"""


def catches(t: Tables, visits: DataFrame | None = None) -> DataFrame:
    """One row per order line; ``visits`` are the sites, if these are stored already."""
    visits = sites(t) if visits is None else visits
    # Ids are put together after the join: as numbers they take less room in a shuffle.
    numbers = ("l_linenumber", "l_partkey", "l_suppkey")
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", F.col("p_brand").alias("species_name"), *numbers)
    return visits.join(lines, F.col("site_id") == F.col("l_orderkey")).select(
        *SITE_COLUMNS, "species_name", F.col("assessment_date_raw").alias("captured_date_raw"),
        F.col("visit_year").alias("year"), F.lit("main").alias("database"), "x", "y",
        F.concat_ws("-", "l_orderkey", F.concat_ws("-", *numbers)).alias("row_id"),
    )


CATCHES_SQL = f"""
SELECT county, site_code, name, primary_watershed, watershed_code, p_brand AS species_name,
       assessment_date_raw AS captured_date_raw, visit_year AS year, 'main' AS database, x, y,
       l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS row_id
FROM ({SITES_SQL}) JOIN lineitem ON site_id = l_orderkey JOIN part ON l_partkey = p_partkey"""


def records(t: Tables) -> DataFrame:
    """The second database: a third of the names are longer than a site's, a third shorter, a third fit none."""
    key = F.col("s_suppkey")
    number = F.lpad((key * 10).cast("string"), 9, "0")
    return (
        t.supplier.join(t.customer, key * 10 == F.col("c_custkey"), "left")
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .select(
            key.alias("record_id"),
            F.when(key % 2 == 0, FOCAL.a).otherwise(FOCAL.b).alias("species_name"),
            F.when(key % 3 == 0, F.concat(F.lit("Customer#"), number, F.lit(" 2-HIGH NORTH ARM")))
            .when(key % 6 == 1, F.concat(F.lit("customer#"), F.substr(number, F.lit(1), F.lit(8))))
            .when(key % 6 == 4, F.concat(F.lit("CUSTOMER#"), number, F.lit(" 3-MEDIUM")))
            .otherwise(F.concat(F.lit("Unnamed "), key.cast("string"))).alias("name"),
            F.when(key % 7 != 0, F.col("r_name")).alias("county"),
            F.when(key % 11 != 0, (1990 + key % 12).cast("int")).alias("year"),
            F.col("s_acctbal").alias("x"), _place_y("s_suppkey").alias("y"),
        )
    )


RECORDS_SQL = """
SELECT s_suppkey AS record_id, CASE WHEN s_suppkey % 2 = 0 THEN 'Brand#1' ELSE 'Brand#2' END AS species_name,
       CASE WHEN s_suppkey % 3 = 0 THEN 'Customer#' || lpad(CAST(s_suppkey * 10 AS VARCHAR), 9, '0') || ' 2-HIGH NORTH ARM'
            WHEN s_suppkey % 6 = 1 THEN 'customer#' || substr(lpad(CAST(s_suppkey * 10 AS VARCHAR), 9, '0'), 1, 8)
            WHEN s_suppkey % 6 = 4 THEN 'CUSTOMER#' || lpad(CAST(s_suppkey * 10 AS VARCHAR), 9, '0') || ' 3-MEDIUM'
            ELSE 'Unnamed ' || s_suppkey END AS name,
       CASE WHEN s_suppkey % 7 <> 0 THEN r_name END AS county,
       CASE WHEN s_suppkey % 11 <> 0 THEN 1990 + s_suppkey % 12 END AS year,
       s_acctbal AS x, CAST(s_suppkey * 7919 % 10000 AS DOUBLE) AS y
FROM supplier LEFT JOIN customer ON s_suppkey * 10 = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey"""


def points(t: Tables) -> DataFrame:
    """Customers as points in the plane."""
    return t.customer.select(
        F.col("c_custkey").alias("point_id"), F.col("c_mktsegment").alias("category"),
        F.col("c_acctbal").alias("x"), _place_y("c_custkey").alias("y"),
    )


POINTS_SQL = """
SELECT c_custkey AS point_id, c_mktsegment AS category, c_acctbal AS x, CAST(c_custkey * 7919 % 10000 AS DOUBLE) AS y
FROM customer"""


def _ring(*corners):
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in corners])


def layer(t: Tables) -> DataFrame:
    """An L-shaped polygon per supplier; every third has a hole."""
    k, x, y = F.col("s_suppkey"), F.col("s_acctbal"), _place_y("s_suppkey")
    w, h = 200 + k % 7 * 60, 150 + k % 5 * 70
    outer = _ring((x, y), (x + 2 * w, y), (x + 2 * w, y + h), (x + w, y + h), (x + w, y + 2 * h), (x, y + 2 * h))
    x1, x2, y1, y2 = x + w / 4, x + w / 2, y + h / 4, y + h / 2
    hole = _ring((x1, y1), (x1, y2), (x2, y2), (x2, y1))
    return t.supplier.select(
        k.alias("layer_id"), F.col("s_name").alias("layer_name"),
        F.when(k % 3 == 0, F.array(outer, hole)).otherwise(F.array(outer)).alias("rings"),
        x.alias("xmin"), y.alias("ymin"), (x + 2 * w).alias("xmax"), (y + 2 * h).alias("ymax"),
    )


LAYER_SQL = """
SELECT s_suppkey AS layer_id, s_name AS layer_name, s_acctbal AS lx, CAST(s_suppkey * 7919 % 10000 AS DOUBLE) AS ly,
       200 + s_suppkey % 7 * 60 AS w, 150 + s_suppkey % 5 * 70 AS h, s_suppkey % 3 = 0 AS holed FROM supplier"""

IN_SHAPE_SQL = """
((x BETWEEN lx AND lx + 2 * w AND y BETWEEN ly AND ly + h) OR (x BETWEEN lx AND lx + w AND y BETWEEN ly AND ly + 2 * h))
AND NOT (holed AND x > lx + w / 4 AND x < lx + w / 2 AND y > ly + h / 4 AND y < ly + h / 2)"""


def boundary(t: Tables) -> DataFrame:
    """A rectangle per region."""
    r = F.col("r_regionkey")
    x, y = (r * 2500 - 1000).cast("double"), (r * 1500).cast("double")
    return t.region.select(
        F.concat(F.lit("region-"), r.cast("string")).alias("layer_id"),
        F.array(_ring((x, y), (x + 1200, y), (x + 1200, y + 2000), (x, y + 2000))).alias("rings"),
        x.alias("xmin"), y.alias("ymin"), (x + 1200).alias("xmax"), (y + 2000).alias("ymax"),
    )
