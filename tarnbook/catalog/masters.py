"""Master tables and the map document."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnbook.catalog.matching import NAME_CTES, NEAREST_REST_SQL, READY_CTES, XY, ready, targets
from tarnbook.catalog.registry import query
from tarnbook.catalog.roles import CATCHES_SQL, DATABASES, FOCAL, SITE, SITE_COLUMNS, catches, records, sites
from tarnbook.catalog.statuses import area_sql, status_ctes
from tarnbook.plans.master import (
    MORPHOLOGY, STATUS, community_list, nested_export, site_coordinates, site_master, site_morphology, site_species_year, write_nested_export,
)
from tarnbook.plans.match import match, matched_detections, with_records
from tarnbook.plans.status import area_status, enrich_catches, site_status
from tarnbook.session import bounded_tasks, cut_lineage, scratch_path
from tarnbook.sources.kml import FOOTER, HEADER, INNER_CLOSE, INNER_OPEN, OUTER_CLOSE, OUTER_OPEN, TITLE

_MEASURES = ", ".join(f"arg_min({c}, site_id) FILTER ({c} IS NOT NULL) AS {c}" for c in MORPHOLOGY)
SITE_SQL = ", ".join(SITE)
SAME_SITE = " AND ".join(f"{{a}}.{c} IS NOT DISTINCT FROM {{b}}.{c}" for c in SITE)


def _all_detections(rows, second):
    return with_records(rows, second, SITE_COLUMNS)


# What a master is made from: neither dates as text nor the ids of lines, which are the widest columns.
_VISIT = ["site_id", *SITE, *XY, *MORPHOLOGY]
_CATCH = [*SITE_COLUMNS, "species_name", "year", "database", *XY]


def _stored(t, visit, catch):
    """Visits and catches with the columns some use reads, put together once; each of several uses then reads its own."""
    return cut_lineage(sites(t).select(*visit)), cut_lineage(catches(t).select(*catch))


def _master(t, second, stored=None):
    visits, rows = stored or _stored(t, _VISIT, _CATCH)
    master = site_master(_all_detections(rows, second), visits, rows, second, SITE, XY, MORPHOLOGY, FOCAL, "v3", DATABASES)
    return master.withColumns({c: F.round(c, 6) for c in XY})


_SOURCE = """, CASE WHEN bool_or(database = 'main') AND bool_or(database = 'records') THEN 'Both' WHEN bool_or(database = 'main') THEN 'main Only' ELSE 'records Only' END AS data_source"""

# Everything up to the status of each site, over both databases.
_DETECTIONS = f"""SELECT {SITE_SQL}, species_name, year, database FROM all_catches
  UNION ALL SELECT {SITE_SQL}, species_name, year, database FROM ready"""

MASTER_CTES = (
    READY_CTES
    + f",\nall_catches AS ({CATCHES_SQL}),\n"
    + status_ctes("v3", _DETECTIONS, _SOURCE).removeprefix("WITH ")
    + f""",
ws AS ({area_sql('primary_watershed', 'ws_status')}), counties AS ({area_sql('county', 'county_status')}),
places AS (SELECT {SITE_SQL}, avg(x) AS x, avg(y) AS y FROM (SELECT DISTINCT {SITE_SQL}, x, y FROM sites) GROUP BY ALL),
fallback AS (SELECT * FROM ready QUALIFY row_number() OVER (PARTITION BY {SITE_SQL} ORDER BY record_id) = 1),
shape AS (SELECT {SITE_SQL}, {_MEASURES} FROM sites GROUP BY ALL),
master AS (SELECT s.*, round(coalesce(p.x, f.x), 6) AS x, round(coalesce(p.y, f.y), 6) AS y, ws_status, county_status, {', '.join(MORPHOLOGY)}
  FROM status s LEFT JOIN places p ON {SAME_SITE.format(a='s', b='p')} LEFT JOIN fallback f ON {SAME_SITE.format(a='s', b='f')}
  LEFT JOIN shape h ON {SAME_SITE.format(a='s', b='h')}
  LEFT JOIN ws ON s.primary_watershed IS NOT DISTINCT FROM ws.primary_watershed
  LEFT JOIN counties c ON s.county IS NOT DISTINCT FROM c.county)"""
)

_MASTER = f"{SITE_SQL}, last_sampled_year, first_a, first_b, data_source, ws_first_a, ws_first_b, absence_a_believable, absence_b_believable, status_a, status_b, site_status, x, y, ws_status, county_status, {', '.join(MORPHOLOGY)}"


@query("site_master", MASTER_CTES + f" SELECT {_MASTER} FROM master")
def _(t):
    return _master(t, cut_lineage(ready(t))).select(*_MASTER.split(", "))


@query("site_coordinates", f"{MASTER_CTES} SELECT {SITE_SQL}, round(x, 6) AS x, round(y, 6) AS y FROM (SELECT * FROM places UNION ALL SELECT {SITE_SQL}, x, y FROM fallback f WHERE NOT EXISTS (SELECT 1 FROM places p WHERE {SAME_SITE.format(a='f', b='p')}))")
def _(t):
    bounded_tasks(t.spark)
    found = site_coordinates(sites(t), catches(t), ready(t), SITE, XY)
    return found.withColumns({c: F.round(c, 6) for c in XY})


@query(
    "site_morphology",
    f"{READY_CTES} SELECT {SITE_SQL}, {_MEASURES} FROM sites GROUP BY ALL",
)
def _(t):
    return site_morphology(sites(t), MORPHOLOGY, SITE)


_COMMUNITY = f"{SITE_SQL}, watershed_code, species_name, year, database, captured_date_raw, date, visit_area_ha, {', '.join((*STATUS, *MORPHOLOGY))}"


@query(
    "community_list",
    f"""{MASTER_CTES} SELECT c.county, c.site_code, c.name, c.primary_watershed, c.watershed_code, c.species_name, c.year, c.database, c.captured_date_raw,
  strftime(strptime(captured_date_raw, '%-d %b %Y'), '%Y-%m-%d') AS date, v.visit_area_ha, {', '.join('m.' + c for c in (*STATUS, *MORPHOLOGY))}
FROM all_catches c LEFT JOIN (SELECT {SITE_SQL}, watershed_code, assessment_date_raw, surface_area_ha AS visit_area_ha FROM sites) v
  ON {SAME_SITE.format(a='c', b='v')} AND c.watershed_code IS NOT DISTINCT FROM v.watershed_code AND captured_date_raw = assessment_date_raw
LEFT JOIN master m ON {SAME_SITE.format(a='c', b='m')}
UNION ALL SELECT {SITE_SQL}, watershed_code, species_name, year, database, NULL, year || '-01-01', NULL, {', '.join('NULL' for _ in (*STATUS, *MORPHOLOGY))} FROM ready""",
)
def _(t):
    second = cut_lineage(ready(t))
    stored = _stored(t, [*_VISIT, "watershed_code", "assessment_date_raw"], [*_CATCH, "captured_date_raw"])
    visits = stored[0].withColumnRenamed("surface_area_ha", "visit_area_ha")
    enriched = enrich_catches(stored[1].drop(*XY), visits, SITE_COLUMNS, cols=("visit_area_ha",))
    listed = community_list(enriched, cut_lineage(_master(t, second, stored)), second.drop(*XY), SITE)
    return listed.withColumn("date", F.col("date").cast("string")).select(*_COMMUNITY.split(", "))


_YEARLY = f"{SITE_SQL}, species_name, year, database, x, y, watershed_code, captured_date_raw, status_a, status_b, site_status, ws_status, county_status"

YEARLY_SQL = (
    NAME_CTES
    + f""", {NEAREST_REST_SQL},
pairs AS (SELECT record_id, site_id FROM hits UNION ALL SELECT record_id, site_id FROM close WHERE distance_m <= 200),
matched AS (SELECT s.county, s.site_code, s.name, s.primary_watershed, s.watershed_code, species_name, year, 'records' AS database, r.x, r.y, CAST(r.record_id AS VARCHAR) AS row_id
  FROM pairs JOIN records r ON pairs.record_id = r.record_id JOIN sites s ON pairs.site_id = s.site_id),
all_catches AS ({CATCHES_SQL}),
"""
    + status_ctes(
        "v2", f"SELECT {SITE_SQL}, species_name, year, database FROM all_catches UNION ALL SELECT {SITE_SQL}, species_name, year, database FROM matched"
    ).removeprefix("WITH ")
    + f""",
ws AS ({area_sql('primary_watershed', 'ws_status')}), counties AS ({area_sql('county', 'county_status')}),
place AS (SELECT {SITE_SQL}, arg_min(x, site_id) AS x, arg_min(y, site_id) AS y FROM sites GROUP BY ALL),
stacked AS (SELECT c.county, c.site_code, c.name, c.primary_watershed, c.watershed_code, species_name, year, database, p.x, p.y, captured_date_raw, 0 AS o, row_id
    FROM all_catches c LEFT JOIN place p ON {SAME_SITE.format(a='c', b='p')}
  UNION ALL SELECT {SITE_SQL}, watershed_code, species_name, year, database, x, y, NULL, 1, row_id FROM matched),
grouped AS (SELECT {SITE_SQL}, species_name, year, string_agg(DISTINCT database, '+' ORDER BY database) AS databases FROM stacked GROUP BY ALL),
firsts AS (SELECT * FROM stacked QUALIFY row_number() OVER (PARTITION BY {SITE_SQL}, species_name, year ORDER BY o, row_id) = 1)
SELECT g.county, g.site_code, g.name, g.primary_watershed, g.species_name, g.year, databases AS database, x, y, watershed_code, captured_date_raw,
  status_a, status_b, site_status, ws_status, county_status
FROM grouped g JOIN firsts f ON {SAME_SITE.format(a='g', b='f')} AND g.species_name = f.species_name AND g.year IS NOT DISTINCT FROM f.year
JOIN status s ON {SAME_SITE.format(a='g', b='s')}
LEFT JOIN ws ON g.primary_watershed = ws.primary_watershed LEFT JOIN counties c ON g.county = c.county"""
)


@query("site_species_year", YEARLY_SQL)
def _(t):
    bounded_tasks(t.spark)
    visits = cut_lineage(sites(t).select("site_id", *SITE_COLUMNS, *XY, "assessment_date_raw", "visit_year"))
    found = match(records(t), targets(t, visits), "name_all", XY, SITE_COLUMNS)
    matched = cut_lineage(matched_detections(found, "records", SITE_COLUMNS))
    rows = cut_lineage(catches(t, visits).select(*SITE_COLUMNS, "species_name", "year", "database", "captured_date_raw", "row_id"))
    status = site_status(_all_detections(rows, matched), SITE, "primary_watershed", "species_name", "year", FOCAL, "v2")
    yearly = site_species_year(rows, matched, visits, status, SITE, XY, FOCAL, "v2")
    return yearly.select(*_YEARLY.split(", "))


def _text(fragment: str) -> str:
    return "'" + fragment.replace("'", "''") + "'"


def _around(template: str, value: str) -> str:
    before, after = template.split("%s")
    return f"{_text(before)} || {value} || {_text(after)}"


_PLACEMARK_SQL = """'        <Placemark>
          <name><![CDATA[' || name || ']]></name>
          <description><![CDATA[County: ' || shown_county || '<br>Site Code: ' || coalesce(CAST(site_code AS VARCHAR), 'NA') || '<br>Last Sampled: '
  || coalesce(CAST(last_sampled_year AS VARCHAR), 'NA') || ']]></description>
          <Point>
            <coordinates>' || lon || ',' || lat || ',0</coordinates>
          </Point>
        </Placemark>'"""

# The map shows the finished master: sites of both databases, records that fit no site included.
KML_SQL = (
    MASTER_CTES
    + f""",
shown AS (SELECT *, coalesce(county, 'Unknown_County') AS shown_county, round(x, 2) AS lon, round(y, 2) AS lat FROM master WHERE x IS NOT NULL AND y IS NOT NULL),
document AS (SELECT 0 AS part, NULL AS group1, 0 AS depth1, NULL AS group2, 0 AS depth2, NULL AS name, NULL::DOUBLE AS lon, NULL::DOUBLE AS lat, NULL AS id, {_text(HEADER + chr(10) + TITLE % 'Site status')} AS fragment
UNION ALL SELECT DISTINCT 1, shown_county, 0, NULL, 0, NULL, NULL, NULL, NULL, {_around(OUTER_OPEN, 'shown_county')} FROM shown
UNION ALL SELECT DISTINCT 1, shown_county, 1, site_status, 0, NULL, NULL, NULL, NULL, {_around(INNER_OPEN, 'site_status')} FROM shown
UNION ALL SELECT 1, shown_county, 1, site_status, 1, name, lon, lat, concat_ws('|', county, name, site_code, primary_watershed), {_PLACEMARK_SQL} FROM shown
UNION ALL SELECT DISTINCT 1, shown_county, 1, site_status, 2, NULL, NULL, NULL, NULL, {_text(INNER_CLOSE)} FROM shown
UNION ALL SELECT DISTINCT 1, shown_county, 2, NULL, 0, NULL, NULL, NULL, NULL, {_text(OUTER_CLOSE)} FROM shown
UNION ALL SELECT 2, NULL, 0, NULL, 0, NULL, NULL, NULL, NULL, {_text(FOOTER)})"""
)
_MAP_KEYS = ["county", "name", "site_code", "primary_watershed"]


def _shown(t):
    # The finished master is stored, as a job would find it.
    return cut_lineage(_master(t, cut_lineage(ready(t))).withColumns({c: F.round(c, 2) for c in XY}))


@query("nested_export", f"{KML_SQL} SELECT * FROM document")
def _(t):
    return nested_export(_shown(t), XY, _MAP_KEYS)


@query("map_document", f"{KML_SQL} SELECT line, count(*) AS n FROM (SELECT unnest(string_split(fragment, chr(10))) AS line FROM document) GROUP BY 1")
def _(t):
    path = scratch_path(t.spark, "map")
    write_nested_export(_shown(t), path, XY, _MAP_KEYS)
    return t.spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "area_status_with_partial",
    status_ctes("v3")
    + """ SELECT county, CASE WHEN bool_or(site_status = 'Both') OR (bool_or(site_status IN ('Brand#1 only', 'B1 Present_B2 unknown'))
  AND bool_or(site_status IN ('Brand#2 only', 'B2 Present_B1 unknown'))) THEN 'Both'
  WHEN bool_or(site_status IN ('Brand#2 only', 'B2 Present_B1 unknown')) THEN 'Brand#2 only'
  WHEN bool_or(site_status IN ('Brand#1 only', 'B1 Present_B2 unknown')) THEN 'Brand#1 only'
  WHEN bool_and(site_status = 'No AIS') THEN 'No AIS' ELSE 'Unknown' END AS county_status FROM status GROUP BY county""",
)
def _(t):
    status = site_status(catches(t), SITE, "primary_watershed", "species_name", "year", FOCAL)
    return area_status(status, "county", "v3", FOCAL, "county_status", count_partial=True)
