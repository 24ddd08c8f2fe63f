"""Status of sites and areas."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnbook.catalog.registry import query
from tarnbook.catalog.roles import CATCHES_SQL, FOCAL, SITE, SITES_SQL, catches, sites
from tarnbook.functions.numbers import decade_label
from tarnbook.operators.groups import RICHNESS_ERROR, distinct_count, group_richness, merged_richness, richness_sketches
from tarnbook.operators.joins import left_lookup
from tarnbook.plans.layers import first_detection, richness_breaks, richness_layer, shortlist
from tarnbook.plans.status import (
    area_first,
    area_levels,
    area_status,
    enrich_catches,
    site_status,
    status_crosstab,
    with_status,
)
from tarnbook.session import cut_lineage

A, B = FOCAL.a, FOCAL.b
SITE_SQL = ", ".join(SITE)


def detections(t):
    return catches(t).select(*SITE, "species_name", "year")


def statuses(t, rules):
    return site_status(detections(t), SITE, "primary_watershed", "species_name", "year", FOCAL, rules)


def status_ctes(rules: str, detections_sql: str = CATCHES_SQL, extra: str = "") -> str:
    """WITH clauses up to ``status`` (one row per site)."""
    null_area = "AND primary_watershed IS NOT NULL" if rules == "v3" else ""
    never = {"a": "ws_first_a IS NULL", "b": "ws_first_b IS NULL"}
    if rules == "v2":
        never = {s: f"(ws_first_{s} IS NULL AND NOT coalesce(ws_seen_{s}, false))" for s in "ab"}
    species = ", ".join(
        f"CASE WHEN first_{s} IS NOT NULL THEN 'Present' WHEN {never[s]} OR last_sampled_year >= ws_first_{s} "
        f"THEN 'Absent' ELSE 'Data insufficient' END AS status_{s}, "
        f"CASE WHEN first_{s} IS NULL THEN {never[s]} OR coalesce(last_sampled_year >= ws_first_{s}, false) END AS absence_{s}_believable"
        for s in "ab"
    )
    if rules == "v1":
        final = """
status AS (SELECT *, CASE WHEN first_a IS NOT NULL AND first_b IS NOT NULL THEN 'Both' WHEN first_a IS NOT NULL THEN 'Brand#1 only'
  WHEN first_b IS NOT NULL THEN 'Brand#2 only' WHEN sampled_post_invasion THEN 'No AIS' ELSE 'Unknown / insufficient data' END AS site_status
  FROM (SELECT *, last_sampled_year >= ws_first_any AS sampled_post_invasion
        FROM (SELECT *, least(ws_first_a, ws_first_b) AS ws_first_any FROM summary)))"""
    else:
        one = "'Present' AND status_b = 'Absent'" if rules == "v3" else "'Present'"
        two = "status_a = 'Absent' AND status_b = 'Present'" if rules == "v3" else "status_b = 'Present'"
        final = f"""
status AS (SELECT *, CASE WHEN status_a = 'Present' AND status_b = 'Present' THEN 'Both'
  WHEN status_a = {one} THEN 'Brand#1 only' WHEN {two} THEN 'Brand#2 only'
  WHEN status_a = 'Present' THEN 'B1 Present_B2 unknown' WHEN status_b = 'Present' THEN 'B2 Present_B1 unknown'
  WHEN status_a = 'Absent' AND status_b = 'Absent' THEN 'No AIS' WHEN status_a = 'Absent' THEN 'No B1_B2 unknown'
  WHEN status_b = 'Absent' THEN 'No B2_B1_unknown' ELSE 'Unknown' END AS site_status
  FROM (SELECT *, {species} FROM summary))"""
    return f"""WITH detections AS ({detections_sql}),
arrivals AS (SELECT primary_watershed AS ws, min(year) FILTER (species_name = 'Brand#1') AS ws_first_a,
  min(year) FILTER (species_name = 'Brand#2') AS ws_first_b, bool_or(species_name = 'Brand#1') AS ws_seen_a,
  bool_or(species_name = 'Brand#2') AS ws_seen_b
  FROM detections WHERE species_name IN ('Brand#1', 'Brand#2') {null_area} GROUP BY 1),
summary AS (SELECT s.*, ws_first_a, ws_first_b, ws_seen_a, ws_seen_b FROM (
  SELECT {SITE_SQL}, max(year) AS last_sampled_year, min(year) FILTER (species_name = 'Brand#1') AS first_a,
    min(year) FILTER (species_name = 'Brand#2') AS first_b {extra} FROM detections GROUP BY {SITE_SQL}) s
  LEFT JOIN arrivals ON primary_watershed IS NOT DISTINCT FROM ws),{final}"""


def area_sql(key: str, name: str, rules: str = "v3") -> str:
    last = (
        "WHEN bool_or(site_status = 'Unknown / insufficient data') THEN 'Unknown / insufficient data' ELSE 'No AIS'"
        if rules == "map"
        else "WHEN bool_and(site_status = 'No AIS') THEN 'No AIS' ELSE 'Unknown'"
    )
    return f"""SELECT {key}, CASE WHEN bool_or(site_status = 'Both')
  OR (bool_or(site_status = 'Brand#1 only') AND bool_or(site_status = 'Brand#2 only')) THEN 'Both'
  WHEN bool_or(site_status = 'Brand#2 only') THEN 'Brand#2 only' WHEN bool_or(site_status = 'Brand#1 only') THEN 'Brand#1 only'
  {last} END AS {name} FROM status GROUP BY {key}"""


V1_COLUMNS = f"{SITE_SQL}, last_sampled_year, first_a, first_b, ws_first_a, ws_first_b, ws_first_any, sampled_post_invasion, site_status"
V3_COLUMNS = f"{SITE_SQL}, last_sampled_year, first_a, first_b, ws_first_a, ws_first_b, absence_a_believable, absence_b_believable, status_a, status_b, site_status"


@query("site_status_v1", status_ctes("v1") + f" SELECT {V1_COLUMNS} FROM status")
def _(t):
    return statuses(t, "v1")


@query("site_status_v2", status_ctes("v2") + f" SELECT {V3_COLUMNS} FROM status")
def _(t):
    return statuses(t, "v2")


@query("site_status_v3", status_ctes("v3") + f" SELECT {V3_COLUMNS} FROM status")
def site_status_v3(t):
    return statuses(t, "v3")


@query("watershed_status", status_ctes("v3") + area_sql("primary_watershed", "ws_status"))
def _(t):
    return area_status(statuses(t, "v3"), "primary_watershed", "v3", FOCAL, "ws_status")


@query("county_status", status_ctes("v3") + area_sql("county", "county_status"))
def _(t):
    return area_status(statuses(t, "v3"), "county", "v3", FOCAL, "county_status")


@query("watershed_status_map", status_ctes("v1") + area_sql("primary_watershed", "ws_status", "map"))
def _(t):
    return area_status(statuses(t, "v1"), "primary_watershed", "map", FOCAL, "ws_status")


def _level_sql(level: str, key: str) -> str:
    one = "(SELECT *, NULL::VARCHAR AS every FROM status)"
    rolled = area_sql(key, "area_status").replace("FROM status", f"FROM {one}")
    return f"""SELECT '{level}' AS level, a.{key} AS area, area_status, n_sites FROM ({rolled}) a
  JOIN (SELECT {key} AS k, count(*) AS n_sites FROM {one} GROUP BY 1) n ON a.{key} IS NOT DISTINCT FROM n.k"""


@query("status_levels", status_ctes("v3") + " UNION ALL ".join(_level_sql(*l) for l in (("watershed", "primary_watershed"), ("county", "county"), ("province", "every"))))
def _(t):
    return area_levels(statuses(t, "v3"), {"watershed": "primary_watershed", "county": "county"}, "v3", FOCAL)


_STATUS_COUNTS = ", ".join(
    f"count(*) FILTER (site_status = '{label}') AS \"{label}\"" for label in FOCAL.labels("v3")
)


@query("status_crosstab", status_ctes("v3") + f" SELECT primary_watershed, {_STATUS_COUNTS} FROM status GROUP BY 1")
def _(t):
    return status_crosstab(statuses(t, "v3"), "primary_watershed", FOCAL)


@query(
    "watershed_first_wide",
    f"""SELECT primary_watershed, min(year) FILTER (species_name = '{A}') AS ws_first_a,
  min(year) FILTER (species_name = '{B}') AS ws_first_b, bool_or(species_name = '{A}') AS ws_seen_a,
  bool_or(species_name = '{B}') AS ws_seen_b FROM ({CATCHES_SQL})
  WHERE species_name IN ('{A}', '{B}') GROUP BY 1""",
)
def _(t):
    return area_first(detections(t), "primary_watershed", "species_name", "year", FOCAL)


@query(
    "detections_with_status",
    status_ctes("v3") + f""" SELECT d.county, d.site_code, d.name, d.primary_watershed, d.species_name, d.year,
  status_a, status_b, site_status FROM detections d JOIN status s ON d.county = s.county AND d.site_code = s.site_code
  AND d.name = s.name AND d.primary_watershed = s.primary_watershed""",
)
def _(t):
    status = statuses(t, "v3").select(*SITE, "status_a", "status_b", "site_status")
    return with_status(detections(t), status, SITE)


@query(
    "first_detection_decade",
    f"""WITH d AS (SELECT * FROM ({CATCHES_SQL}) WHERE species_name IN ('{A}', '{B}')),
f AS (SELECT name, site_code, species_name, min(year) AS first_year FROM d GROUP BY ALL),
g AS (SELECT *, CAST(floor(first_year / 2) * 2 AS INT) AS decade_of_first, dense_rank() OVER (ORDER BY floor(first_year / 2)) AS decade_rank FROM f)
SELECT d.name, d.site_code, d.species_name, d.captured_date_raw, d.year, CAST(floor(d.year / 2) * 2 AS INT) AS decade, first_year, decade_of_first, decade_rank
FROM d JOIN g ON d.name = g.name AND d.site_code = g.site_code AND d.species_name = g.species_name""",
)
def _(t):
    rows = catches(t).select("name", "site_code", "species_name", "captured_date_raw")
    found = first_detection(rows, ["name", "site_code"], "species_name", "captured_date_raw", (A, B), "d MMM yyyy", bucket=2)
    return found.drop("day")


RICHNESS_SQL = f"""SELECT county, site_code, name, species_name, unique_species_count FROM ({CATCHES_SQL}) d
JOIN (SELECT county AS c, site_code AS s, name AS n, count(DISTINCT species_name) AS unique_species_count FROM ({CATCHES_SQL}) GROUP BY ALL)
ON county = c AND site_code = s AND name = n"""


def richness(t):
    return richness_layer(detections(t).select("county", "site_code", "name", "species_name"), ["county", "site_code", "name"], "species_name")


@query("richness_joined_back", RICHNESS_SQL)
def _(t):
    return richness(t)


@query(
    "richness_sketched",
    f"""SELECT 'watershed' AS level, primary_watershed AS area, count(DISTINCT species_name) AS unique_species_count, true AS within FROM ({CATCHES_SQL}) GROUP BY 2
UNION ALL SELECT 'county', county, count(DISTINCT species_name), true FROM ({CATCHES_SQL}) GROUP BY 2""",
)
def _(t):
    # Sketches of sites are stored; areas are put together from them, and held against exact counts.
    rows = detections(t)
    stored = cut_lineage(richness_sketches(rows, SITE, "species_name"))
    levels = []
    for level, key in (("watershed", "primary_watershed"), ("county", "county")):
        about = merged_richness(stored, [key], name="about")
        exact = group_richness(rows, [key], "species_name", "unique_species_count")
        both = left_lookup(exact, about, key)
        off = F.abs(F.col("about") - F.col("unique_species_count")) <= F.ceil(F.col("unique_species_count") * RICHNESS_ERROR)
        levels.append(both.select(F.lit(level).alias("level"), F.col(key).alias("area"), "unique_species_count", off.alias("within")))
    return levels[0].unionByName(levels[1])


@query(
    "richness_breaks",
    f"SELECT unnest(range(0, max(unique_species_count) + 1, 3))::INT AS break FROM ({RICHNESS_SQL})",
)
def _(t):
    return richness_breaks(richness(t))


@query("distinct_sites", f"SELECT count(*) AS n FROM (SELECT DISTINCT {SITE_SQL} FROM ({SITES_SQL}))")
def _(t):
    return distinct_count(sites(t), SITE)


@query("small_sites", f"SELECT DISTINCT {SITE_SQL} FROM ({SITES_SQL}) WHERE surface_area_ha < 100000")
def _(t):
    return shortlist(sites(t), SITE, "surface_area_ha", 100000)


@query(
    "enriched_by_visit",
    f"""SELECT c.county, c.site_code, c.name, c.primary_watershed, c.species_name, c.captured_date_raw,
  strftime(strptime(c.captured_date_raw, '%-d %b %Y'), '%Y-%m-%d') AS date, c.year, s.surface_area_ha
FROM ({CATCHES_SQL}) c LEFT JOIN ({SITES_SQL}) s ON c.county = s.county AND c.site_code = s.site_code AND c.name = s.name
  AND c.primary_watershed = s.primary_watershed AND c.captured_date_raw = s.assessment_date_raw""",
)
def _(t):
    rows = detections(t).drop("year")
    with_date = catches(t).select(*rows.columns, "captured_date_raw")
    return enrich_catches(with_date, sites(t), SITE).withColumn("date", F.col("date").cast("string"))


@query(
    "decade_labels",
    f"SELECT {SITE_SQL}, first_year, CAST(CAST(floor(first_year / 10) * 10 AS INT) AS VARCHAR) || 's' AS decade FROM "
    f"(SELECT {SITE_SQL}, min(year) AS first_year FROM ({CATCHES_SQL}) GROUP BY ALL)",
)
def _(t):
    firsts = detections(t).groupBy(*SITE).agg(F.min("year").alias("first_year"))
    return firsts.withColumn("decade", decade_label(F.col("first_year")))
