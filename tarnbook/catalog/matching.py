"""Records of a second database matched to sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnbook.catalog.registry import Tables, query
from tarnbook.catalog.roles import FOCAL, RECORDS_SQL, SITE_COLUMNS, SITES_SQL, records, sites
from tarnbook.operators.names import name_match
from tarnbook.operators.nearest import nearest_join
from tarnbook.operators.review import relink_orphans, review_queue
from tarnbook.operators.similar import proposed_crosswalk
from tarnbook.plans.match import dedupe_records, left_unmatched, match, prepare_records, resolve_identity, settle_matches
from tarnbook.session import cut_lineage

XY = ("x", "y")


def targets(t: Tables, visits: DataFrame | None = None) -> DataFrame:
    """Sites to match; made from ``visits``, if these are stored already."""
    return (sites(t) if visits is None else visits).select("site_id", *SITE_COLUMNS, *XY)


def banded(t: Tables) -> DataFrame:
    return match(records(t), targets(t), "distance_county", XY, SITE_COLUMNS)


def wrong_pairs(matched: DataFrame) -> DataFrame:
    """Confident pairs of every fourth record, listed as false."""
    listed = matched.where((F.col("match_status") == "confident") & (F.col("record_id") % 4 == 1))
    return listed.select(
        F.col("name").alias("record_name"), "site_name", F.lit("review_name_mismatch").alias("new_status")
    )


def decisions(t: Tables) -> DataFrame:
    """The log of a person's decisions: two in five are matches, two are not, one is open; some ids are unknown."""
    key = F.col("s_suppkey")
    made = t.supplier.where(key % 5 != 0).select(
        (key * 2).alias("record_id"), F.lit("manual").alias("match_decision"),
        F.when(key % 5 < 3, "match").otherwise("not_a_match").alias("match_status_confirmed"), F.lit("2026-03-20").cast("date").alias("decided_at"),
    )
    # Every other case was looked at twice, with two minds; the later decision counts, whichever it is.
    other = F.when(F.col("match_status_confirmed") == "match", "not_a_match").otherwise("match")
    again = made.where(F.col("record_id") % 4 == 2).withColumns({"match_status_confirmed": other, "decided_at": F.date_add("decided_at", 1)})
    return again.unionByName(made)


def decided(t: Tables) -> DataFrame:
    stored = cut_lineage(banded(t))
    return settle_matches(stored, wrong_pairs(stored), decisions(t), SITE_COLUMNS)


NEAR_CTES = f"""WITH sites AS ({SITES_SQL}), records AS ({RECORDS_SQL}),
near AS (SELECT r.*, s.site_id, s.county AS site_county, s.site_code, s.name AS site_name, s.primary_watershed AS site_primary_watershed,
  s.watershed_code AS site_watershed_code, sqrt((r.x - s.x) * (r.x - s.x) + (r.y - s.y) * (r.y - s.y)) AS distance_m
  FROM records r CROSS JOIN sites s QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY distance_m, site_id) = 1)"""

BAND_CTES = NEAR_CTES + """,
related AS (SELECT *, CASE WHEN county IS NULL THEN 'missing' WHEN county = site_county THEN 'same' ELSE 'different' END AS county_match FROM near),
banded AS (SELECT *, CASE WHEN distance_m <= 200 AND county_match = 'same' THEN 'confident'
  WHEN distance_m <= 300 AND county_match = 'missing' THEN 'review_missing_county'
  WHEN distance_m <= 200 AND county_match = 'different' THEN 'review_county_mismatch'
  WHEN distance_m <= 500 AND county_match = 'same' THEN 'review_possible_match' ELSE 'unlikely' END AS match_status FROM related)"""

DECIDED_CTES = BAND_CTES + """,
wrong AS (SELECT DISTINCT name AS wrong_name, site_name AS wrong_site FROM banded WHERE match_status = 'confident' AND record_id % 4 = 1),
person AS (SELECT s_suppkey * 2 AS id, 'manual' AS d, CASE WHEN (s_suppkey % 5 < 3) <> (s_suppkey * 2 % 4 = 2) THEN 'match' ELSE 'not_a_match' END AS c FROM supplier WHERE s_suppkey % 5 <> 0),
overridden AS (SELECT b.*, wrong_name IS NOT NULL AS hit FROM banded b LEFT JOIN wrong ON name = wrong_name AND site_name = wrong_site AND match_status = 'confident'),
decided AS (SELECT record_id, species_name, name, county, year, x, y, distance_m, county_match,
  CASE WHEN NOT hit THEN site_id END AS site_id, CASE WHEN NOT hit THEN site_county END AS site_county, CASE WHEN NOT hit THEN site_code END AS site_code,
  CASE WHEN NOT hit THEN site_name END AS site_name, CASE WHEN NOT hit THEN site_primary_watershed END AS site_primary_watershed,
  CASE WHEN NOT hit THEN site_watershed_code END AS site_watershed_code,
  CASE WHEN hit THEN 'review_name_mismatch' ELSE match_status END AS match_status,
  coalesce(d, CASE WHEN hit THEN 'not_a_match' WHEN match_status = 'confident' THEN 'automatic' END) AS match_decision,
  coalesce(c, CASE WHEN hit THEN 'not_a_match' WHEN match_status = 'confident' THEN 'match' END) AS match_status_confirmed
  FROM overridden LEFT JOIN person ON record_id = id)"""

READY_CTES = DECIDED_CTES + """,
kept AS (SELECT *, coalesce(match_status_confirmed = 'match', false) AS confirmed FROM decided
  QUALIFY row_number() OVER (PARTITION BY CASE WHEN coalesce(match_status_confirmed = 'match', false) THEN site_name
    ELSE coalesce(name, 'NA') || '_' || coalesce(county, 'NA') END, species_name ORDER BY year DESC NULLS LAST, record_id) = 1),
ready AS (SELECT CASE WHEN confirmed THEN site_county ELSE county END AS county, CASE WHEN confirmed THEN site_code END AS site_code,
  CASE WHEN confirmed THEN site_name ELSE name END AS name, CASE WHEN confirmed THEN site_primary_watershed END AS primary_watershed,
  CASE WHEN confirmed THEN site_watershed_code END AS watershed_code, species_name, year, 'records' AS database, record_id, x, y FROM kept)"""


def ready(t: Tables) -> DataFrame:
    return resolve_identity(dedupe_records(decided(t)), "records", SITE_COLUMNS)


@query("nearest_site", NEAR_CTES + " SELECT record_id, site_id, round(distance_m, 6) AS distance_m FROM near")
def _(t):
    near = nearest_join(records(t).select("record_id", *XY), sites(t).select("site_id", *XY), "site_id")
    return near.select("record_id", "site_id", F.round("distance_m", 6).alias("distance_m"))


@query("nearest_within", NEAR_CTES + " SELECT record_id, site_id, round(distance_m, 6) AS distance_m FROM near WHERE distance_m <= 200")
def _(t):
    near = nearest_join(records(t).select("record_id", *XY), sites(t).select("site_id", *XY), "site_id", max_distance_m=200, how="inner")
    return near.select("record_id", "site_id", F.round("distance_m", 6).alias("distance_m"))


@query(
    "nearest_record_of_site",
    f"""WITH sites AS ({SITES_SQL}), records AS ({RECORDS_SQL}), places AS (SELECT DISTINCT x, y FROM sites),
near AS (SELECT p.x, p.y, record_id, sqrt((p.x - r.x) * (p.x - r.x) + (p.y - r.y) * (p.y - r.y)) AS distance_m FROM places p CROSS JOIN records r
  QUALIFY row_number() OVER (PARTITION BY p.x, p.y ORDER BY distance_m, record_id) = 1)
SELECT site_id, record_id, round(distance_m, 6) AS distance_m FROM sites JOIN near ON sites.x = near.x AND sites.y = near.y""",
)
def _(t):
    near = nearest_join(sites(t).select("site_id", *XY), records(t).select("record_id", *XY), "record_id")
    return near.select("site_id", "record_id", F.round("distance_m", 6).alias("distance_m"))


@query(
    "nearest_k",
    f"""WITH sites AS ({SITES_SQL}), records AS ({RECORDS_SQL})
SELECT record_id, site_id, CAST(nearest_rank AS INT) AS nearest_rank, round(distance_m, 6) AS distance_m FROM
(SELECT record_id, site_id, sqrt((r.x - s.x) * (r.x - s.x) + (r.y - s.y) * (r.y - s.y)) AS distance_m,
  row_number() OVER (PARTITION BY record_id ORDER BY distance_m, site_id) AS nearest_rank FROM records r CROSS JOIN sites s) WHERE nearest_rank <= 5""",
)
def _(t):
    near = nearest_join(records(t).select("record_id", *XY), sites(t).select("site_id", *XY), "site_id", k=5)
    return near.select("record_id", "site_id", "nearest_rank", F.round("distance_m", 6).alias("distance_m"))


@query("match_bands", BAND_CTES + " SELECT record_id, county, site_county, site_name, round(distance_m, 6) AS distance_m, county_match, match_status FROM banded")
def _(t):
    return banded(t).select("record_id", "county", "site_county", "site_name", F.round("distance_m", 6).alias("distance_m"), "county_match", "match_status")


_DECIDED = "record_id, site_id, site_county, site_code, site_name, site_primary_watershed, site_watershed_code, match_status, match_decision, match_status_confirmed"


@query("match_overrides", DECIDED_CTES.replace("coalesce(d, ", "coalesce(NULL, ").replace("coalesce(c, ", "coalesce(NULL, ") + f" SELECT {_DECIDED} FROM decided")
def _(t):
    stored = cut_lineage(banded(t))
    return settle_matches(stored, wrong_pairs(stored), site_columns=SITE_COLUMNS).select(*_DECIDED.split(", "))


@query("review_queue", BAND_CTES + " SELECT record_id, name, site_name, match_status FROM banded WHERE match_status <> 'confident'")
def _(t):
    return review_queue(banded(t)).select("record_id", "name", "site_name", "match_status")


@query("review_decisions", DECIDED_CTES + f" SELECT {_DECIDED} FROM decided")
def _(t):
    return decided(t).select(*_DECIDED.split(", "))


@query("decisions_relinked", f"SELECT record_id, name, true AS relinked FROM ({RECORDS_SQL}) WHERE record_id % 3 <> 0")
def _(t):
    # Two thirds of the records got another id since they were decided on.
    now = records(t).select("record_id", "name", "species_name")
    key = F.col("record_id")
    before = now.withColumns({"record_id": F.when(key % 3 == 0, key).otherwise(key + 1_000_000_000), "match_status_confirmed": F.lit("match")})
    return relink_orphans(now, before, ["name", "species_name"]).select("record_id", "name", "relinked")


_READY = "county, site_code, name, primary_watershed, watershed_code, species_name, year, database, record_id"


@query("deduped_identities", READY_CTES + f" SELECT {_READY} FROM ready")
def _(t):
    return ready(t).select(*_READY.split(", "))


NAME_CTES = f"""WITH sites AS ({SITES_SQL}), records AS ({RECORDS_SQL}),
hits AS (SELECT r.record_id, s.site_id, r.name AS rn, s.name AS sn FROM records r JOIN sites s ON r.county = s.county
  AND (contains(upper(s.name), upper(r.name)) OR contains(r.name, s.name)))"""

BEST_SQL = """best AS (SELECT record_id, site_id FROM (SELECT *, count(*) FILTER (upper(rn) = upper(sn)) OVER (PARTITION BY record_id) AS n_same FROM hits)
  QUALIFY row_number() OVER (PARTITION BY record_id
    ORDER BY CASE WHEN n_same = 1 AND upper(rn) = upper(sn) THEN 0 ELSE 1 END, abs(length(rn) - length(sn)), site_id) = 1)"""

NEAREST_REST_SQL = """rest AS (SELECT * FROM records WHERE record_id NOT IN (SELECT record_id FROM hits)),
close AS (SELECT r.record_id, s.site_id, sqrt((r.x - s.x) * (r.x - s.x) + (r.y - s.y) * (r.y - s.y)) AS distance_m
  FROM rest r CROSS JOIN sites s QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY distance_m, site_id) = 1)"""


def _names(t, policy, regex=False):
    r = records(t).select("record_id", "county", "name")
    s = sites(t).select("site_id", F.col("county").alias("site_county"), F.col("name").alias("site_name"))
    return name_match(r, s, "record_id", "site_id", policy=policy, regex=regex)


@query("name_match_all", NAME_CTES + " SELECT record_id, site_id FROM hits")
def _(t):
    return _names(t, "all")


@query("name_match_best", NAME_CTES + f", {BEST_SQL} SELECT record_id, site_id FROM best")
def _(t):
    return _names(t, "best")


# Half of the site names have a free character, half a group.
PATTERN_CTES = f"""WITH sites AS (SELECT *, CASE WHEN site_code % 2 = 0 THEN replace(name, '#', '.') ELSE replace(name, 'Customer', '(Customer)') END AS pattern FROM ({SITES_SQL})),
records AS ({RECORDS_SQL}),
hits AS (SELECT DISTINCT r.record_id, s.site_id FROM records r JOIN sites s ON r.county = s.county
  AND (contains(upper(s.pattern), upper(r.name)) OR regexp_matches(r.name, s.pattern)))"""


@query("name_match_pattern", PATTERN_CTES + " SELECT record_id, site_id FROM hits")
def _(t):
    r = records(t).select("record_id", "county", "name")
    pattern = F.when(F.col("site_code") % 2 == 0, F.replace("name", F.lit("#"), F.lit("."))).otherwise(F.replace("name", F.lit("Customer"), F.lit("(Customer)")))
    s = sites(t).select("site_id", F.col("county").alias("site_county"), pattern.alias("site_name"))
    return name_match(r, s, "record_id", "site_id", policy="all", regex=True)


@query("unmatched_by_name", NAME_CTES + " SELECT record_id, name FROM records WHERE record_id NOT IN (SELECT record_id FROM hits)")
def _(t):
    return left_unmatched(records(t), _names(t, "all")).select("record_id", "name")


_THEN = "SELECT record_id, site_id, 'name' AS matched_by, NULL::DOUBLE AS distance_m FROM {} UNION ALL SELECT record_id, site_id, 'distance', round(distance_m, 6) FROM close WHERE distance_m <= 200"


@query("name_then_distance", NAME_CTES + f", {NEAREST_REST_SQL} {_THEN.format('hits')}")
def _(t):
    found = match(records(t), targets(t), "name_all", XY, SITE_COLUMNS)
    return found.select("record_id", "site_id", "matched_by", F.round("distance_m", 6).alias("distance_m"))


@query("best_name_then_distance", NAME_CTES + f", {BEST_SQL}, {NEAREST_REST_SQL} {_THEN.format('best')}")
def _(t):
    found = match(records(t), targets(t), "name_best", XY, SITE_COLUMNS)
    return found.select("record_id", "site_id", "matched_by", F.round("distance_m", 6).alias("distance_m"))


_RAW_UTM = """SELECT CASE WHEN s_suppkey % 5 = 0 THEN 'NB' ELSE 'NS' END AS province, s_name || ' Lake' AS location, lower(r_name) AS country,
  CASE WHEN s_suppkey % 4 = 0 THEN 'unknown' ELSE CAST(1990 + s_suppkey % 20 AS VARCHAR) END AS year, CAST(300000.5 + s_suppkey AS DOUBLE) AS easting, CAST(4800000.5 + s_suppkey AS DOUBLE) AS northing,
  '20' AS utm_zone FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
_RAW_LONLAT = """SELECT c_name || ' River' AS system, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE r_name END AS county, CAST(2000 + c_custkey % 9 AS VARCHAR) AS year, '20' AS zone,
  43.0 + c_custkey % 100 / 32 AS lat, -66.0 + c_custkey % 50 / 16 AS lon FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def _record_sql(raw: str, cols: dict[str, str], species: str, name: str, county: str, place: str) -> str:
    """Ids from the raw columns as JSON, and a running number among exact copies."""
    parts = " || ',' || ".join(f"'\"{c}\":' || " + (f"'\"' || {c} || '\"'" if kind == "text" else c) for c, kind in cols.items())
    key = f"trim(regexp_replace(regexp_replace(regexp_replace(upper({name}), '\\b(?:LAKE|RIVER)\\b', '', 'g'), '\\p{{P}}', '', 'g'), '\\s+', ' ', 'g'))"
    return f"""SELECT sha256('{{' || {parts} || '}}') || '-' || row_number() OVER (PARTITION BY {', '.join(cols)}) AS record_id, '{species}' AS species_name,
  {key} AS name, nullif(array_to_string(list_transform(string_split(lower({county}), ' '), lambda w: upper(w[1]) || w[2:]), ' '), '') AS county, try_cast(year AS INT) AS year, {place} FROM ({raw})"""


@query(
    "prepared_records",
    _record_sql(
        f"SELECT * FROM ({_RAW_UTM}) WHERE province = 'NS'",
        {"province": "text", "location": "text", "country": "text", "year": "text", "easting": "number", "northing": "number", "utm_zone": "text"},
        FOCAL.b, "location", "country", "easting, northing, NULL::DOUBLE AS lon, NULL::DOUBLE AS lat",
    )
    + " UNION ALL "
    + _record_sql(
        _RAW_LONLAT, {"system": "text", "county": "text", "year": "text", "zone": "text", "lat": "number", "lon": "number"},
        FOCAL.a, "system", "county", "NULL, NULL, lon, lat",
    ),
)
def _(t):
    key, region = F.col("s_suppkey"), F.col("r_name")
    regions = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    utm = t.supplier.join(regions, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.when(key % 5 == 0, "NB").otherwise("NS").alias("province"), F.concat_ws(" ", "s_name", F.lit("Lake")).alias("location"), F.lower(region).alias("country"),
        F.when(key % 4 == 0, "unknown").otherwise((1990 + key % 20).cast("string")).alias("year"),
        (300000.5 + key).alias("easting"), (4800000.5 + key).alias("northing"), F.lit("20").alias("utm_zone"),
    )
    code = F.col("c_custkey")
    lonlat = t.customer.join(regions, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat_ws(" ", "c_name", F.lit("River")).alias("system"), F.when(code % 3 == 0, "").otherwise(region).alias("county"),
        (2000 + code % 9).cast("string").alias("year"), F.lit("20").alias("zone"), (43.0 + code % 100 / 32).alias("lat"), (-66.0 + code % 50 / 16).alias("lon"),
    )
    found = prepare_records(utm, lonlat, species=(FOCAL.b, FOCAL.a))
    # The coordinates each part came with; the projected ones are compared in the queries on projection.
    own = F.col("species_name") == FOCAL.b
    return found.select(
        "record_id", "species_name", "name", "county", "year", *[F.when(own, F.col(c)).alias(c) for c in ("easting", "northing")],
        *[F.when(~own, F.col(c)).alias(c) for c in ("lon", "lat")],
    )


# Area names as another list has them: a letter is missing, another one, or two letters are swapped for one.
_AREA = "n_name || ' ' || c_mktsegment || ' BASIN'"
_MISWRITTEN = f"""SELECT CASE c_custkey % 4 WHEN 0 THEN substr(area, 1, place - 1) || substr(area, place + 1) WHEN 1 THEN substr(area, 1, place - 1) || 'x' || substr(area, place + 1)
  WHEN 2 THEN substr(area, 1, place - 1) || '-' || substr(area, place + 2) ELSE substr(area, 1, place) || ' near ' || substr(area, place + 1) END AS name
  FROM (SELECT c_custkey, {_AREA} AS area, 1 + c_custkey * 7 % length({_AREA}) AS place FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@query(
    "proposed_crosswalk",
    f"""WITH names AS (SELECT name, count(*) AS n_rows FROM ({_MISWRITTEN}) GROUP BY 1),
areas AS (SELECT DISTINCT {_AREA} AS area FROM customer JOIN nation ON c_nationkey = n_nationkey),
near AS (SELECT name, area, CAST(levenshtein(name, area) AS INT) AS edits FROM names CROSS JOIN areas
  WHERE levenshtein(name, area) <= greatest(length(name), length(area)) // 5),
best AS (SELECT name, min(edits) AS edits FROM near GROUP BY 1),
closest AS (SELECT name, edits, min(area) AS proposal, count(*) AS n_closest FROM near JOIN best USING (name, edits) GROUP BY 1, 2)
SELECT name, n_rows, proposal, edits, coalesce(n_closest, 0) AS n_closest FROM names LEFT JOIN closest USING (name)""",
)
def _(t):
    named = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat_ws(" ", "n_name", "c_mktsegment", F.lit("BASIN")).alias("area"))
    area, at, way = F.col("area"), F.col("at"), F.col("c_custkey") % 4
    head, rest = F.substr(area, F.lit(1), at - 1), F.substr(area, at + 1)
    other = (
        F.when(way == 0, F.concat(head, rest)).when(way == 1, F.concat(head, F.lit("x"), rest))
        .when(way == 2, F.concat(head, F.lit("-"), F.substr(area, at + 2))).otherwise(F.concat(F.substr(area, F.lit(1), at), F.lit(" near "), rest))
    )
    miswritten = named.withColumn("at", (1 + F.col("c_custkey") * 7 % F.length("area")).cast("int")).select(other.alias("name"))
    return proposed_crosswalk(miswritten, named, target="area")
