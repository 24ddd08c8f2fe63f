"""Cleaning, reshaping and comparing tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnbook.catalog.registry import query
from tarnbook.catalog.roles import SITE, SITES_SQL, sites
from tarnbook.functions.dates import first_of_january, to_day
from tarnbook.functions.numbers import ddmm_to_degrees, decade, to_number, west
from tarnbook.functions.text import area_name_key, length_gap, paste, site_name_key
from tarnbook.operators.groups import (
    column_profile,
    duplicate_groups,
    first_by_category,
    first_last,
    first_non_null,
    joined_values,
    name_diff,
    side_by_side,
    source_label,
    top_n,
    top_row,
    with_record_id,
)
from tarnbook.operators.joins import apply_crosswalk, full_merge, overlay
from tarnbook.operators.tidy import (
    blank_to_null,
    canonical_columns,
    drop_index_column,
    lengthen,
    relocate,
    select_span,
    sentinel_to_null,
    stack,
    widen,
)
from tarnbook.plans.harmonise import LAKE_LIST, RIVER_LIST, SAMPLE_LIST, harmonise
from tarnbook.plans.layers import decode_species
from tarnbook.session import scratch_path
from tarnbook.sources.tables import read_table, write_table

SITE_SQL = ", ".join(SITE)


@query(
    "duplicate_groups",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, n_rows FROM lineitem
JOIN (SELECT l_partkey AS p, l_suppkey AS s, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1)
ON l_partkey = p AND l_suppkey = s""",
)
def _(t):
    return duplicate_groups(t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity"), ["l_partkey", "l_suppkey"])


@query(
    "latest_per_identity",
    """SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice, year(o_orderdate) AS year FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) = 1""",
)
def _(t):
    rows = t.orders.select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice", "o_orderdate")
    best = top_row(rows, ["o_custkey", "o_orderpriority"], [F.desc_nulls_last("o_orderdate"), "o_orderkey"])
    return best.withColumn("year", F.year("o_orderdate")).drop("o_orderdate")


@query(
    "first_non_null",
    f"""SELECT {SITE_SQL}, arg_min(volume_m3, site_id) FILTER (volume_m3 IS NOT NULL) AS volume_m3,
  arg_min(max_depth_m, site_id) FILTER (max_depth_m IS NOT NULL) AS max_depth_m FROM ({SITES_SQL}) GROUP BY ALL""",
)
def _(t):
    return first_non_null(sites(t), SITE, ["volume_m3", "max_depth_m"], ["site_id"])


SOURCES_SQL = "SELECT o_custkey AS site_code, 'main' AS database FROM orders UNION ALL SELECT user_id, 'records' FROM events"


def sources(t):
    main = t.orders.select(F.col("o_custkey").alias("site_code"), F.lit("main").alias("database"))
    return main.unionByName(t.events.select(F.col("user_id").alias("site_code"), F.lit("records").alias("database")))


@query(
    "source_labels",
    f"""SELECT site_code, CASE WHEN bool_or(database = 'main') AND bool_or(database = 'records') THEN 'Both'
  WHEN bool_or(database = 'main') THEN 'main Only' ELSE 'records Only' END AS data_source FROM ({SOURCES_SQL}) GROUP BY 1""",
)
def _(t):
    return sources(t).groupBy("site_code").agg(source_label("database", "main", "records").alias("data_source"))


@query("sources_joined", f"SELECT site_code, string_agg(DISTINCT database, '+' ORDER BY database) AS database FROM ({SOURCES_SQL}) GROUP BY 1")
def _(t):
    return joined_values(sources(t), ["site_code"], "database")


@query(
    "full_merge_coords",
    """SELECT coalesce(c_custkey, s_suppkey * 20) AS key, c_acctbal AS balance_meta, s_acctbal AS balance_fish,
  coalesce(c_acctbal, s_acctbal) AS balance FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 20""",
)
def _(t):
    a = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"))
    b = t.supplier.select((F.col("s_suppkey") * 20).alias("key"), F.col("s_acctbal").alias("balance"))
    return full_merge(a, b, ["key"], ["balance"])


@query(
    "union_fill",
    """SELECT c_name AS name, c_nationkey AS nation, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer
UNION ALL SELECT s_name, s_nationkey, NULL, s_acctbal FROM supplier""",
)
def _(t):
    a = t.customer.select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    b = t.supplier.select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return stack(a, b)


@query(
    "strict_union",
    """SELECT "group", lake, river, site, code, latitude, -abs(longitude) AS longitude, date_raw FROM (
SELECT 'lakes' AS "group", c_name AS lake, NULL AS river, c_mktsegment AS site, CAST(c_custkey AS VARCHAR) AS code,
  CASE WHEN c_custkey % 10 <> 0 THEN 44.5 END AS latitude, c_acctbal / 100 AS longitude, CAST(c_nationkey AS VARCHAR) AS date_raw FROM customer
UNION ALL SELECT 'rivers', NULL, s_name, 'S', CAST(s_suppkey AS VARCHAR), s_acctbal, CASE WHEN s_suppkey % 4 <> 0 THEN -63.0 END, 'raw' FROM supplier
UNION ALL SELECT 'samples', p_name, NULL, p_type, CAST(p_partkey AS VARCHAR), p_retailprice, CAST(p_size AS DOUBLE), p_brand FROM part)
WHERE latitude IS NOT NULL""",
)
def _(t):
    c, s, p = F.col("c_custkey"), F.col("s_suppkey"), F.col("p_partkey")
    lakes = t.customer.select(
        F.lit("lakes").alias("Group"), F.col("c_name").alias("LAKE"), F.col("c_mktsegment").alias("Site"), c.alias("CODE"),
        F.when(c % 10 != 0, 44.5).alias("Location_Lat"), (F.col("c_acctbal") / 100).alias("Location_Lon"), F.col("c_nationkey").alias("Date"),
    )
    rivers = t.supplier.select(
        F.lit("rivers").alias("Group"), F.col("s_name").alias("RIVER"), F.lit("S").alias("Site"), s.alias("CODE"),
        F.col("s_acctbal").alias("Location_Lat"), F.when(s % 4 != 0, -63.0).alias("Location_Lon"), F.lit("raw").alias("Date"),
    )
    samples = t.part.select(
        F.lit("samples").alias("Group"), F.col("p_name").alias("Lake.Name"), F.col("p_type").alias("Site.Group"), p.alias("Sample.Code"),
        F.col("p_retailprice").alias("Location_Lat"), F.col("p_size").alias("Location_Lon"), F.col("p_brand").alias("Date"),
    )
    return harmonise(
        {"lakes": lakes, "rivers": rivers, "samples": samples},
        {"lakes": LAKE_LIST, "rivers": RIVER_LIST, "samples": SAMPLE_LIST},
    )


def _names(t, parity):
    """Every part is in one of two lists, by the parity of its size."""
    return t.part.where(F.col("p_size") % 2 == parity).select(F.concat_ws("-", "p_name", "p_type").alias("name"))


_NAMES_SQL = "SELECT DISTINCT p_name || '-' || p_type AS name FROM part WHERE p_size % 2 = {}"


@query(
    "name_diff",
    f"""WITH a AS ({_NAMES_SQL.format(0)}), b AS ({_NAMES_SQL.format(1)})
SELECT name, 'right' AS missing_in FROM a WHERE name NOT IN (SELECT name FROM b)
UNION ALL SELECT name, 'left' FROM b WHERE name NOT IN (SELECT name FROM a)""",
)
def _(t):
    return name_diff(_names(t, 0), _names(t, 1), "name")


@query(
    "side_by_side",
    f"""WITH a AS (SELECT name AS have, row_number() OVER (ORDER BY name) AS line FROM ({_NAMES_SQL.format(0)})),
b AS (SELECT name AS want, row_number() OVER (ORDER BY name) AS line FROM ({_NAMES_SQL.format(1)}))
SELECT coalesce(a.line, b.line) AS line, have, want FROM a FULL JOIN b ON a.line = b.line""",
)
def _(t):
    return side_by_side(_names(t, 0), _names(t, 1), "name")


@query(
    "site_name_key",
    r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(upper(replace(text, 'ß', 'ss') || ' Lake St. ' || source || ' River'),
  '\b(?:LAKE|RIVER)\b', '', 'g'), '\p{P}', '', 'g'), '[\s\p{Z}]+', ' ', 'g'), ' ') AS name_key FROM documents""",
)
def _(t):
    text = F.concat(F.replace(F.col("text"), F.lit("ß"), F.lit("ss")), F.lit(" Lake St. "), F.col("source"), F.lit(" River"))
    return t.documents.select("doc_id", site_name_key(text).alias("name_key"))


_AREA_NAMES_SQL = """CASE p_partkey % 3 WHEN 0 THEN p_name || ' & ' || p_brand WHEN 1 THEN p_name || '/' || p_type
  ELSE 'St. ' || p_name || '  (' || p_type || ')' END"""


def _area_names():
    key = F.col("p_partkey") % 3
    return (
        F.when(key == 0, F.concat_ws(" & ", "p_name", "p_brand"))
        .when(key == 1, F.concat_ws("/", "p_name", "p_type"))
        .otherwise(F.concat(F.lit("St. "), F.col("p_name"), F.lit("  ("), F.col("p_type"), F.lit(")")))
    )


@query(
    "area_name_key",
    rf"""SELECT p_partkey, array_to_string(list_transform(string_split(trim(regexp_replace(regexp_replace(replace(lower({_AREA_NAMES_SQL}), '&', 'and'),
  '\p{{P}}', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS area_key FROM part""",
)
def _(t):
    return t.part.select("p_partkey", area_name_key(_area_names()).alias("area_key"))


@query(
    "crosswalk",
    """SELECT c_custkey, CASE WHEN n_nationkey % 2 = 0 THEN 'Area ' || n_nationkey ELSE n_name END AS n_name
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def _(t):
    named = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    entries = t.nation.where(F.col("n_nationkey") % 2 == 0).select(
        F.col("n_name").alias("from_name"), F.concat(F.lit("Area "), F.col("n_nationkey").cast("string")).alias("to_name")
    )
    return apply_crosswalk(named, "n_name", entries)


@query(
    "wide_to_long",
    """SELECT p_partkey, 'Species_a' AS species_column, p_brand AS species_detection FROM part
UNION ALL SELECT p_partkey, 'species_b', p_type FROM part
UNION ALL SELECT p_partkey, 'SPECIES_c', p_name FROM part WHERE p_size % 4 <> 0""",
)
def _(t):
    wide = t.part.select(
        "p_partkey", F.col("p_brand").alias("Species_a"), F.col("p_type").alias("species_b"),
        F.when(F.col("p_size") % 4 == 0, "").otherwise(F.col("p_name")).alias("SPECIES_c"),
    )
    return lengthen(wide, "species", "species_column", "species_detection")


@query(
    "long_to_wide",
    """SELECT p_type, min(p_retailprice) FILTER (p_brand = 'Brand#1') AS first_a, min(p_retailprice) FILTER (p_brand = 'Brand#2') AS first_b,
  NULL::DOUBLE AS first_none FROM part WHERE p_brand IN ('Brand#1', 'Brand#2') GROUP BY 1""",
)
def _(t):
    focal = t.part.where(F.col("p_brand").isin("Brand#1", "Brand#2"))
    names = {"Brand#1": "first_a", "Brand#2": "first_b", "nobody": "first_none"}
    return widen(focal, ["p_type"], "p_brand", names, F.min("p_retailprice"))


@query(
    "first_by_category",
    """SELECT o_custkey, first_urgent, first_low, first_year, last_year FROM (SELECT o_custkey,
  min(year(o_orderdate)) FILTER (o_orderpriority = '1-URGENT') AS first_urgent, min(year(o_orderdate)) FILTER (o_orderpriority = '5-LOW') AS first_low,
  min(year(o_orderdate)) AS first_year, max(year(o_orderdate)) AS last_year FROM orders GROUP BY 1)""",
)
def _(t):
    dated = t.orders.select("o_custkey", "o_orderpriority", F.year("o_orderdate").alias("year"))
    focal = {"1-URGENT": "first_urgent", "5-LOW": "first_low"}
    return first_by_category(dated, ["o_custkey"], "o_orderpriority", focal, "year").join(
        first_last(dated, ["o_custkey"], "year"), "o_custkey"
    )


_CODES_SQL = """CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_partkey % 9 = 1 THEN '' WHEN p_partkey % 9 = 2 THEN p_size || ', x'
  ELSE p_size || ', ' || (p_size + 40) || ',' || p_size END"""


@query(
    "codes_exploded",
    f"""WITH names AS (SELECT CAST(p_size AS DOUBLE) AS code, min(p_type) AS common FROM part GROUP BY 1),
rows AS (SELECT p_partkey, try_cast(trim(unnest(coalesce(string_split({_CODES_SQL}, ','), [NULL]))) AS DOUBLE) AS code FROM part)
SELECT p_partkey, upper(common[1]) || lower(common[2:]) AS common_name FROM rows LEFT JOIN names ON rows.code = names.code""",
)
def _(t):
    key, size = F.col("p_partkey") % 9, F.col("p_size").cast("string")
    codes = (
        F.when(key == 0, F.lit(None).cast("string")).when(key == 1, "").when(key == 2, F.concat(size, F.lit(", x")))
        .otherwise(F.concat(size, F.lit(", "), (F.col("p_size") + 40).cast("string"), F.lit(","), size))
    )
    names = t.part.groupBy(F.col("p_size").cast("double").alias("species_code")).agg(F.min("p_type").alias("common_name"))
    return decode_species(t.part.select("p_partkey", codes.alias("codes")), "codes", names)


@query(
    "ddmm_degrees",
    """SELECT o_orderkey, round(floor(v / 100) + (v - floor(v / 100) * 100) / 60, 6) AS degrees FROM
(SELECT o_orderkey, (o_totalprice % 9000) * CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS v FROM orders)""",
)
def _(t):
    packed = F.col("o_totalprice") % 9000 * F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1)
    return t.orders.select("o_orderkey", F.round(ddmm_to_degrees(packed), 6).alias("degrees"))


@query("west_longitude", "SELECT c_custkey, -(c_acctbal / 60) AS always, -abs(c_acctbal / 60) AS if_positive FROM customer")
def _(t):
    lon = F.col("c_acctbal") / 60
    return t.customer.select("c_custkey", west(lon).alias("always"), west(lon, "if_positive").alias("if_positive"))


@query(
    "parsed_dates",
    """WITH texts AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN 'n/a' ELSE
  strftime(o_orderdate, '%-d-%b-') || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') END AS two,
  CASE WHEN o_orderkey % 10 = 4 THEN 'unknown' ELSE strftime(o_orderdate, '%d %b %Y') END AS four FROM orders),
days AS (SELECT o_orderkey, try_strptime(two, '%-d-%b-%y') AS d, try_strptime(four, '%d %b %Y') AS f FROM texts),
fixed AS (SELECT o_orderkey, CASE WHEN year(d) > 2025 THEN d - INTERVAL 100 YEAR ELSE d END AS d, f FROM days)
SELECT o_orderkey, strftime(d, '%Y-%m-%d') AS two_digit_day, year(d) AS two_digit_year, CAST(floor(year(d) / 10) * 10 AS INT) AS decade,
  strftime(f, '%Y-%m-%d') AS four_digit_day, year(f) || '-01-01' AS january FROM fixed""",
)
def _(t):
    key = F.col("o_orderkey")
    two = F.when(key % 10 == 3, "n/a").otherwise(
        F.concat(F.date_format("o_orderdate", "d-MMM-"), F.lpad((key % 100).cast("string"), 2, "0"))
    )
    four = F.when(key % 10 == 4, "unknown").otherwise(F.concat(F.date_format("o_orderdate", "dd MMM yyyy"), F.lit(" (noon)")))
    days = t.orders.select("o_orderkey", to_day(two, "d-MMM-yy").alias("d"), to_day(four).alias("f"))
    return days.select(
        "o_orderkey", F.col("d").cast("string").alias("two_digit_day"), F.year("d").alias("two_digit_year"),
        decade(F.year("d")).alias("decade"), F.col("f").cast("string").alias("four_digit_day"),
        first_of_january(F.year("f")).cast("string").alias("january"),
    )


@query(
    "column_profile",
    " UNION ALL ".join(
        f"SELECT round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75, '{c}' AS \"column\", count(*) AS n, count(*) - count({c}) AS n_null, CAST(min({c}) AS DOUBLE) AS minimum, "
        f"round(avg({c}), 4) AS mean, CAST(max({c}) AS DOUBLE) AS maximum FROM ({SITES_SQL})"
        for c in ("surface_area_ha", "volume_m3", "max_depth_m")
    ),
)
def _(t):
    profile = column_profile(sites(t), ["surface_area_ha", "volume_m3", "max_depth_m"], (0.25, 0.5, 0.75), exact=True)
    return profile.withColumns({c: F.round(c, 4) for c in ("mean", "q25", "q50", "q75")})


@query(
    "record_ids",
    """SELECT l_returnflag, l_linestatus, l_quantity, CAST(row_number() OVER (PARTITION BY l_returnflag, l_linestatus, l_quantity) AS VARCHAR) AS copy,
  sha256('{"l_returnflag":"' || l_returnflag || '","l_linestatus":"' || l_linestatus || '","l_quantity":' || l_quantity || '}') AS digest FROM lineitem""",
)
def _(t):
    marked = with_record_id(t.lineitem.select("l_returnflag", "l_linestatus", "l_quantity"))
    parts = F.split("record_id", "-")
    return marked.select(
        "l_returnflag", "l_linestatus", "l_quantity", parts[1].alias("copy"), parts[0].alias("digest")
    )


@query(
    "blank_values",
    """SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment, nullif(c_nationkey, 3) AS nation,
  'NA' || '_' || coalesce(nullif(c_mktsegment, 'BUILDING'), 'NA') AS pasted, try_cast(c_name AS DOUBLE) AS number, abs(length(c_name) - length(c_mktsegment)) AS gap FROM customer""",
)
def _(t):
    segment = F.when(F.col("c_mktsegment") == "BUILDING", " ").otherwise(F.col("c_mktsegment"))
    rows = t.customer.select(
        "c_custkey", segment.alias("segment"), F.col("c_nationkey").alias("nation"), to_number(F.col("c_name")).alias("number"),
        length_gap(F.col("c_name"), F.col("c_mktsegment")).alias("gap"),
    )
    clean = sentinel_to_null(blank_to_null(rows, ["segment"]), "nation", 3)
    return clean.withColumn("pasted", paste(F.lit(None), F.col("segment"), sep="_"))


@query("reordered_columns", "SELECT c_custkey AS custkey, c_mktsegment AS mkt_segment, c_name AS name, c_nationkey AS nation FROM customer")
def _(t):
    raw = t.customer.select(
        F.col("c_custkey").alias("X"), F.col("c_custkey").alias("Custkey"), F.col("c_name").alias("Name."),
        F.col("c_nationkey").alias("NATION"), F.col("c_acctbal").alias("Acct..Bal"), F.col("c_mktsegment").alias("Mkt.Segment"),
    )
    named = canonical_columns(drop_index_column(raw))
    return relocate(select_span(named, ("custkey", "nation"), "mkt_segment"), ["mkt_segment"], before="name")


@query(
    "overlay_coords",
    """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN s_acctbal ELSE c_acctbal END AS balance
FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey * 2""",
)
def _(t):
    main = t.customer.select("c_custkey", F.col("c_acctbal").alias("balance"))
    other = t.supplier.select((F.col("s_suppkey") * 2).alias("key"), F.col("s_acctbal").alias("balance"))
    return overlay(main, other, {"c_custkey": "key"}, ["balance"], F.col("c_custkey") % 2 == 0)


@query(
    "delimited_round_trip",
    """SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS name,
  CASE WHEN c_nationkey = 5 THEN NULL ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS balance FROM customer""",
)
def _(t):
    key = F.col("c_custkey")
    out = t.customer.select(
        key.alias("key"), F.when(key % 3 != 0, F.col("c_name")).alias("name"),
        F.when(F.col("c_nationkey") == 5, "").otherwise(F.col("c_mktsegment")).alias("segment"),
        F.when(key % 4 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string")).alias("balance"),
    )
    path = scratch_path(t.spark, "delimited")
    write_table(out, path)
    return read_table(t.spark, path, "key long, name string, segment string, balance double")


_QUOTED_SQL = """c_name || ', \"' || c_mktsegment || '\"' || CASE WHEN c_custkey % 2 = 0 THEN chr(10) || 'second; line ' ELSE '' END"""


@query("delimited_quoted", f"SELECT c_custkey AS key, {_QUOTED_SQL} AS comment, ' ' || c_name AS name, CAST(c_acctbal AS DOUBLE) AS balance, CAST(NULL AS VARCHAR) AS malformed FROM customer")
def _(t):
    second = F.when(F.col("c_custkey") % 2 == 0, "\nsecond; line ").otherwise("")
    comment = F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"'), second)
    path = scratch_path(t.spark, "delimited")
    write_table(t.customer.select(F.col("c_custkey").alias("key"), comment.alias("comment"), F.concat(F.lit(" "), "c_name").alias("name"), F.col("c_acctbal").alias("balance")), path)
    return read_table(t.spark, path, "key long, comment string, name string, balance double", multi_line=True, malformed="malformed")


@query(
    "delimited_by_header",
    """SELECT c_custkey AS site_code, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS name, c_mktsegment AS county, c_acctbal AS surface_area_ha FROM customer""",
)
def _(t):
    key = F.col("c_custkey")
    # Dotted and capital names, other columns, another order than the declared one.
    out = t.customer.select(
        F.col("c_nationkey").alias("X"), F.col("c_acctbal").alias("Surface.Area..ha."), F.when(key % 3 != 0, F.col("c_name")).alias("Name"),
        F.lit("unused").alias("Notes: any"), key.alias("Site.Code"), F.col("c_mktsegment").alias("COUNTY"),
    )
    path = scratch_path(t.spark, "delimited")
    write_table(out, path)
    return read_table(t.spark, path, "county string, site_code long, name string, surface_area_ha double")


@query("top_n", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(t):
    return top_n(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 25)
