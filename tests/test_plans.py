"""Whole jobs on small fixtures: status rules, matching, masters, layers."""

import datetime
import itertools
import xml.dom.minidom
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tarnbook.catalog import masters
from tarnbook.operators.polygons import spatial_join
from tarnbook.plans import harmonise as lists
from tarnbook.plans import layers, master, match
from tarnbook.plans.status import (
    WATCHED,
    area_first,
    area_status,
    combined_status,
    enrich_catches,
    site_status,
    status_crosstab,
    with_status,
)
from tarnbook.session import bounded_tasks
from tarnbook.sources import schemas
from tarnbook.sources.layers import as_layer

SMB, CP = WATCHED.a, WATCHED.b
SITE = ["county", "name", "site_code", "primary_watershed"]
DETECTION = "county string, name string, site_code int, primary_watershed string, species_name string, year int, database string"


def status_of(spark, rows, rules):
    df = spark.createDataFrame(rows, DETECTION)
    found = site_status(df, SITE, "primary_watershed", "species_name", "year", rules=rules)
    return {r.name: r.site_status for r in found.collect()}


def seen(name, species, year, watershed="W", county="C", code=1, database="main"):
    return (county, name, code, watershed, species, year, database)


P, A, D = "Present", "Absent", "Data insufficient"
V2 = {
    (P, P): "Both", (P, A): "Smallmouth Bass only", (P, D): "Smallmouth Bass only", (A, P): "Chain Pickerel only",
    (D, P): "Chain Pickerel only", (A, A): "No AIS", (A, D): "No SMB_CP unknown", (D, A): "No CP_SMB_unknown", (D, D): "Unknown",
}
V3 = {**V2, (P, D): "SMB Present_CP unknown", (D, P): "CP Present_SMB unknown"}


@pytest.mark.parametrize("rules, table", [("v2", V2), ("v3", V3)])
def test_all_pairs_of_species_states(spark, rules, table):
    df = spark.createDataFrame([(a, b, want) for (a, b), want in table.items()], "a string, b string, want string")
    got = df.withColumn("got", combined_status(F.col("a"), F.col("b"), WATCHED, rules)).collect()
    assert all(r.got == r.want for r in got)
    assert set(table.values()) == set(WATCHED.labels(rules))


def test_absence_needs_a_visit_after_arrival(spark):
    rows = [
        seen("invaded", SMB, 2000), seen("later", "Perch", 2000), seen("earlier", "Perch", 1999), seen("undated", "Perch", None),
        seen("elsewhere", "Perch", 1980, "clean"), seen("nowhere", "Perch", 1980, None),
    ]
    v3 = status_of(spark, rows, "v3")
    assert v3 == {
        "invaded": "Smallmouth Bass only", "later": "No AIS", "earlier": "No CP_SMB_unknown", "undated": "No CP_SMB_unknown",
        "elsewhere": "No AIS", "nowhere": "No AIS",
    }
    v1 = status_of(spark, rows, "v1")
    assert v1 == {
        "invaded": "Smallmouth Bass only", "later": "No AIS", "earlier": "Unknown / insufficient data",
        "undated": "Unknown / insufficient data", "elsewhere": "Unknown / insufficient data", "nowhere": "Unknown / insufficient data",
    }


def test_undated_detection_spoils_absence_only_in_v2(spark):
    rows = [seen("x", SMB, None), seen("y", "Perch", 2010)]
    assert status_of(spark, rows, "v2")["y"] == "No CP_SMB_unknown"
    assert status_of(spark, rows, "v3")["y"] == "No AIS"
    assert status_of(spark, rows, "v1")["y"] == "Unknown / insufficient data"


def test_detections_without_watershed(spark):
    rows = [seen("x", SMB, 2000, None), seen("y", "Perch", 1990, None)]
    assert status_of(spark, rows, "v3")["y"] == "No AIS"  # no watershed, no arrival
    assert status_of(spark, rows, "v2")["y"] == "No CP_SMB_unknown"  # all sites without one form a watershed


def test_sites_without_code_or_watershed_stay_together(spark):
    rows = [("C", "x", None, None, "Perch", 1990, "main"), ("C", "x", None, None, SMB, 1995, "records"), (None, "x", None, None, SMB, 1, "main")]
    df = spark.createDataFrame(rows, DETECTION)
    found = site_status(df, SITE, "primary_watershed", "species_name", "year", source=("database", "main", "records")).collect()
    assert sorted((r.county or "-", r.last_sampled_year, r.data_source) for r in found) == [("-", 1, "main Only"), ("C", 1995, "Both")]


def test_area_first_agrees_with_the_sites(spark):
    rows = [seen("a", SMB, 2000), seen("b", SMB, 1990), seen("c", CP, None), seen("d", CP, 1980, None)]
    df = spark.createDataFrame(rows, DETECTION)
    found = {r.primary_watershed: (r.ws_first_a, r.ws_first_b, r.ws_seen_b) for r in area_first(df, "primary_watershed", "species_name", "year").collect()}
    assert found == {"W": (1990, None, True)}
    assert None in {r[0] for r in area_first(df, "primary_watershed", "species_name", "year", rules="v2").select("primary_watershed").collect()}


def expected_area(labels, rules):
    got = set(labels)
    if "Both" in got or {"Smallmouth Bass only", "Chain Pickerel only"} <= got:
        return "Both"
    for label in ("Chain Pickerel only", "Smallmouth Bass only"):
        if label in got:
            return label
    if rules == "map":
        return "Unknown / insufficient data" if "Unknown / insufficient data" in got else "No AIS"
    return "No AIS" if got == {"No AIS"} else "Unknown"


@pytest.mark.parametrize("rules", ["v3", "map"])
def test_area_rules_over_all_pairs_of_statuses(spark, rules):
    labels = WATCHED.labels("v1" if rules == "map" else "v3")
    groups = [(label,) for label in labels] + list(itertools.combinations_with_replacement(labels, 2))
    df = spark.createDataFrame([(i, label) for i, g in enumerate(groups) for label in g], "area int, site_status string")
    found = {r.area: r.area_status for r in area_status(df, "area", rules).collect()}
    assert found == {i: expected_area(g, rules) for i, g in enumerate(groups)}


def test_partial_statuses_count_on_request(spark):
    df = spark.createDataFrame([("W", "SMB Present_CP unknown"), ("W", "No AIS")], "area string, site_status string")
    assert area_status(df, "area").first().area_status == "Unknown"
    assert area_status(df, "area", count_partial=True).first().area_status == "Smallmouth Bass only"


def test_crosstab_has_every_status(spark):
    df = spark.createDataFrame([("W", "Both"), (None, "Both")], "area string, site_status string")
    row = status_crosstab(df, "area").collect()
    assert len(row) == 1 and row[0]["Both"] == 1 and row[0]["No AIS"] == 0


def test_enriching_keeps_both_visits_of_a_day(spark):
    keys = ["county", "name"]
    catches = spark.createDataFrame([("C", "x", "12 Jul 1986", "Perch"), ("C", "y", "bad", "Perch"), (None, "x", "1 Jan 1990", "Perch")], "county string, name string, captured_date_raw string, species_name string")
    sites = spark.createDataFrame([("C", "x", "12 Jul 1986", 1.0), ("C", "x", "12 Jul 1986", 2.0), (None, "x", "1 Jan 1990", 3.0)], "county string, name string, assessment_date_raw string, surface_area_ha double")
    rows = enrich_catches(catches, sites, keys)
    assert rows.columns[:5] == ["county", "name", "captured_date_raw", "date", "year"]
    assert sorted((r.year or 0, r.surface_area_ha or 0) for r in rows.collect()) == [(0, 0), (1986, 1.0), (1986, 2.0), (1990, 3.0)]


def test_with_status(spark):
    df = spark.createDataFrame([seen("x", SMB, 2000), seen("x", "Perch", 2001)], DETECTION)
    status = site_status(df, SITE, "primary_watershed", "species_name", "year")
    rows = with_status(df, status, SITE).collect()
    assert len(rows) == 2 and {r.site_status for r in rows} == {"Smallmouth Bass only"}


# --- matching ----------------------------------------------------------------------------------------


def test_records_are_brought_to_one_shape(spark):
    utm = spark.createDataFrame([("NS", "St. Ann Lake", "queens", "1999", 500000.0, 4982950.4, "20"), ("NB", "Other", "x", "1", 1.0, 1.0, "19")], schemas.RECORDS_UTM)
    lonlat = spark.createDataFrame([("Big River", "", "unknown", "20", 45.0, -63.0)], schemas.RECORDS_LONLAT)
    rows = sorted(match.prepare_records(utm, lonlat).collect(), key=lambda r: r.name)
    assert [(r.species_name, r.name, r.county, r.year) for r in rows] == [(SMB, "BIG", None, None), (CP, "ST ANN", "Queens", 1999)]
    assert rows[1].lon == pytest.approx(-63) and rows[1].lat == pytest.approx(45, abs=1e-7)
    assert rows[0].easting == pytest.approx(500000) and rows[0].northing == pytest.approx(4982950.4, abs=1e-3)


TARGETS = [
    (1, "Queens", 11, "MORRIS", "W1", "c1", 0.0, 0.0),
    (2, "Queens", 12, "GRAND", "W1", "c1", 10_000.0, 0.0),
    (3, "Kings", 13, "GRAND MEADOWS", "W2", "c2", 20_000.0, 0.0),
]
SITE_DDL = "site_id int, county string, site_code int, name string, primary_watershed string, watershed_code string, easting double, northing double"
RECORD_DDL = "record_id string, species_name string, name string, county string, year int, easting double, northing double"


def matched(spark, records, policy="distance_county", **more):
    r, s = spark.createDataFrame(records, RECORD_DDL), spark.createDataFrame(TARGETS, SITE_DDL)
    return match.match(r, s, policy, **more)


RECORDS = [
    ("r1", SMB, "BANOOK", "Queens", 2001, 0.0, 100.0),
    ("r2", SMB, "X", None, 2002, 0.0, 300.0),
    ("r3", CP, "Y", "Kings", 2003, 10_000.0, 200.0),
    ("r4", CP, "Z", "Queens", None, 10_000.0, 500.0),
    ("r5", CP, "Z", "Queens", 1990, 10_000.0, 501.0),
    ("r6", SMB, "GRAND", "Queens", 1999, 10_000.0, 0.0),
]


def test_every_record_gets_a_band_and_confident_ones_a_decision(spark):
    rows = {r.record_id: r for r in matched(spark, RECORDS).collect()}
    assert {k: r.match_status for k, r in rows.items()} == {
        "r1": "confident", "r2": "review_missing_county", "r3": "review_county_mismatch", "r4": "review_possible_match",
        "r5": "unlikely", "r6": "confident",
    }
    assert rows["r1"].match_decision == "automatic" and rows["r2"].match_decision is None
    assert rows["r5"].site_name == "GRAND"


def test_overrides_cut_all_ties(spark):
    rows = {r.record_id: r for r in matched(spark, RECORDS, overrides=match.overrides_table(spark)).collect()}
    r1 = rows["r1"]
    assert (r1.match_status, r1.match_status_confirmed) == ("review_name_mismatch", "not_a_match")
    assert (r1.site_id, r1.site_code, r1.site_name, r1.site_county, r1.site_watershed_code) == (None,) * 5
    assert rows["r6"].site_code == 12


def decided(spark):
    made = spark.createDataFrame([("r4", "manual", "match"), ("r5", "manual", "not_a_match"), ("gone", "manual", "match")], schemas.DECISIONS)
    return matched(spark, RECORDS, decisions=made, overrides=match.overrides_table(spark))


def test_dedupe_and_identity(spark):
    kept = match.dedupe_records(decided(spark))
    assert {r.record_id for r in kept.collect()} == {"r1", "r2", "r3", "r4", "r5", "r6"}
    ready = {r.record_id: r for r in match.resolve_identity(kept).collect()}
    assert (ready["r4"].name, ready["r4"].site_code, ready["r4"].county) == ("GRAND", 12, "Queens")
    assert (ready["r5"].name, ready["r5"].site_code, ready["r5"].watershed_code) == ("Z", None, None)


@pytest.mark.parametrize("keep, winner", [("latest", "b"), ("earliest", "a")])
def test_one_record_per_identity(spark, keep, winner):
    rows = [("a", 1990), ("b", 2000), ("c", None), ("d", 2000)]
    df = spark.createDataFrame([(i, SMB, "N", None, y, None, None) for i, y in rows], "record_id string, species_name string, name string, county string, year int, site_name string, match_status_confirmed string")
    assert [r.record_id for r in match.dedupe_records(df, keep).collect()] == [winner]


def test_policies_by_name(spark):
    records = [("n1", SMB, "GRAND", "Kings", 2000, 0.0, 0.0), ("n2", SMB, "NONE", "Kings", 2000, 0.0, 200.0), ("n3", SMB, "FAR", "Kings", 2000, 0.0, 201.0)]
    rows = {r.record_id: r for r in matched(spark, records, "name_all").collect()}
    assert {k: (r.site_id, r.matched_by) for k, r in rows.items()} == {"n1": (3, "name"), "n2": (1, "distance")}
    best = {r.record_id: r.site_id for r in matched(spark, records, "name_best").collect()}
    assert best == {"n1": 3, "n2": 1}


# --- masters -----------------------------------------------------------------------------------------


def master_inputs(spark):
    sites = spark.createDataFrame(
        [("Queens", "GRAND", 12, "W1", 1, None, 5.0, -63.0, 45.0), ("Queens", "GRAND", 12, "W1", 2, 7.0, 6.0, -63.2, 45.2)],
        "county string, name string, site_code int, primary_watershed string, site_id int, volume_m3 double, max_depth_m double, lon double, lat double",
    )
    catches = spark.createDataFrame(
        [("Queens", "GRAND", 12, "W1", "c1", SMB, 1999, "main", -64.0, 46.0, "k1"), ("Queens", "POND", None, None, None, "Perch", 2001, "main", -65.0, 44.0, "k2")],
        "county string, name string, site_code int, primary_watershed string, watershed_code string, species_name string, year int, database string, lon double, lat double, row_id string",
    )
    records = spark.createDataFrame(
        [("Queens", "GRAND", 12, "W1", "c1", CP, 2005, "records", "r1", -60.0, 44.0), ("Kings", "Z", None, None, None, CP, 2006, "records", "r2", -61.0, 45.5)],
        "county string, name string, site_code int, primary_watershed string, watershed_code string, species_name string, year int, database string, record_id string, lon double, lat double",
    )
    return sites, catches, records


def built_master(spark):
    sites, catches, records = master_inputs(spark)
    return master.site_master(match.with_records(catches, records), sites, catches, records, morphology=["volume_m3", "max_depth_m"])


def test_site_master(spark):
    rows = {r.name: r for r in built_master(spark).collect()}
    grand, pond, z = rows["GRAND"], rows["POND"], rows["Z"]
    assert (grand.site_status, grand.data_source, grand.ws_status, grand.county_status) == ("Both", "Both", "Both", "Both")
    assert (grand.volume_m3, grand.max_depth_m) == (7.0, 5.0)
    assert (grand.lon, grand.lat) == (pytest.approx(-63.1), pytest.approx(45.1))
    assert (pond.lon, pond.data_source, pond.site_status) == (-65.0, "main Only", "No AIS")
    assert (z.lon, z.lat, z.data_source, z.ws_status) == (-61.0, 45.5, "records Only", "Chain Pickerel only")


def test_a_master_stores_what_it_is_made_from(spark, monkeypatch):
    """Line ids and dates as text are the widest columns of all catches, and no master reads them."""
    tables = SimpleNamespace(
        spark=spark,
        region=spark.createDataFrame([(1, "C")], "r_regionkey int, r_name string"),
        nation=spark.createDataFrame([(2, "N", 1)], "n_nationkey int, n_name string, n_regionkey int"),
        customer=spark.createDataFrame([(5, "x", 2, 1.5, "M")], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        orders=spark.createDataFrame([(7, 5, 9.0, datetime.datetime(1998, 2, 6), "5-LOW")], "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
        part=spark.createDataFrame([(3, "Brand#1")], "p_partkey long, p_brand string"),
        lineitem=spark.createDataFrame([(7, 3, 4, 1)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int"),
    )
    stored = []
    monkeypatch.setattr(masters, "cut_lineage", lambda df: stored.append(df.columns) or df)
    second = spark.createDataFrame([], "county string, site_code long, name string, primary_watershed string, watershed_code string, species_name string, year int, database string, record_id string, x double, y double")
    row = masters._master(tables, second).first()
    assert (row.name, row.first_a, row.volume_m3, row.data_source) == ("x 5-LOW", 1998, 9.0, "main Only")
    assert len(stored) == 2 and not {"row_id", "captured_date_raw", "assessment_date_raw"} & {c for columns in stored for c in columns}


def test_community_list(spark):
    sites, catches, records = master_inputs(spark)
    dated = catches.withColumn("date", F.make_date("year", F.lit(7), F.lit(1)))
    rows = master.community_list(dated, built_master(spark), records).collect()
    assert len(rows) == 4
    mine = {(r.name, r.database): (str(r.date), r.site_status) for r in rows}
    assert mine[("GRAND", "main")] == ("1999-07-01", "Both") and mine[("Z", "records")] == ("2006-01-01", None)
    too = master.community_list(dated, built_master(spark), records, records_too=True).collect()
    assert {r.site_status for r in too if r.name == "Z"} == {"Chain Pickerel only"}


def test_site_species_year(spark):
    sites, catches, records = master_inputs(spark)
    again = catches.unionByName(catches.withColumn("row_id", F.lit("k0")).withColumn("database", F.lit("other")))
    status = site_status(match.with_records(catches, records), SITE, "primary_watershed", "species_name", "year", rules="v2")
    rows = {(r.name, r.species_name): r for r in master.site_species_year(again, records, sites, status).collect()}
    assert rows[("GRAND", SMB)].database == "main+other" and rows[("GRAND", SMB)].lon == -63.0
    assert rows[("GRAND", CP)].database == "records" and rows[("GRAND", CP)].lon == -60.0
    assert rows[("GRAND", CP)].site_status == "Both"


def test_map_document_is_well_formed(spark, tmp_path):
    full = built_master(spark).withColumn("name", F.concat("name", F.lit(" <&> ]]> end")))
    full = full.withColumn("county", F.when(F.col("county") == "Kings", F.lit(None)).otherwise(F.lit("A & B")))
    path = tmp_path / "kml"
    master.write_nested_export(full, str(path))
    text = "".join(p.read_text() for p in sorted(path.glob("part-*")))
    doc = xml.dom.minidom.parseString(text)
    assert len(doc.getElementsByTagName("Placemark")) == 3
    folders = [f.getElementsByTagName("name")[0].firstChild.data for f in doc.getElementsByTagName("Folder")]
    assert folders[0] == "A & B" and "Unknown_County" in folders and "Both" in folders
    outer = [n for n in doc.getElementsByTagName("Document")[0].childNodes if n.nodeName == "Folder"]
    assert len(outer) == 2


# --- layers ------------------------------------------------------------------------------------------


def test_decimal_sites_and_long_detections(spark):
    df = spark.createDataFrame([("4430", "6330", "Perch", ""), ("4430", "n/a", "Perch", "Bass")], "latitude string, longitude string, Species1 string, SPECIES_2 string")
    rows = layers.long_detections(df).collect()
    assert [(r.species_detection, r.latitude_dec, r.longitude_dec) for r in rows] == [("Perch", 44.5, -63.5)]


def test_first_detection(spark):
    df = spark.createDataFrame(
        [("L", 1, SMB, "1-Jul-86"), ("L", 1, SMB, "1-Jul-79"), ("L", 2, SMB, "junk"), ("L", 1, "Perch", "1-Jul-50")],
        "name string, code int, species string, date string",
    )
    rows = sorted((r.code, r.first_year or 0, r.decade_of_first or 0, r.decade_rank or 0) for r in layers.first_detection(df, ["name", "code"], "species", "date").collect())
    assert rows == [(1, 1979, 1970, 1), (1, 1979, 1970, 1), (2, 0, 0, 0)]


def test_richness_and_focal_layer(spark):
    df = spark.createDataFrame([(1.0, 1.0, SMB), (1.0, 1.0, "Perch"), (2.0, 2.0, "Perch")], "lat double, lon double, sp string")
    layer = layers.richness_layer(df, ["lat", "lon"], "sp")
    assert sorted(r.unique_species_count for r in layer.collect()) == [1, 2, 2]
    assert [r["break"] for r in layers.richness_breaks(layer).collect()] == [0]
    assert layers.focal_layer(df, "sp", window={"xmin": 0, "xmax": 5, "ymin": 0, "ymax": 5}, xy=("lon", "lat")).count() == 1


def test_shortlist_border(spark):
    df = spark.createDataFrame([("a", 99.9), ("b", 100.0), ("c", 100.1), ("a", 50.0)], "k string, area double")
    assert {r.k for r in layers.shortlist(df, ["k"], "area").collect()} == {"a"}
    assert {r.k for r in layers.shortlist(df, ["k"], "area", inclusive=True).collect()} == {"a", "b"}


def test_decoded_species(spark):
    df = spark.createDataFrame([(44.0, -63.0, "3,17")], schemas.CODED_SITES)
    codes = spark.createDataFrame([(3.0, "brook TROUT", "S. f."), (17.0, "EEL", "A. r.")], schemas.SPECIES_CODES)
    rows = layers.decode_species(df, "fish_species", codes)
    assert "fish_species" not in rows.columns
    assert sorted(r.common_name for r in rows.collect()) == ["Brook Trout", "Eel"]


def square(name, x, y, size=10.0):
    return (name, [[{"x": a, "y": b} for a, b in ((x, y), (x + size, y), (x + size, y + size), (x, y + size))]])


def test_coverage_report(spark):
    layer = as_layer(spark.createDataFrame([square("a", 0.0, 0.0), square("b", 100.0, 100.0)], "layer_id string, rings array<array<struct<x:double,y:double>>>"))
    points = spark.createDataFrame([("p", 5.0, 5.0), ("p", 50.0, 50.0), ("q", 60.0, 60.0), (None, 61.0, 61.0)], "site string, x double, y double")
    report = {r.measure: r.n for r in layers.coverage_report(layer, points, ["site"]).collect()}
    assert report == {"polygons_total": 2, "polygons_sampled": 1, "sites_total": 3, "sites_unlocated": 2}
    assert {r.layer_id for r in spatial_join(layer, points, "semi").collect()} == {"a"}


def test_decade_and_effort_layers(spark):
    df = spark.createDataFrame([(SMB, 1979, 500000.0, 4982950.4), (CP, None, 500000.0, 4982950.4), ("Perch", 1990, 1.0, 1.0)], "sp string, year int, easting double, northing double")
    placed = layers.decade_layers(df, "sp")
    rows = {r.sp: r for r in placed.collect()}
    assert rows[SMB].decade == "1970s" and rows[SMB].longitude == pytest.approx(-63) and rows[CP].decade is None
    split = layers.species_layers(placed, "sp")
    assert split[SMB].count() == 1 and split[CP].count() == 1
    effort = spark.createDataFrame([(500000.0, 4982950.4, 3), (None, 4982950.4, 4), (500000.0, 1e6, 5)], schemas.EFFORT)
    assert [(r.resample_count, r.longitude) for r in layers.effort_layer(effort).collect()] == [(3, -63.0)]
    assert layers.category_layer(placed, "sp", "longitude", "latitude").count() == 2


def test_area_names_reconcile(spark):
    areas = spark.createDataFrame([("1", "LAHAVE"), ("2", "ST. MARYS"), ("3", "TUSKET RIVER"), ("4", "MISSAGUASH"), ("5", "COSTAL ISLAND")], "layer_id string, river string")
    status = spark.createDataFrame([("LaHave", "Both"), ("St. Mary's", "No AIS"), ("Tusket", "Unknown"), ("Missaguas", "Both")], "ws string, ws_status string")
    diff, beside = layers.name_report(areas, status, "river", "ws")
    assert diff.count() == 9 and beside.count() == 5
    joined = layers.area_layer(
        areas, status, "river", "ws", layers.crosswalk_table(spark, layers.WATERSHED_NAMES), layers.crosswalk_table(spark, layers.SURVEY_NAMES)
    )
    assert {r.area_key: r.ws_status for r in joined.collect()} == {
        "LaHave": "Both", "St. Mary's": "No AIS", "Tusket": "Unknown", "Missaguash": "Both", "Coastal Island": None,
    }
    assert len(layers.WATERSHED_NAMES) == 26


def test_harmonised_lists(spark):
    lake = spark.createDataFrame([("G", "L", "S", "c", 44.0, 63.0, "d1"), ("G", "L", "S", "c", None, 63.0, "d1")], "Group string, LAKE string, Site string, CODE string, Location_Lat double, Location_Lon double, Date string")
    river = spark.createDataFrame([("H", "R", "S", "c", 45.0, None, "d2")], "Group string, RIVER string, Site string, CODE string, Location_Lat double, Location_Lon double, Date string")
    sample = spark.createDataFrame([("I", "M", "T", "e", 46.0, -63.0, "d3")], "Group string, `Lake.Name` string, `Site.Group` string, `Sample.Code` string, Location_Lat double, Location_Lon double, Date string")
    out = lists.harmonise({"a": lake, "b": river, "c": sample}, {"a": lists.LAKE_LIST, "b": lists.RIVER_LIST, "c": lists.SAMPLE_LIST})
    assert out.columns == list(lists.COLUMNS)
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(
        map(str, [("G", "L", None, "S", "c", 44.0, -63.0, "d1"), ("H", None, "R", "S", "c", 45.0, None, "d2"), ("I", "M", None, "T", "e", 46.0, -63.0, "d3")])
    )


def test_places_of_sites_are_dealt_before_they_are_reduced(spark):
    """A file of many sites is not one task's hash table; repeated visits and null keys count as before."""
    sites = spark.createDataFrame([("a", 1.0, 2.0)] * 3 + [("a", 3.0, 4.0), (None, 5.0, 6.0), ("b", None, 1.0)], "name string, lon double, lat double")
    catches = spark.createDataFrame([("a", 9.0, 9.0), ("b", 7.0, 8.0), ("b", 7.0, 8.0), ("c", 1.0, 1.0)], "name string, lon double, lat double")
    found = master.site_coordinates(sites, catches, keys=["name"])
    assert {tuple(r) for r in found.collect()} == {("a", 2.0, 3.0), (None, 5.0, 6.0), ("b", 7.0, 1.0), ("c", 1.0, 1.0)}
    assert "RebalancePartitions" in found._jdf.queryExecution().optimizedPlan().toString()


def test_tasks_stay_bounded_with_few_shuffle_partitions(spark):
    names = ["spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"]
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        bounded_tasks(spark)
        assert [spark.conf.get(n) for n in names] == ["200", "16m", "16m"]
    finally:
        for n, value in before.items():
            spark.conf.unset(n) if value is None else spark.conf.set(n, value)


@pytest.mark.parametrize("third", [False, True])
def test_site_species_year_joins_databases_and_sorts_by_a_hash(spark, third):
    """One or two databases need no set; with a third all are listed.  Null databases are left out."""
    catches = spark.createDataFrame(
        [("1", "a", "w", "c", "Smallmouth Bass", 2001, "main", "x"), ("2", "a", "w", "c", "Smallmouth Bass", 2001, None, "y"), ("3", None, "w", "c", "Eel", None, None, "z"), *[("4", "a", "w", "c", "Smallmouth Bass", 2001, "other", "v")] * third],
        "row_id string, name string, primary_watershed string, county string, species_name string, year int, database string, note string",
    )
    matched = spark.createDataFrame([(5, "a", "w", "c", "Smallmouth Bass", 2001, "records", 1.0, 2.0)], "record_id long, name string, primary_watershed string, county string, species_name string, year int, database string, lon double, lat double")
    sites = spark.createDataFrame([(1, "a", "w", "c", 3.0, 4.0)], "site_id long, name string, primary_watershed string, county string, lon double, lat double")
    keys = ["county", "name", "primary_watershed"]
    status = site_status(catches, keys, "primary_watershed", "species_name", "year", rules="v2")
    found = master.site_species_year(catches.withColumns({c: F.lit(0.0) for c in ("lon", "lat")}), matched, sites, status, keys)
    got = {(r["name"], r["year"]): (r["database"], r["note"], r["lon"], r["lat"]) for r in found.collect()}
    assert got == {("a", 2001): ("main+other+records" if third else "main+records", "x", 3.0, 4.0), (None, None): ("", "z", None, None)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" in plan and ("collect_set" in plan) == third


def test_site_species_year_moves_rows_once_and_without_names(spark):
    """Rows go to their site's number and stay; nulls are told apart by their column, and sites without a status keep their rows."""
    kind = "row_id string, name string, primary_watershed string, county string, species_name string, year int, database string, note string"
    rows = [("1", "a", "w", None, "Eel", 2001, "main", "x"), ("2", None, "w", "a", "Eel", 2001, "main", "y"), ("3", "a", "w", None, "Eel", 2001, "main", "z"), ("4", "b", None, "c", "Eel", None, "main", "v")]
    catches = spark.createDataFrame(rows, kind).withColumns({c: F.lit(0.0) for c in ("lon", "lat")})
    matched = spark.createDataFrame([(5, "a", "w", None, "Eel", 2002, "records", 1.0, 2.0)], "record_id long, name string, primary_watershed string, county string, species_name string, year int, database string, lon double, lat double")
    sites = spark.createDataFrame([(2, "a", "w", None, 3.0, 4.0), (1, "a", "w", None, 5.0, 6.0), (3, None, "w", "a", 7.0, 8.0)], "site_id long, name string, primary_watershed string, county string, lon double, lat double")
    keys = ["county", "name", "primary_watershed"]
    status = site_status(catches.where("row_id <> '4'"), keys, "primary_watershed", "species_name", "year", rules="v2")
    found = master.site_species_year(catches, matched, sites, status, keys)
    assert found.columns == [*keys, "species_name", "year", "note", "lon", "lat", "status_a", "status_b", "site_status", "ws_status", "county_status", "database"]
    moved = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    got = sorted((str(r["county"]), str(r["name"]), str(r["year"]), r["note"], r["lon"], r["lat"], r["site_status"] is None, r["database"]) for r in found.collect())
    assert got == [
        ("None", "a", "2001", "x", 5.0, 6.0, False, "main"), ("None", "a", "2002", None, 1.0, 2.0, False, "records"),
        ("a", "None", "2001", "y", 7.0, 8.0, False, "main"), ("c", "b", "None", "v", None, None, True, "main"),
    ]
    assert moved and not any("species_name" in line for line in moved) and sum("REPARTITION_BY_COL" in line for line in moved) == 1
