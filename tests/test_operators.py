"""Operators on small fixtures, with the traps of missing values, row order and text."""

import math
import os
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tarnbook.functions import dates, geo, numbers, text
from tarnbook.operators import groups, joins, nearest, polygons, review, tidy
from tarnbook.operators.names import name_match, partial_names
from tarnbook.operators.nearest import nearest_join
from tarnbook.operators.points import as_points, crs_of, reproject
from tarnbook.operators.polygons import clip_to_window, covers, ring_edges, spatial_join, with_box
from tarnbook.operators.review import apply_decisions, apply_overrides, review_queue
from tarnbook.operators.similar import proposed_crosswalk, similar_names
from tarnbook.session import cut_lineage, remove_scratch, scratch_path, shared_folder
from tarnbook.sources.layers import as_layer
from tarnbook.sources.schemas import DECISIONS
from tarnbook.sources.tables import read_table, write_table


def values(df, col):
    return [r[0] for r in df.select(col).collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- scalars -----------------------------------------------------------------------------------------


def test_numbers_are_read_tolerantly(spark):
    df = spark.createDataFrame([(" 12.5 ",), ("n/a",), ("",), (None,)], "v string")
    assert values(df, numbers.to_number(F.col("v"))) == [12.5, None, None, None]


@pytest.mark.parametrize("packed, degrees", [(4430.0, 44.5), (4459.4, 44.99), (-4430.0, -45 + 70 / 60), (0.0, 0.0)])
def test_packed_coordinates(spark, packed, degrees):
    assert one(spark, numbers.ddmm_to_degrees(F.lit(packed))) == pytest.approx(degrees)


def test_west(spark):
    df = spark.createDataFrame([(63.5,), (-63.5,), (None,)], "v double")
    assert values(df, numbers.west(F.col("v"))) == [-63.5, 63.5, None]
    assert values(df, numbers.west(F.col("v"), "if_positive")) == [-63.5, -63.5, None]


@pytest.mark.parametrize(
    "raw, fmt, day",
    [
        ("12-Jul-86", "d-MMM-yy", "1986-07-12"),
        ("1-jul-25", "d-MMM-yy", "2025-07-01"),
        ("1-Jul-26", "d-MMM-yy", "1926-07-01"),
        ("1-Jul-68", "d-MMM-yy", "1968-07-01"),
        ("1-Jul-69", "d-MMM-yy", "1969-07-01"),
        ("31-Dec-99", "d-MMM-yy", "1999-12-31"),
        ("12 Jul 1986", "d MMM yyyy", "1986-07-12"),
        ("12 July 1986 10:30", "d MMM yyyy", "1986-07-12"),
        ("31 Feb 1986", "d MMM yyyy", None),
        ("unknown", "d MMM yyyy", None),
        (None, "d MMM yyyy", None),
    ],
)
def test_days(spark, raw, fmt, day):
    found = one(spark, dates.to_day(F.lit(raw).cast("string"), fmt).cast("string"))
    assert found == day


def test_decades_and_century(spark):
    df = spark.createDataFrame([(1979,), (1980,), (None,)], "y int")
    assert values(df, numbers.decade(F.col("y"))) == [1970, 1980, None]
    assert values(df, numbers.decade_label(F.col("y"))) == ["1970s", "1980s", None]
    assert one(spark, numbers.fix_century(F.lit(2086))) == 1986
    assert one(spark, dates.first_of_january(F.lit(1986)).cast("string")) == "1986-01-01"


@pytest.mark.parametrize(
    "raw, key",
    [
        ("St. Mary's Lake", "ST MARYS"),
        ("  Big   Lake River ", "BIG"),
        ("Lakeview", "LAKEVIEW"),
        ("punct $5+", "PUNCT $5+"),
        ("Lac à l'Eau", "LAC À LEAU"),
        (None, None),
    ],
)
def test_site_name_key(spark, raw, key):
    assert one(spark, text.site_name_key(F.lit(raw).cast("string"))) == key


@pytest.mark.parametrize(
    "raw, key",
    [("BARRINGTON/CLYDE", "Barrington Clyde"), ("Salmon & Mira", "Salmon And Mira"), ("ST. MARY'S", "St Mary S")],
)
def test_area_name_key(spark, raw, key):
    assert one(spark, text.area_name_key(F.lit(raw))) == key


def test_title_case_starts_words_after_marks(spark):
    assert one(spark, text.title_case(F.lit("LAKE-OF (woods)"))) == "Lake-Of (Woods)"


def test_paste_prints_missing(spark):
    assert one(spark, text.paste(F.lit("A"), F.lit(None), sep="_")) == "A_NA"


def test_bands_over_all_relations(spark):
    cases = {
        ("same", 0): "confident", ("same", 200): "confident", ("same", 200.1): "review_possible_match",
        ("same", 500): "review_possible_match", ("same", 500.1): "unlikely", ("missing", 0): "review_missing_county",
        ("missing", 300): "review_missing_county", ("missing", 300.1): "unlikely",
        ("different", 200): "review_county_mismatch", ("different", 200.1): "unlikely",
    }
    df = spark.createDataFrame([(k[0], float(k[1]), v) for k, v in cases.items()], "r string, d double, want string")
    got = df.select(geo.match_band(F.col("d"), F.col("r")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_county_relation_takes_blank_for_missing(spark):
    df = spark.createDataFrame([("A", "A"), ("A", "B"), ("", "B"), (None, "B"), ("A", None)], "a string, b string")
    assert values(df, geo.county_relation(F.col("a"), F.col("b"))) == ["same", "different", "missing", "missing", "different"]


def test_utm_round_trip_below_a_millimetre(spark):
    rng = random.Random(1)
    rows = [(rng.uniform(-66.7, -59.5), rng.uniform(43.2, 47)) for _ in range(300)]
    df = spark.createDataFrame(rows, "lon double, lat double")
    e, n = geo.lonlat_to_utm(F.col("lon"), F.col("lat"))
    there = df.select("lon", "lat", e.alias("e"), n.alias("n"))
    lon, lat = geo.utm_to_lonlat(F.col("e"), F.col("n"))
    for r in there.select("lon", "lat", lon.alias("lon2"), lat.alias("lat2")).collect():
        assert abs(r.lon - r.lon2) * 111e3 < 1e-3 and abs(r.lat - r.lat2) * 111e3 < 1e-3


def test_utm_central_meridian(spark):
    e, n = geo.lonlat_to_utm(F.lit(-63.0), F.lit(45.0))
    row = spark.range(1).select(e.alias("e"), n.alias("n")).first()
    assert row.e == 500000.0 and row.n == pytest.approx(4982950.400, abs=1e-3)


def test_points_and_coordinate_systems(spark):
    df = spark.createDataFrame([("500000", "4982950.4"), ("n/a", "1"), (None, "1")], "e string, n string")
    points = as_points(df, "e", "n", 26920)
    assert points.count() == 1 and crs_of(points, "e") == 26920
    geographic = reproject(points, "e", "n")
    row = geographic.first()
    assert row.e == pytest.approx(-63) and row.n == pytest.approx(45, abs=1e-7) and crs_of(geographic, "n") == 4326
    assert reproject(geographic, "e", "n", target=4269).first() == row
    back = reproject(geographic, "e", "n", target=32620).first()
    assert back.e == pytest.approx(500000) and back.n == pytest.approx(4982950.4, abs=1e-3)
    other_zone = reproject(points, "e", "n", target=32621).first()
    assert other_zone.e < 100_000
    with pytest.raises(ValueError):
        reproject(points, "e", "n", target=3857)
    with pytest.raises(ValueError):
        reproject(df, "e", "n")


# --- tables ------------------------------------------------------------------------------------------


def test_read_table_policies(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('name,county,area\nA,,1.5\nB,"",x\nNA,C,NA\n')
    schema = "name string, county string, area double"
    rows = read_table(spark, str(path), schema).collect()
    assert [tuple(r) for r in rows] == [("A", None, 1.5), ("B", None, None), (None, "C", None)]
    kept = read_table(spark, str(path), schema, blank="keep").collect()
    assert kept[1].county == ""


def test_write_table_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("A", 1), (None, 2)], "name string, n int")
    write_table(df, str(tmp_path / "out"))
    back = read_table(spark, str(tmp_path / "out"), "name string, n int")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_column_shaping(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["X", "Surface.Area..ha.", "Site Code", "d"])
    named = tidy.canonical_columns(df, {"d": "depth"})
    assert named.columns == ["x", "surface_area_ha", "site_code", "depth"]
    assert tidy.select_span(named, ("surface_area_ha", "depth")).columns == ["surface_area_ha", "site_code", "depth"]
    assert tidy.relocate(named, ["depth"], after="x").columns[:2] == ["x", "depth"]
    assert tidy.relocate(named, "depth", before="x").columns[0] == "depth"
    assert tidy.drop_index_column(df).columns == df.columns[1:]
    assert tidy.drop_index_column(named, "nothing").columns == named.columns


def test_blank_to_null(spark):
    df = spark.createDataFrame([("", 1), (" ", 2), ("A", 3)], "c string, n int")
    assert values(tidy.blank_to_null(df), "c") == [None, None, "A"]


def test_strict_stack_rejects_other_columns(spark):
    a, b = spark.createDataFrame([(1, 2)], "a int, b int"), spark.createDataFrame([(1,)], "a int")
    assert tidy.stack(a, b).count() == 2
    with pytest.raises(Exception):
        tidy.stack(a, b, fill=False).count()


def test_lengthen_and_widen(spark):
    wide = spark.createDataFrame([(1, "Bass", "", None), (2, None, "Pike", " ")], "id int, Species1 string, species2 string, SPECIES3 string")
    long = tidy.lengthen(wide, "species", "col", "seen")
    assert sorted(map(tuple, long.collect())) == [(1, "Species1", "Bass"), (2, "species2", "Pike")]
    back = tidy.widen(long, ["id"], "seen", {"Bass": "bass", "Eel": "eel"}, F.count(F.lit(1)))
    assert back.columns == ["id", "bass", "eel"]


def test_codes(spark):
    df = spark.createDataFrame([(1, "3, 17,3"), (2, ""), (3, None), (4, "x,99")], "id int, codes string")
    table = spark.createDataFrame([(3.0, "BASS"), (17.0, "pike")], "code double, name string")
    rows = joins.decode(tidy.explode_codes(df, "codes"), "codes", table, "code").collect()
    found = sorted((r.id, r.name or "-") for r in rows)
    assert found == [(1, "BASS"), (1, "BASS"), (1, "pike"), (2, "-"), (3, "-"), (4, "-"), (4, "-")]


def test_null_keys_find_each_other(spark):
    a = spark.createDataFrame([("x", 1), (None, 2), ("z", 3)], "k string, n int")
    b = spark.createDataFrame([("x", 10), (None, 20), (None, 21)], "k string, m int")
    found = sorted((r.n, r.m or 0) for r in joins.left_lookup(a, b, "k").collect())
    assert found == [(1, 10), (2, 20), (2, 21), (3, 0)]
    assert "BroadcastNestedLoop" not in plan(joins.left_lookup(a, b, "k")) and "Cartesian" not in plan(joins.left_lookup(a, b, "k"))
    with pytest.raises(ValueError):
        joins.left_lookup(a, a.withColumn("n", F.lit(0)), "k")


def test_many_keys_with_other_names_keep_fan_out(spark):
    catches = spark.createDataFrame([("L", "d1", 1)], "site string, captured string, n int")
    visits = spark.createDataFrame([("L", "d1", 5.0), ("L", "d1", 6.0)], "site string, assessed string, area double")
    assert joins.left_lookup(catches, visits, {"site": "site", "captured": "assessed"}).count() == 2


def test_self_lookup_of_a_group_table(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 5)], "k string, n int")
    rows = joins.with_group_agg(df, ["k"], F.max("n").alias("top")).collect()
    assert sorted(map(tuple, rows)) == [("a", 1, 3), ("a", 3, 3), ("b", 5, 5)]


def test_full_merge_and_overlay(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None), (None, 7.0)], "k int, x double")
    b = spark.createDataFrame([(2, 5.0), (3, 6.0), (None, 8.0)], "k int, x double")
    merged = {r.k: (r.x_meta, r.x_fish, r.x) for r in joins.full_merge(a, b, ["k"], ["x"]).collect()}
    assert merged == {1: (1.0, None, 1.0), 2: (None, 5.0, 5.0), 3: (None, 6.0, 6.0), None: (7.0, 8.0, 7.0)}
    laid = joins.overlay(a, b, "k", ["x"], F.col("k") == 2)
    assert {r.k: r.x for r in laid.collect()} == {1: 1.0, 2: 5.0, None: 7.0}


def test_top_row_prefers_dated_rows_and_limits_before_the_shuffle(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 1990, 3), ("a", 1990, 2), ("b", None, 4)], "k string, y int, id int")
    best = groups.top_row(df, ["k"], [F.desc_nulls_last("y"), "id"])
    assert plan(best).count("WindowGroupLimit") == 2
    assert sorted(r.id for r in best.collect()) == [2, 4]


def test_first_non_null_and_labels(spark):
    df = spark.createDataFrame(
        [("a", 1, None, "m"), ("a", 2, 5.0, "r"), ("a", 3, 6.0, "m"), ("b", 1, None, "r"), ("c", 1, None, None)],
        "k string, o int, v double, db string",
    )
    assert {r.k: r.v for r in groups.first_non_null(df, ["k"], ["v"], ["o"]).collect()} == {"a": 5.0, "b": None, "c": None}
    labels = df.groupBy("k").agg(groups.source_label("db", "m", "r").alias("s"))
    assert {r.k: r.s for r in labels.collect()} == {"a": "Both", "b": "r Only", "c": "Unknown"}
    joined = groups.joined_values(df, ["k"], "db")
    assert {r.k: r.db for r in joined.collect()} == {"a": "m+r", "b": "r", "c": ""}


def test_crosstab_drops_nulls(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), (None, "x"), ("b", "y")], "r string, c string")
    rows = {r.r: (r.x, r.y) for r in groups.crosstab(df, "r", "c", ["x", "y"]).collect()}
    assert rows == {"a": (1, 0), "b": (0, 1)}
    assert groups.crosstab(df, "r", "c").count() == 2


def test_profile_counts_nulls(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "v double")
    row = groups.column_profile(df, ["v"], [0.5]).first()
    assert (row.n, row.n_null, row.minimum, row.mean, row.maximum, row.q50) == (3, 1, 1.0, 2.0, 3.0, 1.0)


def test_richness_and_breaks(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", None)], "k string, s string")
    assert {r.k: r.richness for r in groups.group_richness(df, ["k"], "s").collect()} == {"a": 2, "b": 0}
    assert values(groups.breaks(spark.range(8), "id"), "break") == [0, 3, 6]


def test_duplicate_groups(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None)], "id int, k string")
    assert sorted((r.id, r.n_rows) for r in groups.duplicate_groups(df, ["k"]).collect()) == [(1, 2), (2, 2), (4, 2), (5, 2)]


def test_record_ids_do_not_depend_on_order_or_partitions(spark):
    rows = [("a", 1), ("a", 1), ("b", None), ("c", 3)]
    df = spark.createDataFrame(rows, "n string, y int")
    ids = sorted(values(groups.with_record_id(df), "record_id"))
    again = groups.with_record_id(spark.createDataFrame(rows[::-1], "n string, y int").repartition(5))
    assert sorted(values(again, "record_id")) == ids and len(set(ids)) == 4


def test_record_ids_of_very_many_copies(spark):
    df = spark.range(250_001).select(F.lit("same").alias("n"))
    marked = groups.with_record_id(df)
    assert marked.select("record_id").distinct().count() == 250_001


def test_global_rank_matches_a_sorted_list(spark):
    names = [f"n{random.Random(i).random():.6f}" for i in range(2000)]
    df = spark.createDataFrame([(n,) for n in names], "n string").distinct()
    ranked = groups.global_rank(df, ["n"])
    assert {r.n: r["rank"] for r in ranked.collect()} == {n: i for i, n in enumerate(sorted(set(names)), 1)}


def test_level_rank_and_lists(spark):
    df = spark.createDataFrame([(1980,), (1970,), (1980,), (None,)], "d int")
    assert sorted(map(str, map(tuple, groups.with_level_rank(df, "d").collect()))) == ["(1970, 1)", "(1980, 2)", "(1980, 2)", "(None, None)"]
    a = spark.createDataFrame([("x",), ("y",), ("y",)], "n string")
    b = spark.createDataFrame([("y",), ("z",), ("w",)], "n string")
    assert sorted(map(tuple, groups.name_diff(a, b, "n").collect())) == [("w", "left"), ("x", "right"), ("z", "left")]
    beside = sorted(map(tuple, groups.side_by_side(a, b, "n").collect()))
    assert beside == [(1, "x", "w"), (2, "y", "y"), (3, None, "z")]


def test_overrides_and_decisions(spark):
    df = spark.createDataFrame(
        [(1, "BANOOK", "MORRIS", 7, "confident", "match"), (2, "BANOOK", "OTHER", 8, "confident", "match"), (3, "X", "Y", 9, "unlikely", None)],
        "record_id int, name string, site_name string, code int, match_status string, match_status_confirmed string",
    ).withColumn("match_decision", F.lit(None).cast("string"))
    listed = spark.createDataFrame([("BANOOK", "MORRIS", "bad"), ("BANOOK", "MORRIS", "bad")], "a string, b string, s string")
    out = apply_overrides(df, listed, {"name": "a", "site_name": "b"}, ["code", "site_name"], {"match_status": "s"})
    rows = {r.record_id: (r.code, r.site_name, r.match_status) for r in out.collect()}
    assert rows == {1: (None, None, "bad"), 2: (8, "OTHER", "confident"), 3: (9, "Y", "unlikely")}
    made = spark.createDataFrame([(3, "manual", "match"), (99, "manual", "match")], "record_id int, match_decision string, match_status_confirmed string")
    decided = {r.record_id: r.match_status_confirmed for r in apply_decisions(df, made, order_by=["match_decision", "match_status_confirmed"]).collect()}
    assert decided == {1: "match", 2: "match", 3: "match"}


def test_review_round_trip_over_files(spark, tmp_path):
    cases = spark.createDataFrame([("i1", "unlikely"), ("i2", "confident"), ("i3", "unlikely")], "record_id string, match_status string")
    cases = cases.withColumns({c: F.lit(None).cast("string") for c in ("match_decision", "match_status_confirmed")})
    write_table(review_queue(cases), str(tmp_path / "out"))
    queue = read_table(spark, str(tmp_path / "out"), "record_id string, match_status string, match_decision string, match_status_confirmed string")
    assert sorted(values(queue, "record_id")) == ["i1", "i3"]
    answer = queue.where("record_id = 'i3'").withColumns({"match_decision": F.lit("manual"), "match_status_confirmed": F.lit("match")})
    write_table(answer.select("record_id", "match_decision", "match_status_confirmed"), str(tmp_path / "back"))
    settled = apply_decisions(cases, read_table(spark, str(tmp_path / "back"), DECISIONS))
    assert {r.record_id: r.match_status_confirmed for r in settled.collect()} == {"i1": None, "i2": None, "i3": "match"}


# --- nearest -----------------------------------------------------------------------------------------


def brute_nearest(points, sites, limit=None):
    best = {}
    for pid, px, py in points:
        if px is None or py is None:
            continue
        options = [
            (math.sqrt((sx - px) * (sx - px) + (sy - py) * (sy - py)), sid) for sid, sx, sy in sites if sx is not None and sy is not None
        ]
        options = [o for o in options if limit is None or o[0] <= limit]
        if options:
            best[pid] = min(options)
    return best


def check_nearest(spark, points, sites, limit=None):
    p = spark.createDataFrame(points, "pid int, x double, y double").repartition(3)
    s = spark.createDataFrame(sites, "sid int, x double, y double").repartition(3)
    df = nearest_join(p, s, "sid", max_distance_m=limit)
    assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)
    rows = df.collect()
    assert len(rows) == len(points)
    got = {r.pid: (r.distance_m, r.sid) for r in rows if r.sid is not None}
    assert got == brute_nearest(points, sites, limit)


def test_nearest_uniform(spark):
    rng = random.Random(2)
    sites = [(i, rng.uniform(-1e5, 1e5), rng.uniform(-1e5, 1e5)) for i in range(600)]
    points = [(i, rng.uniform(-3e5, 3e5), rng.uniform(-3e5, 3e5)) for i in range(120)]
    check_nearest(spark, points, sites)
    check_nearest(spark, points, sites, 2e4)


def test_nearest_with_a_crowd_of_sites_and_of_points(spark):
    rng = random.Random(3)
    crowd = [(i, 500 + rng.random() * 1e-3, 500 + rng.random() * 1e-3) for i in range(300)]
    sites = crowd + [(1000 + i, rng.uniform(0, 1e6), rng.uniform(0, 1e6)) for i in range(100)]
    points = [(i, 400 + rng.random(), 400.0) for i in range(60)] + [(100 + i, 7e5, 7e5) for i in range(60)]
    check_nearest(spark, points, sites)


def test_nearest_ties_copies_and_missing(spark):
    sites = [(5, 0.0, 0.0), (3, 2.0, 0.0), (4, 2.0, 0.0), (9, None, 1.0)]
    points = [(1, 1.0, 0.0), (2, None, 0.0), (3, 2.0, 0.0), (4, 1e9, 1e9)]
    check_nearest(spark, points, sites)
    check_nearest(spark, points, [(7, 1.0, 1.0)])
    check_nearest(spark, points, sites, 1.0)
    check_nearest(spark, points, [])


def test_nearest_on_integer_grid(spark):
    sites = [(i * 40 + j, float(i), float(j)) for i in range(40) for j in range(40)]
    points = [(k, k % 13 + 0.5, k % 17 + 0.5) for k in range(100)]
    check_nearest(spark, points, sites)


def test_nearest_is_inclusive_at_the_limit(spark):
    check_nearest(spark, [(1, 0.0, 0.0), (2, 0.0, -0.1)], [(1, 0.0, 200.0)], 200)


def test_nearest_beyond_broadcast(spark, monkeypatch):
    monkeypatch.setattr("tarnbook.operators.nearest.BROADCAST_ROWS", 0)
    rng = random.Random(4)
    sites = [(i, rng.gauss(0, 100), rng.gauss(0, 100)) for i in range(500)]
    points = [(i, rng.gauss(0, 300), rng.gauss(0, 300)) for i in range(80)]
    check_nearest(spark, points, sites)


# --- names -------------------------------------------------------------------------------------------


def brute_names(records, sites):
    return {
        (rb, rn, sn)
        for rb, rn in records
        for sb, sn in sites
        if rb is not None and rb == sb and rn and sn and rn.strip() and sn.strip()
        and (rn.upper() in sn.upper() or sn in rn)
    }


def test_partial_names_equal_brute_force(spark):
    rng = random.Random(5)

    def name():
        return " ".join(rng.choice(["BIG", "Lake", "a", "Grand", "St. (A)", "X", "lakeside", "GR"]) for _ in range(rng.randint(1, 3)))

    records = [(rng.choice(["A", "B", None]), name()) for _ in range(60)] + [("A", ""), ("A", None), ("A", "É")]
    sites = [(rng.choice(["A", "B", None]), name()) for _ in range(80)] + [("A", " "), ("A", None), ("A", "L'ÉTANG")]
    r, s = (spark.createDataFrame(x, "block string, name string") for x in (records, sites))
    got = {tuple(x) for x in partial_names(r, s).collect()}
    assert got == brute_names(records, sites)


def test_names_as_patterns(spark):
    r = spark.createDataFrame([("A", "ST MARYS NORTH"), ("A", "STxMARYS"), ("A", "BLACK NORTH")], "block string, name string")
    s = spark.createDataFrame([("A", "ST.MARYS"), ("A", "BLACK (NORTH)"), ("A", "A+B")], "block string, name string")
    got = {(x.record_name, x.site_name) for x in partial_names(r, s, regex=True).collect()}
    assert got == {("ST MARYS NORTH", "ST.MARYS"), ("STxMARYS", "ST.MARYS"), ("BLACK NORTH", "BLACK (NORTH)")}
    assert partial_names(r, s).count() == 0


def test_best_name(spark):
    r = spark.createDataFrame([(1, "A", "Grand"), (2, "A", "grand lake"), (3, "A", "Twin"), (4, "B", "Grand")], "rid int, county string, name string")
    s = spark.createDataFrame(
        [(10, "A", "GRAND LAKE"), (11, "A", "Grand Lake Meadows"), (12, "A", "TWIN"), (13, "A", "Twin"), (14, "A", "Twins")],
        "sid int, site_county string, site_name string",
    )
    best = {x.rid: x.sid for x in name_match(r, s, "rid", "sid", policy="best").collect()}
    assert best == {1: 10, 2: 10, 3: 12}
    every = sorted((x.rid, x.sid) for x in name_match(r, s, "rid", "sid").collect())
    assert every == [(1, 10), (1, 11), (2, 10), (2, 11), (3, 12), (3, 13), (3, 14)]


# --- polygons ----------------------------------------------------------------------------------------


def ring(*corners):
    return [{"x": float(x), "y": float(y)} for x, y in corners]


def make_layer(spark, shapes):
    rows = [(name, rings) for name, rings in shapes.items()]
    return as_layer(spark.createDataFrame(rows, "layer_id string, rings array<array<struct<x:double,y:double>>>"))


SHAPES = {
    "square": [ring((0, 0), (10, 0), (10, 10), (0, 10))],
    "next": [ring((10, 0), (20, 0), (20, 10), (10, 10), (10, 0))],
    "u": [ring((30, 0), (60, 0), (60, 30), (50, 30), (50, 10), (40, 10), (40, 30), (30, 30))],
    "ringed": [ring((100, 100), (200, 100), (200, 200), (100, 200)), ring((120, 120), (120, 180), (180, 180), (180, 120))],
    "huge": [ring((-5000, -5000), (-4000, -5000), (-4000, 9000), (-5000, 9000))],
    "empty": [],
}


def test_points_in_polygons(spark):
    layer = make_layer(spark, SHAPES)
    where = {
        (5, 5): {"square"}, (10, 5): {"square", "next"}, (10, 10): {"square", "next"}, (45, 20): set(), (35, 20): {"u"},
        (45, 10): {"u"}, (45, 10.001): set(), (150, 150): set(), (120, 150): {"ringed"}, (110, 150): {"ringed"},
        (-4500, 8000): {"huge"}, (-3999.9, 0): set(), (0, 10.0001): set(), (60, 30): {"u"},
    }
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(where)] + [(99, None, 1.0)], "pid int, x double, y double")
    got = {}
    for r in spatial_join(points, layer).collect():
        got.setdefault(r.pid, set()).add(r.layer_id)
    assert got == {i: want for i, want in enumerate(where.values()) if want}
    assert {r.pid for r in spatial_join(points, layer, "anti").collect()} == {99} | {i for i, want in enumerate(where.values()) if not want}
    assert {r.layer_id for r in spatial_join(layer, points, "semi").collect()} == {"square", "next", "u", "ringed", "huge"}
    assert spatial_join(points, layer, "semi").count() == len(got)


def test_polygons_equal_rectangle_algebra(spark):
    rng = random.Random(6)
    boxes = {f"b{i}": (x := rng.uniform(0, 1000), y := rng.uniform(0, 1000), x + 10 ** rng.uniform(-1, 3), y + 10 ** rng.uniform(-1, 3)) for i in range(40)}
    layer = make_layer(spark, {k: [ring((a, b), (c, b), (c, d), (a, d))] for k, (a, b, c, d) in boxes.items()})
    points = [(i, rng.uniform(-100, 2000), rng.uniform(-100, 2000)) for i in range(200)]
    df = spark.createDataFrame(points, "pid int, x double, y double")
    got = {(r.pid, r.layer_id) for r in spatial_join(df, layer).collect()}
    assert got == {(i, k) for i, x, y in points for k, (a, b, c, d) in boxes.items() if a <= x <= c and b <= y <= d}


def test_many_pairs_of_few_points_and_polygons_are_made_in_many_tasks(spark):
    """Points and polygons fit a task each, their pairs need not: the table of pairs is made in several."""
    layer = make_layer(spark, {f"b{i}": [ring((i, 0), (i + 50, 0), (i + 50, 50), (i, 50))] for i in range(40)}).coalesce(1)
    points = spark.createDataFrame([(i, 45.0 + i % 4, float(i % 50)) for i in range(200)], "pid int, x double, y double").coalesce(1)
    rows = spatial_join(points, layer).withColumn("task", F.spark_partition_id()).collect()
    assert len(rows) == 200 * 40 and len({(r.pid, r.layer_id) for r in rows}) == 200 * 40
    sizes = [sum(r.task == task for r in rows) for task in {r.task for r in rows}]
    assert len(sizes) > 1 and max(sizes) < len(rows) / 2


def test_dense_points_and_polygons_are_settled_by_cells(spark, monkeypatch):
    """Where nearly all polygons hold nearly all points, few pairs are tested; slanting edges and holes count."""
    rng = random.Random(16)
    shapes = {}
    for i in range(60):
        x, y, r = rng.uniform(0, 20), rng.uniform(0, 20), rng.uniform(60, 90)
        hole = [ring((x + 40, y + 40), (x + 43, y + 40), (x + 41, y + 44))] if i % 2 else []
        shapes[f"s{i}"] = [ring((x, y), (x + r, y + 7), (x + r + 5, y + r), (x + 3, y + r + 9)), *hole]
    layer = make_layer(spark, shapes)
    rows = [(i, rng.uniform(-10, 120), rng.uniform(-10, 120)) for i in range(400)] + [(400 + i, float(s[0][0]["x"]), float(s[0][0]["y"])) for i, s in enumerate(shapes.values())]
    points = spark.createDataFrame(rows, "pid int, x double, y double")
    edges = layer.select("layer_id", polygons.ring_edges(F.col("rings")).alias("e"))
    plain = points.crossJoin(edges).where(polygons.covers(F.col("e"), F.col("x"), F.col("y"))).select("pid", "layer_id").collect()
    want = {(r.pid, r.layer_id) for r in plain}
    found = spatial_join(points, layer)
    assert sorted((r.pid, r.layer_id) for r in found.collect()) == sorted(want) and found.columns == ["pid", "x", "y", "layer_id"]

    tested, met_in = [], polygons._met_in

    def watched(placed, cells, how="inner"):
        out = met_in(placed, cells, how)
        tested.extend([out.count()] if how == "inner" else [])
        return out

    for rounds, a_row in ((polygons._CUTS, 1), (polygons._CUTS, polygons.PAIRS_A_ROW), (0, 0)):
        monkeypatch.setattr(polygons, "_CUTS", rounds)
        monkeypatch.setattr(polygons, "PAIRS_A_ROW", a_row)
        monkeypatch.setattr(polygons, "_met_in", watched)
        assert {r.pid for r in spatial_join(points, layer, "anti").collect()} == {r[0] for r in rows} - {p for p, _ in want}
        assert {r.layer_id for r in spatial_join(layer, points, "semi").collect()} == {s for _, s in want}
    assert len(tested) == 6 and max(tested[:2]) * 20 < len(want)  # without cutting again thousands


def test_points_in_polygons_with_columns_of_one_name_and_repeated_ids(spark):
    square = [ring((0, 0), (10, 0), (10, 10), (0, 10))]
    layer = make_layer(spark, {"a": square, "b": square}).withColumn("x", F.lit("east"))
    points = spark.createDataFrame([(1, 5.0, 5.0), (2, 0.0, 10.0), (2, 0.0, 10.0), (3, None, 1.0), (4, float("inf"), 1.0)], "pid int, x double, y double")
    got = sorted(tuple(r) for r in spatial_join(points, layer).collect())
    assert got == sorted((p, x, y, s, "east") for p, x, y in [(1, 5.0, 5.0), (2, 0.0, 10.0), (2, 0.0, 10.0)] for s in "ab")
    twice = layer.unionByName(layer.where("layer_id = 'a'"))
    assert {(r[0], r[3]) for r in spatial_join(points, twice).collect()} == {(p, s) for p in (1, 2) for s in "ab"}
    assert {r.layer_id for r in spatial_join(twice, points, "semi").collect()} == {"a", "b"}


def crowd(spark, n_places, a_place, n_shapes):
    """Points around a few places, and slanting shapes around them, some with a hole, some of more edges than fit the slots in a cell."""
    rng = random.Random(26)
    shapes = {}
    for i in range(n_shapes):
        x, y, r = rng.uniform(0, 20), rng.uniform(0, 20), rng.uniform(20, 40)
        comb = [(x + r * k / 9, y + r + (k % 2) * 3) for k in range(9, -1, -1)]
        hole = [ring((x + 5, y + 5), (x + 8, y + 5), (x + 6, y + 9))] if i % 2 else []
        shapes[f"s{i}"] = [ring((x, y), (x + r, y + 2), *comb), *hole]
    places = [(rng.uniform(-10, 70), rng.uniform(-10, 70)) for _ in range(n_places)] + [(p["x"], p["y"]) for s in shapes.values() for p in s[0][:3]]
    points = spark.createDataFrame([(len(places) * k + i, *p) for k in range(a_place) for i, p in enumerate(places)], "pid int, x double, y double")
    layer = make_layer(spark, shapes)
    edges = layer.select("layer_id", polygons.ring_edges(F.col("rings")).alias("e"))
    plain = points.crossJoin(edges).where(polygons.covers(F.col("e"), F.col("x"), F.col("y")))
    return points, layer, sorted((r.pid, r.layer_id) for r in plain.select("pid", "layer_id").collect())


@pytest.mark.parametrize("a_place, block, cut", [(1, 10_000_000, 1000), (1, 40, 10), (polygons.SHARED_PLACES, 10_000, 1000), (polygons.SHARED_PLACES, 3, 1000)])
def test_all_pairs_of_points_and_polygons(spark, monkeypatch, a_place, block, cut):
    """Places of their own and shared places; crowded cells and places in blocks; cells that are cut again."""
    points, layer, want = crowd(spark, 300, a_place, 30)
    monkeypatch.setattr(polygons, "FEW_PAIRS", 0)
    monkeypatch.setattr(polygons, "PAIRS_A_TASK", block)
    monkeypatch.setattr(polygons, "POINTS_A_BLOCK", block)
    monkeypatch.setattr(polygons, "POINTS_A_CUT", cut)
    found = spatial_join(points, layer)
    assert sorted((r.pid, r.layer_id) for r in found.collect()) == want and found.columns == ["pid", "x", "y", "layer_id"]


def test_pairs_of_points_and_polygons_are_not_shuffled(spark, monkeypatch):
    """Where points have places of their own, no shuffle has as many rows as the result, and nothing is found in one task."""
    monkeypatch.setattr(polygons, "FEW_PAIRS", 0)
    points, layer, want = crowd(spark, 2000, 1, 80)
    found = spatial_join(points.coalesce(1), layer.coalesce(1))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert 1 <= plan.count("SortMergeJoin") <= 2 and plan.count("Join [") == plan.count("SortMergeJoin")
    assert "Exchange" not in plan[: plan.index("SortMergeJoin")]
    sizes = [r[1] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == len(want) and max(sizes) < len(want) / 2


def test_pairs_with_repeated_ids_and_many_edges_beside_cells(spark, monkeypatch):
    """What is not found by cell is found by place, with the same rows either way."""
    points, layer, _ = crowd(spark, 200, 1, 12)
    star = [(30 + (20 + k % 2) * math.cos(k / 100 * 2 * math.pi), 30 + (20 + k % 2) * math.sin(k / 100 * 2 * math.pi)) for k in range(100)]
    mixed = layer.unionByName(layer.where("layer_id = 's1'")).unionByName(make_layer(spark, {"star": [ring(*star)]}))
    by_place = sorted((r.pid, r.layer_id) for r in spatial_join(points, mixed).collect())
    monkeypatch.setattr(polygons, "FEW_PAIRS", 0)
    assert by_place and sorted((r.pid, r.layer_id) for r in spatial_join(points, mixed).collect()) == by_place
    assert {s for _, s in by_place} >= {"s0", "s1", "star"}


def test_shared_places_are_searched_in_many_tasks(spark):
    layer = make_layer(spark, {f"b{i}": [ring((i, 0), (i + 50, 0), (i + 50, 50), (i, 50))] for i in range(40)}).coalesce(1)
    points = spark.createDataFrame([(i, 45.0 + i % 4, float(i % 50)) for i in range(200)], "pid int, x double, y double").coalesce(1)
    hits = polygons._place_hits(points, layer, "x", "y").withColumn("task", F.spark_partition_id()).collect()
    sizes = [sum(r.task == task for r in hits) for task in {r.task for r in hits}]
    assert len(hits) == 100 * 40 and len(sizes) > 1 and max(sizes) < len(hits) / 2


def test_shapes_touching_a_boundary(spark):
    layer = make_layer(spark, SHAPES)

    def kept(*corners):
        return {r.layer_id for r in spatial_join(layer, make_layer(spark, {"b": [ring(*corners)]}), "semi").collect()}

    assert kept((20, 5), (35, 5), (35, 7), (20, 7)) == {"next", "u"}
    assert kept((42, 15), (48, 15), (48, 25), (42, 25)) == set()  # inside the notch of the u
    assert kept((140, 140), (150, 140), (150, 150), (140, 150)) == set()  # inside the hole
    assert kept((-1e5, -1e5), (1e5, -1e5), (1e5, 1e5), (-1e5, 1e5)) == {"square", "next", "u", "ringed", "huge"}
    assert kept((-4500, 0), (-4400, 0), (-4400, 1), (-4500, 1)) == {"huge"}
    assert kept((-10, 4), (70, 4), (70, 6), (-10, 6)) == {"square", "next", "u"}  # a bar, no corner inside


def test_nearest_with_a_far_coordinate(spark):
    """A junk coordinate costs another grid, and no crowd is left."""
    draw = random.Random(5)
    places = [(i, draw.uniform(0, 1000), draw.uniform(0, 1000)) for i in range(3000)] + [(3000, 1e12, 1e12)]
    sites = spark.createDataFrame(places, "site int, x double, y double")
    box = sites.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x")).alias("span")).first()
    tree = nearest._tree(sites, box)
    assert tree.leaves.count() == 3001
    assert tree.leaves.groupBy("leaf").count().agg(F.max("count")).first()[0] <= nearest.LEAF_SITES
    probes = [(draw.uniform(-10, 1010), draw.uniform(-10, 1010)) for _ in range(50)] + [(1e12, 0.0)]
    got = nearest.nearest_sites(spark.createDataFrame(probes, "px double, py double"), sites).collect()
    for r in got:
        assert r.site == min(places, key=lambda p: ((p[1] - r.px) ** 2 + (p[2] - r.py) ** 2, p[0]))[0]
    assert len(got) == len(probes)


def test_read_table_by_header(spark, tmp_path):
    path = tmp_path / "sites.csv"
    path.write_text("X,Name,County,Area..ha.\n1,GRAND,Queens,5.5\n2,NA,,x\n")
    rows = read_table(spark, str(path), "county string, name string, area_ha double").collect()
    assert [tuple(r) for r in rows] == [("Queens", "GRAND", 5.5), (None, None, None)]
    assert [r.size for r in read_table(spark, str(path), "size double", names={"Area..ha.": "size"}).collect()] == [5.5, None]
    with pytest.raises(ValueError, match="missing"):
        read_table(spark, str(path), "county string, depth double")
    path.write_text("Name,NAME.\na,b\n")
    with pytest.raises(ValueError, match="twice"):
        read_table(spark, str(path), "name string")


def test_doubled_decisions_and_overrides(spark):
    cases = spark.createDataFrame([("a", None, None), ("b", None, None)], "record_id string, match_decision string, match_status_confirmed string")
    made = spark.createDataFrame([("a", "manual", "match", 1), ("a", "manual", "not_a_match", 2), ("z", "manual", "match", 3)], "record_id string, match_decision string, match_status_confirmed string, decided_at int")
    rows = review.apply_decisions(cases, made, order_by=["decided_at"]).collect()
    assert sorted((r.record_id, r.match_status_confirmed) for r in rows) == [("a", "not_a_match"), ("b", None)]
    assert [r.record_id for r in review.orphan_decisions(cases, made).collect()] == ["z"]
    listed = spark.createDataFrame([("a", "second"), ("a", "first")], "record_id string, new string")
    changed = review.apply_overrides(cases, listed, "record_id", [], {"match_decision": "new"}).collect()
    assert sorted((r.record_id, r.match_decision) for r in changed) == [("a", "first"), ("b", None)]


def test_parts_of_a_shape_touch_a_boundary(spark):
    """Every part counts, whichever is written first; so does a boundary inside a shape, and one inside its hole."""
    def square(x, y, size):
        return [(x, y), (x + size, y), (x + size, y + size), (x, y + size)]

    far, near = square(900.0, 900.0, 5.0), square(10.0, 10.0, 2.0)
    around, holed = [square(-50.0, -50.0, 500.0)], [square(-50.0, -50.0, 500.0), square(-20.0, -20.0, 300.0)]
    shapes = [(1, [far, near]), (2, [near, far]), (3, [far]), (4, around), (5, holed)]
    layer = as_layer(spark.createDataFrame(shapes, "layer_id int, rings array<array<struct<x:double,y:double>>>"))
    boundary = as_layer(spark.createDataFrame([(9, [square(0.0, 0.0, 100.0)])], layer.select("layer_id", "rings").schema))
    met = spatial_join(layer, boundary, "semi")
    assert sorted(values(met, "layer_id")) == [1, 2, 4]
    assert "NestedLoop" not in plan(met) and "Cartesian" not in plan(met)


def test_stored_tables_can_be_removed(spark):
    before = remove_scratch(spark)
    stored = cut_lineage(spark.range(5))
    path = scratch_path(spark, "other")
    spark.range(2).write.parquet(path)
    assert before >= 0 and stored.count() == 5 and os.path.isdir(path)
    assert remove_scratch(spark) == 2
    assert not os.path.exists(path) and not os.path.exists(stored.inputFiles()[0].removeprefix("file:"))


def test_shared_folder_comes_from_the_cluster():
    """The configured folder is used and set; on a cluster without one the job stops instead of using a local folder."""
    def session(configured, master, current=None):
        chosen = [current]
        context = SimpleNamespace(
            master=master, getConf=lambda: {"spark.checkpoint.dir": configured}, getCheckpointDir=lambda: chosen[0],
            setCheckpointDir=lambda path: chosen.__setitem__(0, path),
        )
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: configured), sparkContext=context), chosen

    spark, chosen = session("hdfs://shared/jobs", "spark://host:7077")
    assert shared_folder(spark) == "hdfs://shared/jobs" == chosen[0]
    spark, _ = session(None, "spark://host:7077", "hdfs://shared/set-by-the-job")
    assert shared_folder(spark) == "hdfs://shared/set-by-the-job"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session(None, "spark://host:7077")[0])


# --- polygons of many edges ---------------------------------------------------------------------------


def _inside(rings, x, y):
    odd = False
    for r in rings:
        for (x1, y1), (x2, y2) in zip(r, r[1:] + r[:1]):
            side = (x2 - x1) * (y - y1) - (x - x1) * (y2 - y1)
            if side == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                return True
            if (y1 > y) != (y2 > y) and (side > 0) == (y2 > y1):
                odd = not odd
    return odd


def test_shapes_of_many_edges(spark):
    """Cut into cells, with corners and edges on grid lines, holes, a spot where many edges meet, and far from the origin."""
    draw = random.Random(1)

    def coast(cx, cy, size, n, grid=0.0):
        out = []
        for k in range(n):
            reach = size * (0.3 + 0.7 * draw.random())
            p = cx + reach * math.cos(2 * math.pi * k / n), cy + reach * math.sin(2 * math.pi * k / n)
            out.append(tuple(float(round(v / grid) * grid) for v in p) if grid else p)
        return out

    shapes = {i: [coast(draw.uniform(-50, 50), draw.uniform(-50, 50), 40, 200, (0, 1.0, 0.5)[i])] + ([coast(0, 0, 8, 90, 1.0)] if i else []) for i in range(3)}
    shapes[3] = [[(float(k), 16.0 if k % 2 else 0.0) for k in range(129)] + [(128.0, -4.0), (0.0, -4.0)]]
    shapes[4] = [[p for k in range(40) for p in ((0.0, 0.0), (20.0 + k, float(k)), (20.0 + k, k + 0.5))]]
    shapes[5] = [coast(1e9, 1e9, 100, 150)]
    shapes[6] = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]]
    shapes[7] = []
    places = [(draw.uniform(-100, 130), draw.uniform(-100, 100)) for _ in range(600)] + [(float(draw.randint(-70, 130)), float(draw.randint(-60, 60))) for _ in range(600)]
    places += [p for rings in shapes.values() for ring in rings for p in ring[:40]] + [(1e9 + draw.uniform(-90, 90), 1e9 + draw.uniform(-90, 90)) for _ in range(100)]
    places += [(float("nan"), 1.0), (None, 2.0), (float("inf"), 0.0), places[0]]
    rows = [(i, [[{"x": a, "y": b} for a, b in ring] for ring in rings]) for i, rings in shapes.items()]
    layer = polygons.with_box(spark.createDataFrame(rows, f"layer_id long, rings {polygons.RING_TYPE}"))
    points = spark.createDataFrame([(k, *p) for k, p in enumerate(places)], "pid long, x double, y double")
    found = spatial_join(points, layer)
    want = {(k, i) for k, (a, b) in enumerate(places) if a is not None and math.isfinite(a) for i, rings in shapes.items() if _inside(rings, a, b)}
    assert {(r.pid, r.layer_id) for r in found.collect()} == want and found.count() == len(want)
    cells, lists = polygons.cell_table(layer.where("layer_id IN (0, 4)"))
    longest = lists.groupBy("layer_id").agg(F.max(F.size("edges")).alias("n"))
    assert all(r.n <= 2 * polygons.CELL_EDGES for r in longest.collect())  # no row holds a whole shape


# --- k nearest, exact values, quoted text, the log of decisions ---------------------------------------


@pytest.mark.parametrize("k, most", [(2, None), (5, 40.0), (200, None)])
def test_k_nearest_sites(spark, k, most):
    draw = random.Random(k)
    places = [(float(draw.randint(0, 60)), float(draw.randint(0, 60))) for _ in range(90)] + [(7.0, 7.0)] * 60 + [(1e7, 5.0)]
    rows = [(n, *p) for n, p in enumerate(places)]
    asked = [(n, float(draw.randint(-20, 90)), float(draw.randint(-20, 90))) for n in range(50)] + [(98, None, 1.0), (99, 7.0, 7.0)]
    sites, points = spark.createDataFrame(rows, "sid long, sx double, sy double"), spark.createDataFrame(asked, "pid long, x double, y double")
    got = nearest_join(points, sites, "sid", site_xy=("sx", "sy"), max_distance_m=most, k=k).collect()
    want = set()
    for pid, x, y in asked:
        near = sorted((math.sqrt((sx - x) ** 2 + (sy - y) ** 2), sid) for sid, sx, sy in rows) if x is not None else []
        near = [(d, sid) for d, sid in near if most is None or d <= most][:k]
        want |= {(pid, r + 1, sid, round(d, 6)) for r, (d, sid) in enumerate(near)} or {(pid, None, None, None)}
    assert {(r.pid, r.nearest_rank, r.sid, r.distance_m if r.distance_m is None else round(r.distance_m, 6)) for r in got} == want and len(got) == len(want)
    with pytest.raises(ValueError):
        nearest_join(points, sites, "sid", site_xy=("sx", "sy"), k=0)


def test_exact_quantiles(spark, monkeypatch):
    monkeypatch.setattr(groups, "FEW_VALUES", 20)
    draw = random.Random(4)
    rows = [(draw.choice([1.0, 2.0, 2.0, 2.0, draw.random() * 10 ** draw.randint(-5, 8)]), draw.randint(0, 5) if n % 9 else None, None, -n * 1.5) for n in range(3000)]
    df = spark.createDataFrame(rows, "a double, b int, nothing double, c double").repartition(5)
    quantiles = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    got = groups.exact_quantiles(df, ["a", "b", "nothing", "c"], quantiles)
    want = df.agg(*[F.percentile(F.col(c).cast("double"), list(quantiles)).alias(c) for c in ("a", "b", "c")]).first()
    for c in ("a", "b", "c"):
        assert [got[c, q] for q in quantiles] == pytest.approx(want[c], rel=1e-12)
    assert all(got["nothing", q] is None for q in quantiles)


def test_quoted_text_goes_both_ways(spark, tmp_path):
    rows = [(1, 'BIG "BLUE" LAKE, upper', 1.5), (2, "two\nlines, \"both\" quoted", None), (3, None, 2.0), (4, "  blanks  ", 3.0), (5, '"', 4.0), (6, "semi;colon", 5.0)]
    df = spark.createDataFrame(rows, "key long, name string, size double")
    write_table(df.coalesce(1), str(tmp_path / "out"))
    back = read_table(spark, str(tmp_path / "out"), "key long, name string, size double", multi_line=True, malformed="bad")
    assert sorted((r.key, r.name, r.size) for r in back.collect()) == [(1, rows[0][1], 1.5), (2, rows[1][1], None), (3, None, 2.0), (4, "  blanks  ", 3.0), (5, '"', 4.0), (6, "semi;colon", 5.0)]
    assert back.where("bad is not null").count() == 0
    (tmp_path / "short.csv").write_text('Key,Name,Size\n1,"a ""b"", c",2\n2,few\n3,too,many,values\n')
    found = {r.key: (r.name, r.size, r.bad) for r in read_table(spark, str(tmp_path / "short.csv"), "key long, name string, size double", malformed="bad").collect()}
    assert found[1] == ('a "b", c', 2.0, None) and found[2] == ("few", None, "2,few") and found[3][2] == "3,too,many,values"


def test_the_later_decision_counts(spark):
    cases = spark.createDataFrame([(i, None, None) for i in (1, 2, 3)], "record_id int, match_decision string, match_status_confirmed string")
    log = spark.createDataFrame([(1, "manual", "not_a_match", 1), (1, "manual", "match", 2), (2, "manual", "match", 1), (2, "manual", "not_a_match", 3)], "record_id int, match_decision string, match_status_confirmed string, decided_at int")
    now = {r.record_id: r.match_status_confirmed for r in apply_decisions(cases, log).collect()}
    before = {r.record_id: r.match_status_confirmed for r in apply_decisions(cases, log, as_of=1).collect()}
    assert now == {1: "match", 2: "not_a_match", 3: None} and before == {1: "not_a_match", 2: "match", 3: None}
    with pytest.raises(ValueError):
        apply_decisions(cases, log.drop("decided_at"))


def test_orphans_are_relinked_by_content(spark):
    df = spark.createDataFrame([("n1", "A", None), ("n2", "B", "x"), ("n3", "C", "x"), ("n4", "C", "x"), ("k", "K", "x")], "record_id string, name string, county string")
    made = spark.createDataFrame([("o1", "A", None), ("o2", "B", "x"), ("o3", "C", "x"), ("k", "K", "x"), ("o5", "Z", "x")], "record_id string, name string, county string")
    found = {(r.record_id, r.name, r.relinked) for r in review.relink_orphans(df, made, ["name", "county"]).collect()}
    assert found == {("n1", "A", True), ("n2", "B", True), ("o3", "C", False), ("o5", "Z", False)}


def _edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("per", [3, 5])
def test_similar_names_against_all_pairs(spark, per):
    rng = random.Random(per)
    names = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 14))) for _ in range(120)] + [None, "", "  ", "a", "aaaaaaaaaaaa", "aaaaaaaaaa"]
    targets = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 14))) for _ in range(120)] + [None, " ", "a", "aaaaaaaaaaaaa"]
    got = similar_names(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(n,) for n in targets], "name string"), per=per)
    want = {
        (a, b, _edit_distance(a, b)) for a in names for b in targets
        if a and b and a.strip() and b.strip() and _edit_distance(a, b) <= max(len(a), len(b)) // per
    }
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and want


def test_proposed_crosswalk(spark):
    names = spark.createDataFrame([("upper saint jon",), ("upper saint jon",), ("miramichi rivers",), ("nowhere",), (None,), ("",)], "name string")
    targets = spark.createDataFrame([("upper saint john",), ("upper saint joan",), ("miramichi river",), (None,)], "area string")
    rows = {r["name"]: tuple(r)[1:] for r in proposed_crosswalk(names, targets, target="area").collect()}
    assert rows == {
        "upper saint jon": (2, "upper saint joan", 1, 2), "miramichi rivers": (1, "miramichi river", 1, 1), "nowhere": (1, None, None, 0),
    }
    assert proposed_crosswalk(names, targets.limit(0), target="area").where("proposal is not null").count() == 0
    assert proposed_crosswalk(names.limit(0), targets, target="area").count() == 0
    with pytest.raises(ValueError):
        similar_names(names, names, per=2)


def test_clip_to_window(spark):
    """A place inside the window is in the cut shape if and only if it is in the whole one."""
    rng = random.Random(3)
    shapes = []
    for i in range(60):
        turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(rng.randint(3, 12)))
        cx, cy = rng.uniform(-6, 6), rng.uniform(-6, 6)
        outer = [(cx + math.cos(a) * r, cy + math.sin(a) * r) for a in turns for r in [rng.uniform(1, 7)]]
        shapes.append((i, [outer]))
    ring = [(-20.0, -20.0), (20.0, -20.0), (20.0, 20.0), (-20.0, 20.0)]
    shapes += [
        (100, [ring, [(-5.0, -5.0), (-5.0, 5.0), (5.0, 5.0), (5.0, -5.0)]]),  # the window lies in the hole
        (101, [ring]), (102, [[(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 1.0)]]), (103, [[(30.0, 30.0), (31.0, 30.0), (31.0, 31.0)]]),
        (104, []), (105, None), (106, [[(4.0, -1.0), (6.0, -1.0), (6.0, 1.0), (4.0, 1.0)]]),  # touches the window's side only
    ]
    layer = with_box(spark.createDataFrame(shapes, "layer_id long, rings array<array<struct<x:double,y:double>>>"))
    cut = clip_to_window(layer, -4.0, -3.0, 4.0, 3.0)
    places = [(i, rng.uniform(-4, 4), rng.uniform(-3, 3)) for i in range(300)]
    at = spark.createDataFrame(places, "pid long, px double, py double")

    def hits(shapes):
        pairs = shapes.select("layer_id", F.explode(F.array(ring_edges(F.col("rings")))).alias("edges")).crossJoin(at)
        return {(r[0], r[1]) for r in pairs.where(covers(F.col("edges"), F.col("px"), F.col("py"))).select("layer_id", "pid").collect()}

    assert hits(cut) == hits(layer)
    rows = {r["layer_id"]: r for r in cut.collect()}
    assert not {100, 103, 104, 105, 106} & set(rows) and rows[101]["xmin"] == -4.0 and rows[101]["ymax"] == 3.0 and len(rows[101]["rings"]) == 1
    assert [tuple(p) for p in rows[102]["rings"][0]] == shapes[62][1][0]
    assert all(r["xmin"] >= -4 and r["xmax"] <= 4 and r["ymin"] >= -3 and r["ymax"] <= 3 for r in rows.values())
