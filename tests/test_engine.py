"""Goldens, edges and properties of the operators, and the catalogue against its SQL twins."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gradeline.config import MatchConfig
from gradeline.functions import sequences
from gradeline.functions.geo import access_penalty, haversine_m, probe_tier
from gradeline.functions.text import parse_segment_id, slugify, tile_cache_key, xml_escape
from gradeline.operators import bands, profile, spatial, windows
from gradeline.plans import catalogue, search
from gradeline.sources import cache, gpx

SF = "/root/testdata/sf0.001"
A, B = [1.0, 5.0, 2.0, 8.0, 3.0], [1.0, 4.0, 4.0, 2.0, 9.0, 9.0, 3.0]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def points(spark, xs, ys, pid=1):
    return spark.createDataFrame([(pid, i, float(x), float(y)) for i, (x, y) in enumerate(zip(xs, ys))], "profile_id int, seq int, dist_m double, ele_m double")


def test_warping_and_quantile_goldens(spark):
    assert one(spark, sequences.dtw(F.lit(A), F.lit(B))) == pytest.approx(4 / 7)
    assert one(spark, sequences.emd(F.lit(A), F.lit(B))) == pytest.approx(0.8901010101010101)
    assert windows.warp(np.array(A), np.array([B]))[0] == pytest.approx(4 / 7)
    gaps = windows.quantiles(np.sort([A]), 100) - windows.quantiles(np.sort([B]), 100)
    assert np.abs(gaps).mean() == pytest.approx(0.8901010101010101)


grades = st.lists(st.floats(-30, 30), min_size=2, max_size=12)


@given(grades, grades)
def test_warping_properties(a, b):
    a, b = np.array(a), np.array(b)
    d = windows.warp(a, b[None])[0]
    assert windows.warp(a, a[None])[0] == 0
    assert d == pytest.approx(windows.warp(b, a[None])[0])
    assert d == pytest.approx(windows.warp(-a[::-1], -b[::-1][None])[0])


def test_interpolation_takes_the_last_of_equal_knots_and_clamps(spark):
    p = points(spark, [0, 1, 1, 3], [10, 20, 30, 40])
    s = spark.createDataFrame([(1, float(x)) for x in (0, 1, 2, 3, 5, -1)], "profile_id int, x double")
    got = {r["x"]: r["ele_m"] for r in profile.interpolate(s, p, "ele_m").collect()}
    assert got == {0: 10, 1: 30, 2: 35, 3: 40, 5: 40, -1: 10}


def test_profiles_without_length_and_flat_ones(spark):
    assert profile.resample(points(spark, [0], [5]), 100).count() == 0
    assert profile.summary(points(spark, [0], [5])).first()["avg_grade"] is None
    flat = profile.gain_loss(points(spark, [0, 100, 200], [5, 5, 5])).first()
    assert (flat["gain_m"], str(flat["loss_m"])) == (0, "0.0")
    with pytest.raises(ValueError):
        windows.make_target([0.0], [5.0], 100)
    with pytest.raises(ValueError):
        windows.make_target([0.0, 10.0], [5.0, float("nan")], 100)


def test_grades_and_reversal(spark):
    r = profile.resample(points(spark, [0, 100, 200], [0, 10, 0]), 100).orderBy("bin_idx").collect()
    assert [x["grade"] for x in r] == pytest.approx([10, -10])
    assert one(spark, sequences.reverse_grades(sequences.reverse_grades(F.lit([1.0, -2.0])))) == [1, -2]
    up, down = one(spark, sequences.gain(F.lit(A))), one(spark, sequences.loss(F.lit(A)))
    assert (up, down) == (one(spark, sequences.loss(F.reverse(F.lit(A)))), one(spark, sequences.gain(F.reverse(F.lit(A)))))
    assert one(spark, sequences.linspace(F.lit(0.0), F.lit(1.0), 5)) == [0, 0.25, 0.5, 0.75, 1]


def test_band_edges_and_text(spark):
    g = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate([-100, 0, 2, 4, 6, 8, 10, 100])], "profile_id int, bin_idx int, grade double")
    shares = bands.band_shares(g)
    assert [r["share"] for r in shares.orderBy("band_idx").collect()] == [0.125] * 7
    assert bands.composition(shares).first()["composition"].startswith("12% <0%, 12% 0-2%")


def steady_slopes(folder):
    """Events whose gentle profiles climb by as many percent as a band begins with, or not at all: grades on borders."""
    n = range(45, 100)
    rows = [(u * 1000 + i, pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=i), u, 20.0 * (u % 6) * i + 0.37 * (u % 7)) for u in n for i in range(u)]
    pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "value"]).to_parquet(folder / "events.parquet", coerce_timestamps="us")
    return str(folder)


def same_as_sql(spark, folder, name):
    got = catalogue.queries()[name](spark, folder)
    with duckdb.connect() as db:
        db.execute(f"create view events as select * from '{folder}/events.parquet'")
        want = db.execute(f"select {', '.join(got.columns)} from ({catalogue.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


def test_shares_of_grades_on_borders_are_those_of_the_sql(spark, tmp_path):
    same_as_sql(spark, steady_slopes(tmp_path), "grade_bands")


def test_texts_of_grades_on_borders_are_those_of_the_sql(spark, tmp_path):
    same_as_sql(spark, steady_slopes(tmp_path), "composition_text")


@pytest.mark.parametrize("odd", ["null", "'nan'", "'inf'"])
def test_texts_of_tracks_with_odd_elevations_are_those_of_the_sql(spark, tmp_path, odd):
    plain, folder = steady_slopes(tmp_path), tmp_path / "odd"
    folder.mkdir()
    with duckdb.connect() as db:
        db.execute(f"copy (select * replace (case when event_id%7=0 then {odd}::double else value end as value) from '{plain}/events.parquet') to '{folder}/events.parquet'")
    same_as_sql(spark, str(folder), "composition_text")


def test_penalties_and_tiers(spark):
    rows = [(400.0, "found"), (401.0, "found"), (800.0, "found"), (1199.0, "found"), (1200.0, "found"), (None, "none"), (None, "unchecked")]
    df = spark.createDataFrame(rows, "d double, s string").select(access_penalty(F.col("s"), F.col("d"), 400, 1200).alias("p"), probe_tier(F.col("d")).alias("t"))
    assert [r["p"] for r in df.collect()] == [0, 0, 1.25, 2.5, 2.5, 3, 0]
    assert one(spark, probe_tier(F.lit(2500.1))) is None
    assert one(spark, haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))) == pytest.approx(np.pi * 6371000)
    assert one(spark, haversine_m(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(1.0))) is None


def test_text_functions(spark):
    refs = {"123": 123, " 7 ": 7, "https://x/segments/27983261?q": 27983261, "abc": None, "": None}
    for ref, want in refs.items():
        assert one(spark, parse_segment_id(F.lit(ref))) == want
    assert one(spark, slugify(F.lit("Éire / Cañon #2!"))) == "éire_cañon_2"
    assert one(spark, slugify(F.lit("#!"))) is None
    assert one(spark, xml_escape(F.lit("a<b & c>"))) == "a&lt;b &amp; c&gt;"
    assert one(spark, tile_cache_key(F.lit(40.0), F.lit(-105.3), F.lit(1.0), F.lit(2.0))) == "40p0000_m105p3000_1p0000_2p0000.json"


def streams(spark, rows):
    return spark.createDataFrame(rows, "segment_id int, dist array<double>, ele array<double>, lat array<double>, lon array<double>")


def test_window_edges(spark):
    rng = np.random.default_rng(1)
    x = (np.arange(61) * 50.0).tolist()
    y = np.cumsum(rng.normal(0, 3, 61)).tolist()
    t = windows.make_target(x[:21], y[20:41], 200.0)
    c = MatchConfig(min_window_frac=1.0, max_window_frac=1.0, length_steps=1, grade_bin_mi=200 / 1609.34)
    nan = y[:-1] + [float("nan")]
    places = [40.0 + i / 1000 for i in range(61)]
    rows = [(1, x, y, places, places), (2, x, y, None, None), (3, x[:11], y[:11], None, None), (4, x, nan, None, None), (5, [], [], None, None), (6, x[:21], y[:21], places[:3], places[:3])]
    got = {r["segment_id"]: r for r in windows.best_window(streams(spark, rows), t, c).collect()}
    assert sorted(got) == [1, 2, 6]  # too short, missing elevations and empty ones are out; exactly long enough is in
    assert (got[1]["start_m"], got[1]["direction"]) == (1000.0, "forward")
    assert got[1]["score"] == got[2]["score"]
    assert got[1]["start_lat"] == pytest.approx(places[20]) and got[2]["start_lat"] is None and got[6]["start_lat"] is None


def test_reverse_is_found_and_can_be_off(spark):
    x = (np.arange(41) * 50.0).tolist()
    y = np.cumsum(np.random.default_rng(2).normal(1, 3, 41))
    t = windows.make_target(x, (y[::-1]).tolist(), 200.0)
    grid = dict(min_window_frac=1.0, max_window_frac=1.0, length_steps=1, grade_bin_mi=200 / 1609.34)
    s = streams(spark, [(1, x, y.tolist(), None, None)])
    assert windows.best_window(s, t, MatchConfig(**grid)).first()["direction"] == "reverse"
    assert windows.best_window(s, t, MatchConfig(**grid, reversible=False)).first()["direction"] == "forward"


def test_settings_are_checked():
    for bad in (dict(min_window_frac=2.0), dict(weight_gain=-1.0), dict(top=-1), dict(radius_km=0.0), dict(access_near_m=2000.0)):
        with pytest.raises(ValueError):
            MatchConfig(**bad)
    assert MatchConfig().length_fracs == pytest.approx(np.linspace(0.75, 1.15, 7))


def test_tiles_first_wins(spark):
    tiles = spark.createDataFrame([(0, 0.0, 0.0, 1.0, 1.0), (1, 0.0, 1.0, 1.0, 2.0)], "tile_idx int, sw_lat double, sw_lon double, ne_lat double, ne_lon double")
    segs = spark.createDataFrame([(1, "edge", "running", 0.5, 1.0, 0), (2, "out", "running", 3.0, 0.5, 1), (3, "bike", "riding", 0.5, 0.5, 2)], "id int, name string, activity_type string, start_lat double, start_lon double, discovery_idx int")
    assert [(r["id"], r["tile_idx"]) for r in spatial.tile_scan(segs, tiles, MatchConfig()).collect()] == [(1, 0)]


def test_roads_far_and_none(spark):
    starts = spark.createDataFrame([(1, 40.0, -105.0, 0), (2, 10.0, 10.0, 1)], "key int, lat double, lon double, discovery_idx int")
    roads = spark.createDataFrame([(40.001, -105.0)], "lat double, lon double")
    got = {r["key"]: r["road_m"] for r in spatial.nearest_road_any(starts, roads).collect()}
    assert got[1] == pytest.approx(111.19, abs=0.1) and got[2] == pytest.approx(one(spark, haversine_m(F.lit(10.0), F.lit(10.0), F.lit(40.001), F.lit(-105.0))))
    assert spatial.nearest_road_any(starts, roads.limit(0)).where("road_m IS NOT NULL").count() == 0
    tiers = {r["key"]: (r["status"], r["dist_m"]) for r in spatial.road_tiers(starts, roads).collect()}
    assert tiers == {1: ("found", 300.0), 2: ("none", None)}


def test_cache(spark):
    entries = spark.sql("select * from values (1, 10, timestamp'2024-01-01', false), (1, 11, timestamp'2024-01-01', true), (2, 12, timestamp'2023-01-01', false), (3, 13, timestamp'2023-12-02', false) t(cache_key, payload_id, fetched_at, is_miss)")
    keys = spark.createDataFrame([(k,) for k in range(1, 5)], "cache_key int")
    got = {r["cache_key"]: (r["state"], r["payload_id"]) for r in cache.cached_or_missing(keys, entries, F.lit("2024-01-01 00:00:00").cast("timestamp")).collect()}
    assert got == {1: ("miss", None), 2: ("fetch", None), 3: ("hit", 13), 4: ("fetch", None)}
    raw = spark.createDataFrame([('{"distance":[0,1],"altitude":[1,2],"latlng":[[1,2]]}',), ('{"_miss":true}',), ("{",)], "payload string")
    rows = cache.decode_streams(raw).collect()
    assert rows[0]["distance"] == [0, 1] and rows[0]["latlng"] is None and rows[1]["is_miss"] and rows[2]["distance"] is None


def test_gpx_roundtrip(spark, tmp_path):
    s = spark.createDataFrame([(1, "A & <b>", [1.0, 2.0, 3.0], [4.0, 5.0, 6.0], [7.04, 8.06])], "segment_id int, name string, lat array<double>, lon array<double>, ele array<double>")
    gpx.write_gpx(gpx.gpx_lines(s, F.lit(True), "https://example.org"), str(tmp_path / "g"))
    got = gpx.read_gpx(spark, str(tmp_path / "g" / "*")).orderBy("seq").collect()
    assert [(r["lat"], r["lon"], r["ele"], r["name"]) for r in got] == [(3.0, 6.0, 8.1, "A & <b> (reversed)"), (2.0, 5.0, 7.0, "A & <b> (reversed)")]
    assert gpx.export_path("x/y.GPX", "n.gpx") == "x/y.GPX" and gpx.export_path("new", "n.gpx") == "new/n.gpx" and gpx.export_path(None, "n.gpx").endswith("/n.gpx")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows(df):
    cols = sorted(df.columns)
    say = lambda v: "~" if pd.isna(v) else f"{v:.5f}" if isinstance(v, (float, int, np.number)) and not isinstance(v, bool) else str(v)
    return cols, sorted(tuple(map(say, r)) for r in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_catalogue_against_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    assert rows(got.toPandas()) == rows(duck.execute(catalogue.oracle_sql()[name]).df())


def test_search_report(spark):
    blocks = catalogue.queries()["ranked_report"](spark, SF).collect()
    assert [b["rank"] for b in blocks] == list(range(1, len(blocks) + 1)) and all("Scores:" in b["block"] for b in blocks)
    assert search.with_access(spark.range(1).withColumnRenamed("id", "segment_id"), None, MatchConfig()).first()["road_status"] == "not_requested"


def globe(a, b):
    a, b = np.radians(a), np.radians(b)
    h = np.sin((b[0] - a[0]) / 2) ** 2 + np.cos(a[0]) * np.cos(b[0]) * np.sin((b[1] - a[1]) / 2) ** 2
    return 2 * 6371000 * np.arcsin(np.sqrt(min(1, h)))


def test_roads_near_poles_and_across_the_meridian(spark):
    places = [(89.9999, 10.0), (-90.0, 0.0), (10.0, 179.9999), (10.0, -179.9999), (0.0, 0.0), (45.0, 90.0), (None, 1.0)]
    roads = [(89.9998, -170.0), (-89.99, 77.0), (10.0, -179.99995), (0.01, 0.01), (45.0, 95.0)]
    starts = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "key int, lat double, lon double")
    known = spark.createDataFrame(roads, "lat double, lon double")
    for found, most in ((spatial.nearest_road(starts, known, 2500.0), 2500), (spatial.nearest_road_any(starts, known), 1e9)):
        got = {r["key"]: r["road_m"] for r in found.collect()}
        for i, p in enumerate(places):
            d = None if p[0] is None else min(globe(p, r) for r in roads)
            assert got[i] is None if d is None or d > most else got[i] == pytest.approx(d, abs=1e-3)


def test_kernels_and_registered_functions_agree(spark):
    from gradeline.functions import sql

    sql.register(spark)
    rows = spark.createDataFrame([(1, B), (2, A), (3, []), (4, None)], "profile_id int, g array<double>")
    got = {r["profile_id"]: r["dtw"] for r in windows.warp_to(rows, A).collect()}
    assert got[1] == pytest.approx(4 / 7) and got[2] == 0 and got[3] is None and got[4] is None
    want = rows.where("size(g) > 0").select("profile_id", sequences.dtw(F.lit(A), F.col("g")).alias("d"), F.expr(f"dtw_distance(array({','.join(f'{x}D' for x in A)}), g)").alias("e"), F.expr(f"wasserstein_1d(array({','.join(f'{x}D' for x in A)}), g)").alias("w"))
    for r in want.collect():
        assert got[r["profile_id"]] == pytest.approx(r["d"]) == pytest.approx(r["e"])
        assert r["w"] == pytest.approx(0.8901010101010101 if r["profile_id"] == 1 else 0)


def test_irregular_windows_against_plain_sampling(spark):
    rng = np.random.default_rng(5)
    x = np.cumsum(rng.choice([0.0, 3.0, 40.0, 130.0], 80))
    y = np.cumsum(rng.normal(0, 4, 80))
    t = windows.make_target(x[:30] - x[0], y[:30], 300.0)
    c = MatchConfig(grade_bin_mi=300 / 1609.34)
    got = {(r["li"], r["si"]): r for r in windows.window_features(streams(spark, [(1, x.tolist(), y.tolist(), None, None)]), t, c).collect()}
    n = 0
    for li, f in enumerate(np.linspace(0.75, 1.15, 7)):
        length = t.length_m * f
        for si, start in enumerate(np.arange(0, max(x[-1] - length, 0) + 1e-9, max(0.02 * t.length_m, 10.0))):
            s = np.linspace(start, start + length, max(4 * len(t.grades), 100))
            e = np.interp(s, x, y)
            bins = max(2, round(length / 300.0))
            g = np.diff(np.interp(np.linspace(0, length, bins + 1), s - start, e)) / (length / bins) * 100
            d = np.diff(e)
            r = got[li, si]
            assert (r["gain_m"], r["loss_m"], r["first_grade"], r["last_grade"]) == pytest.approx((d[d > 0].sum(), -d[d < 0].sum(), g[0], g[-1]), abs=1e-6)
            n += 1
    assert n == len(got)


def test_search_from_a_file(spark, tmp_path):
    lat = [40.0 + i / 1000 for i in range(31)]
    ele = np.cumsum(np.random.default_rng(3).normal(1, 5, 31)).round(1).tolist()
    s = spark.createDataFrame([(1, "Same", lat, [-105.3] * 31, ele), (2, "Same", lat, [-105.3] * 31, ele)], "segment_id int, name string, lat array<double>, lon array<double>, ele array<double>")
    lines = gpx.gpx_lines(s, F.lit(False), "https://example.org")
    gpx.write_gpx(lines, str(tmp_path / "g"))
    assert gpx.read_gpx(spark, str(tmp_path / "g" / "*")).select("track_id").distinct().count() == 2
    path = gpx.export_gpx(lines.where("segment_id = 1"), str(tmp_path / "new"))
    assert path.endswith("/new/same.gpx") and open(path).read().endswith("</gpx>\n")
    with pytest.raises(ValueError):
        gpx.export_gpx(lines, path)
    target = search.target_of_file(spark, path, MatchConfig())
    dist = [float(globe((a, -105.3), (40.0, -105.3))) for a in lat]
    assert target.length_m == pytest.approx(dist[-1]) and target.grades == pytest.approx(windows.make_target(dist, ele, MatchConfig().bin_m).grades, abs=1e-6)
    segments = spark.createDataFrame([(1, "Same", dist[-1], "running", 40.0, -105.3, 0)], "id int, name string, distance double, activity_type string, start_lat double, start_lon double, discovery_idx int")
    tracks = spark.createDataFrame([(1, dist, ele, lat, [-105.3] * 31)], "segment_id int, dist array<double>, ele array<double>, lat array<double>, lon array<double>")
    roads = spark.createDataFrame([(41.0, -105.3)], "lat double, lon double")
    for exact, status in ((False, "none"), (True, "found")):
        best = search.search(spark, segments, tracks, roads, target, MatchConfig(exact_roads=exact)).first()
        assert (best["segment_id"], best["road_status"]) == (1, status) and best["terrain_score"] < 2
    assert {r["measure"]: r["n"] for r in search.totals(spark, segments, tracks, target, MatchConfig()).collect()} == {"tiles": 64, "candidates": 1, "survivors": 1, "scored": 1}


def test_cache_lookups_are_written_and_cleared(spark, tmp_path):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    entries = spark.sql("select * from values (1, 10, timestamp'2023-12-20', false), (2, 12, timestamp'2023-01-01', false) t(cache_key, payload_id, fetched_at, is_miss)")
    service = spark.createDataFrame([(2, 22)], "cache_key int, payload_id int")
    keys = spark.createDataFrame([(k,) for k in (1, 2, 3)], "cache_key int")
    got = {r["cache_key"]: (r["source"], r["payload_id"]) for r in cache.lookup(keys, entries, service, now).collect()}
    assert got == {1: ("cache", 10), 2: ("service", 22), 3: ("none", None)}
    path = str(tmp_path / "cache")
    cache.write_cache(entries.unionByName(cache.fetched_entries(keys, entries, service, now)), path)
    again = {r["cache_key"]: (r["source"], r["payload_id"]) for r in cache.lookup(keys, spark.read.parquet(path), service.limit(0), now).collect()}
    assert again == {1: ("cache", 10), 2: ("cache", 22), 3: ("none", None)}
    assert cache.clear_cache(spark, path) and not cache.clear_cache(spark, path)
