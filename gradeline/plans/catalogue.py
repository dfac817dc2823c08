"""The queries of the engine, one or more for each operator, over the derived tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MILE_M, MatchConfig
from ..functions import sequences
from ..functions import sql as sql_functions
from ..functions.geo import access_penalty, access_text
from ..functions.text import base_filename, parse_segment_id, slugify, tile_cache_key
from ..operators import bands, profile, spatial, windows
from ..sources import cache, gpx
from ..sources.fixtures import table
from ..sources.shared import fresh_path
from . import oracles, search

C = MatchConfig()
URL = "https://example.org"
Query = Callable[[SparkSession, str], DataFrame]


def _r(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison between engines, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: _r(n, digits) for n in names})


def _target(spark: SparkSession, sf: str) -> windows.Target:
    """The first 3,000 m of profile 1."""
    return search.target_of(table(spark, sf, "profile_points").where("profile_id = 1 AND seq <= 30"), C)


def _streams(spark: SparkSession, sf: str) -> DataFrame:
    return search.streams_of(table(spark, sf, "profile_points"), table(spark, sf, "geo_track"))


def _grades(spark: SparkSession, sf: str, name: str = "profile_points") -> DataFrame:
    return profile.resample(table(spark, sf, name), C.bin_m)


def haversine_step(spark, sf):
    return _rounded(profile.steps(table(spark, sf, "geo_track")), "step_m").select("profile_id", "seq", "step_m")


def cumulative_distance(spark, sf):
    return _rounded(profile.cumulative(table(spark, sf, "geo_track")), "dist_m", digits=4).select("profile_id", "seq", "dist_m")


def gain_loss(spark, sf):
    return _rounded(profile.gain_loss(table(spark, sf, "profile_points")), "gain_m", "loss_m", "max_vert_m")


def profile_summary(spark, sf):
    return _rounded(profile.summary(table(spark, sf, "profile_points")), "total_m", "total_mi", "avg_grade")


def interp_asof(spark, sf):
    points = table(spark, sf, "profile_points_irregular")
    ends = points.groupBy("profile_id").agg(F.max("dist_m").alias("m"))
    samples = ends.select("profile_id", F.explode(F.sequence(F.lit(0), F.floor((F.col("m") + 75) / 37.3).cast("int"))).alias("k")).withColumn("x", F.col("k") * 37.3)
    return _rounded(profile.interpolate(samples, points, "ele_m"), "x", "ele_m")


def resample_grades(spark, sf):
    return _rounded(_grades(spark, sf), "grade")


def reverse_profile(spark, sf):
    arrays = profile.grade_arrays(_grades(spark, sf)).withColumn("g", sequences.reverse_grades(F.col("grades")))
    return _rounded(arrays.select("profile_id", F.posexplode("g").alias("bin_idx", "grade")), "grade")


def grade_bands(spark, sf):
    return _rounded(bands.band_shares(_grades(spark, sf, "profile_points_gentle")), "share")


def composition_text(spark, sf):
    return bands.composition(bands.band_shares(_grades(spark, sf, "profile_points_gentle")))


def _pairs(spark, sf):
    """The differences of each profile beside those of profile 0: one row, which every row is held against."""
    packed = profile.packed(table(spark, sf, "embedding_profile"))
    n = F.size("ele") - 1
    d = packed.select("profile_id", F.zip_with(F.slice("ele", 1, n), F.slice("ele", 2, n), lambda a, b: b - a).alias("g"))
    target = d.where("profile_id = 0").first()
    return d.withColumn("t", F.lit([float(x) for x in target["g"]]))


def dtw_pairwise(spark, sf):
    rows = _pairs(spark, sf)
    target = rows.where("profile_id = 0").first()["g"]
    return windows.warp_to(rows, target).select("profile_id", _r("dtw").alias("dtw"))


def emd_pairwise(spark, sf):
    return _pairs(spark, sf).select("profile_id", _r(sequences.emd(F.col("t"), F.col("g"))).alias("emd"))


def window_enumerate(spark, sf):
    lengths = table(spark, sf, "profile_points").groupBy("profile_id").agg(F.max("dist_m").alias("total"))
    return _rounded(windows.enumerate_windows(lengths, _target(spark, sf), C), "start_m", "win_len")


def window_features(spark, sf):
    found = windows.window_features(_streams(spark, sf), _target(spark, sf), C).withColumnRenamed("segment_id", "profile_id")
    return _rounded(found, "gain_m", "loss_m", "first_grade", "last_grade")


def _best(spark, sf, c):
    found = windows.best_window(_streams(spark, sf), _target(spark, sf), c).withColumnRenamed("segment_id", "profile_id")
    return _rounded(found, "score", "start_m", "end_m", "gain_ft", "loss_ft", "shape_score", "dist_score", "gain_dev", "start_lat", "start_lon")


_BEST = ["profile_id", "score", "li", "si", "start_m", "end_m", "gain_ft", "loss_ft", "direction", "shape_score", "dist_score", "gain_dev"]


def best_window(spark, sf):
    return _best(spark, sf, C).select(*_BEST)


def best_window_forward_only(spark, sf):
    return _best(spark, sf, MatchConfig(reversible=False)).select(*_BEST)


def match_start_point(spark, sf):
    return _best(spark, sf, C).select("profile_id", "start_lat", "start_lon")


def tile_grid(spark, sf):
    return _rounded(spatial.tile_grid(spark, C), "sw_lat", "sw_lon", "ne_lat", "ne_lon").withColumn("tile_idx", F.col("tile_idx").cast("int"))


def tile_scan_dedup(spark, sf):
    return spatial.tile_scan(table(spark, sf, "segments"), spatial.tile_grid(spark, C), C).select("id", "name", F.col("tile_idx").cast("int").alias("tile_idx"))


def length_filter(spark, sf):
    found = search.length_filter(table(spark, sf, "segments"), _target(spark, sf).length_m, C)
    return found.select("id", "name", _r("distance").alias("distance"), _r(F.col("distance") / MILE_M).alias("mi"))


def stream_join(spark, sf):
    knots = profile.packed(table(spark, sf, "profile_points")).select(F.col("profile_id").alias("id"), F.size("dist").cast("long").alias("n_knots"), _r(F.element_at("dist", -1)).alias("total_m"))
    return table(spark, sf, "segments").where(F.col("activity_type") == C.activity_type).select("id", "name").join(knots, "id")


def _starts(spark, sf):
    return table(spark, sf, "segments").select(F.col("id").alias("key"), F.col("start_lat").alias("lat"), F.col("start_lon").alias("lon"), "discovery_idx")


def nearest_road(spark, sf):
    return spatial.nearest_road(_starts(spark, sf), table(spark, sf, "roads")).select(F.col("key").alias("id"), _r("road_m").alias("road_m"))


def _far_starts(spark, sf):
    """Starts all over the globe: near the poles, on both sides of the 180th meridian, and on the far side from the roads."""
    return table(spark, sf, "far_starts").select(F.col("id").alias("key"), F.col("start_lat").alias("lat"), F.col("start_lon").alias("lon"))


def nearest_road_exact(spark, sf):
    return search.exact_road(_starts(spark, sf), table(spark, sf, "roads")).withColumnRenamed("key", "id")


def nearest_road_globe(spark, sf):
    return spatial.nearest_road_any(_far_starts(spark, sf), table(spark, sf, "far_roads")).select(F.col("key").alias("id"), _r("road_m", 3).alias("road_m"))


def access_sources(spark, sf):
    """The readings and penalties of both sources."""
    starts, roads = _starts(spark, sf), table(spark, sf, "roads")

    def readings(found, name):
        penalty = access_penalty(F.col("status"), F.col("dist_m"), C.access_near_m, C.access_far_m)
        return found.select(F.col("key").alias("id"), F.col("status").alias(f"{name}_status"), F.col("dist_m").alias(f"{name}_m"), _r(penalty).alias(f"{name}_penalty"))

    return readings(search.exact_road(starts, roads), "exact").join(readings(spatial.road_tiers(starts, roads), "tier"), "id")


def road_tier_probe(spark, sf):
    return spatial.road_tiers(_starts(spark, sf), table(spark, sf, "roads")).withColumnRenamed("key", "id")


def access_penalties(spark, sf):
    r = table(spark, sf, "access_readings")
    return r.select("profile_id", "status", _r(access_penalty(F.col("status"), F.col("dist_m"), C.access_near_m, C.access_far_m)).alias("penalty"), access_text(F.col("status"), F.col("dist_m")).alias("access"))


def matches(spark: SparkSession, sf: str) -> DataFrame:
    """The whole search with the default settings."""
    return search.search(spark, table(spark, sf, "segments"), _streams(spark, sf), table(spark, sf, "roads"), _target(spark, sf), C, URL)


def topk_matches(spark, sf):
    numbers = ["final_score", "terrain_score", "access_penalty", "win_start_m", "win_end_m", "gain_ft", "loss_ft", "net_avg_grade", "shape_score", "dist_score", "gain_dev", "start_lat", "start_lon", "segment_total_mi"]
    names = ["rank", "segment_id", "name", *numbers[:3], "road_status", "road_dist_m", *numbers[3:8], "direction", "leg", *numbers[8:], "url"]
    return _rounded(matches(spark, sf), *numbers).select(*names)


def ranked_report(spark, sf):
    return search.report(matches(spark, sf), _target(spark, sf).vert_m)


def report_header(spark, sf):
    return search.report_header(matches(spark, sf))


def search_totals(spark, sf):
    return search.totals(spark, table(spark, sf, "segments"), _streams(spark, sf), _target(spark, sf), C)


def segment_metadata(spark, sf):
    return search.metadata(parse_ids(spark, sf), table(spark, sf, "segments")).select("ref_id", "segment_id", "name", "known")


def sql_functions_on_roads(spark, sf):
    """The registered functions, called from SQL."""
    sql_functions.register(spark)
    return spark.sql(
        "SELECT road_id, round(haversine_m(40.0D, -105.3D, lat, lon), 4) + 0D AS dist_m, round(km_to_deg_lon(1D, lat), 9) + 0D AS degrees, round(km_to_deg_lat(1D), 9) + 0D AS degrees_lat,"
        " parse_segment_id(concat('x/segments/', cast(road_id AS STRING))) AS again, slugify(concat('Road #', cast(road_id AS STRING), ' / é')) AS slug FROM {roads}",
        roads=table(spark, sf, "roads"),
    )


def sql_tile_grid(spark, sf):
    """The tile grid as a table function."""
    sql_functions.register(spark)
    found = spark.sql(f"SELECT * FROM tile_grid({C.lat}D, {C.lon}D, {C.radius_km}D, {C.box_km}D)")
    return _rounded(found, "sw_lat", "sw_lon", "ne_lat", "ne_lon")


def parse_ids(spark, sf):
    return table(spark, sf, "segment_refs").select("ref_id", parse_segment_id(F.col("ref")).alias("segment_id"))


def slugify_names(spark, sf):
    n = table(spark, sf, "names")
    return n.select("doc_id", slugify(F.col("name")).alias("slug"), base_filename(F.col("name"), F.col("doc_id"), F.col("doc_id") % 2 == 0).alias("file"))


def tile_cache_keys(spark, sf):
    return spatial.tile_grid(spark, C).select(F.col("tile_idx").cast("int").alias("tile_idx"), tile_cache_key(*map(F.col, ("sw_lat", "sw_lon", "ne_lat", "ne_lon"))).alias("cache_key"))


def cache_freshness(spark, sf):
    keys = table(spark, sf, "customer").select(F.col("c_custkey").alias("cache_key"))
    return cache.cached_or_missing(keys, table(spark, sf, "cache_entries"), F.lit("1998-07-15 00:00:00").cast("timestamp"))


def cache_lookup(spark, sf):
    """Customers' payloads: cached ones, else what the service has, here the latest order of each third customer."""
    keys = table(spark, sf, "customer").select(F.col("c_custkey").alias("cache_key"))
    service = table(spark, sf, "orders").where("o_custkey % 3 = 0").groupBy(F.col("o_custkey").alias("cache_key")).agg(F.max("o_orderkey").alias("payload_id"))
    return cache.lookup(keys, table(spark, sf, "cache_entries"), service, F.lit("1998-07-15 00:00:00").cast("timestamp"))


def _gpx(spark, sf):
    places = table(spark, sf, "geo_track").groupBy("profile_id").agg(F.array_sort(F.collect_list(F.struct("seq", "lat", "lon", "ele_m"))).alias("k"))
    arrays = places.select(F.col("profile_id").alias("segment_id"), F.col("k.lat").alias("lat"), F.col("k.lon").alias("lon"), F.col("k.ele_m").alias("ele"))
    named = arrays.join(table(spark, sf, "segments").select(F.col("id").alias("segment_id"), "name"), "segment_id")
    return gpx.gpx_lines(named, F.col("segment_id") % 2 == 0, URL)


def gpx_lines(spark, sf):
    """The lines that hold data: name, link and points."""
    rows = _gpx(spark, sf).select("segment_id", F.posexplode("lines").alias("line_no", "line"))
    return rows.where("line_no IN (3, 4) OR line LIKE '%<trkpt%'")


def gpx_roundtrip(spark, sf):
    """All tracks written as files and read back."""
    folder = fresh_path(spark, "gpx")
    gpx.write_gpx(_gpx(spark, sf), folder)
    points = gpx.read_gpx(spark, f"{folder}/*")
    return points.select("name", "seq", "lat", "lon", "ele")


def gpx_profile(spark, sf):
    """All tracks written as files, read back, and summed up along the way."""
    folder = fresh_path(spark, "gpx")
    gpx.write_gpx(_gpx(spark, sf), folder)
    points = search.track_points(spark, f"{folder}/*")
    names = points.select("profile_id", "name").distinct()
    found = profile.summary(points).join(profile.gain_loss(points), "profile_id").join(names, "profile_id")
    return _rounded(found, "total_m", "gain_m", "loss_m", "avg_grade", digits=4).select("name", "n_points", "total_m", "gain_m", "loss_m", "avg_grade")


def gpx_target(spark, sf):
    """The grades of a target that comes from a file: track 1."""
    folder = fresh_path(spark, "gpx")
    gpx.write_gpx(_gpx(spark, sf).where("segment_id = 1"), folder)
    target = search.target_of_file(spark, f"{folder}/*", C)
    return _rounded(spark.createDataFrame(list(enumerate(target.grades)), "bin_idx int, grade double"), "grade")


def queries() -> dict[str, Query]:
    own = [
        haversine_step, cumulative_distance, gain_loss, profile_summary, interp_asof, resample_grades, grade_bands, composition_text, dtw_pairwise, emd_pairwise, reverse_profile,
        window_enumerate, window_features, best_window, best_window_forward_only, match_start_point, tile_grid, tile_scan_dedup, length_filter, stream_join, nearest_road,
        nearest_road_exact, nearest_road_globe, access_sources, road_tier_probe, topk_matches, ranked_report, report_header, search_totals, segment_metadata, slugify_names,
        cache_freshness, cache_lookup, gpx_lines, gpx_roundtrip, gpx_profile, gpx_target, sql_functions_on_roads, sql_tile_grid,
    ]
    return {f.__name__: f for f in own} | {"access_penalty": access_penalties, "parse_segment_id": parse_ids, "tile_cache_key": tile_cache_keys}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
