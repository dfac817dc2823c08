"""The search: candidates in the area, their best windows, road access, and the ranking, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import FEET_PER_MILE, FOOT_PER_M, MILE_M, MatchConfig
from ..functions.geo import access_penalty, access_text
from ..functions.text import segment_url
from ..operators.bands import band_shares, composition
from ..operators.profile import cumulative
from ..operators.spatial import nearest_road_any, road_tiers, tile_grid, tile_scan
from ..operators.windows import Target, best_window, make_target, usable
from ..sources.gpx import read_gpx
from ..sources.shared import written


def target_of(points: DataFrame, c: MatchConfig) -> Target:
    """The target from its points (seq, dist_m, ele_m): one track, held on the driver."""
    rows = points.select("seq", "dist_m", "ele_m").orderBy("seq").collect()
    return make_target([r["dist_m"] for r in rows], [r["ele_m"] for r in rows], c.bin_m)


def track_points(spark: SparkSession, path: str) -> DataFrame:
    """The points of GPX files with dist_m, a profile for each file; gaps between a track's segments count."""
    points = read_gpx(spark, path).select(F.col("track_id").alias("profile_id"), "name", "seq", "lat", "lon", F.col("ele").alias("ele_m"))
    return cumulative(points)


def target_of_file(spark: SparkSession, path: str, c: MatchConfig) -> Target:
    """The target in a GPX file."""
    return target_of(track_points(spark, path), c)


def streams_of(points: DataFrame, track: DataFrame) -> DataFrame:
    """segment_id with dist, ele, lat and lon as arrays, from points and places of the same seq."""
    both = points.join(track.select("profile_id", "seq", "lat", "lon"), ["profile_id", "seq"])
    knots = F.array_sort(F.collect_list(F.struct("seq", "dist_m", "ele_m", "lat", "lon")))
    packed = both.groupBy("profile_id").agg(knots.alias("k"))
    return packed.select(F.col("profile_id").alias("segment_id"), F.col("k.dist_m").alias("dist"), F.col("k.ele_m").alias("ele"), F.col("k.lat").alias("lat"), F.col("k.lon").alias("lon"))


def length_filter(segments: DataFrame, target_m: float, c: MatchConfig) -> DataFrame:
    """Segments whose catalogue length suits the target, both ends included.

    The comparison is in miles; the looser one in metres beside it can be pushed into the scan.
    """
    low, high = c.min_window_frac * (target_m / MILE_M), c.max_segment_mult * (target_m / MILE_M)
    mi = F.col("distance") / MILE_M
    return segments.where(F.col("distance").between(low * MILE_M - 1, high * MILE_M + 1) & mi.between(low, high))


def exact_road(starts: DataFrame, roads: DataFrame) -> DataFrame:
    """key, status and dist_m of the exact source, in whole metres. It has no limit, so no answer means a failed lookup."""
    found = nearest_road_any(starts.select("key", "lat", "lon"), roads)
    return found.select("key", F.when(F.col("road_m").isNull(), "unchecked").otherwise("found").alias("status"), F.bround("road_m", 0).alias("dist_m"))


def with_access(matches: DataFrame, roads: DataFrame | None, c: MatchConfig) -> DataFrame:
    """matches with road_status, road_dist_m and access_penalty, by the exact or the tiered source.

    Without a place, or a check, nothing is asked.
    """
    if roads is None or not c.access_check:
        none = {"road_status": F.lit("not_requested"), "road_dist_m": F.lit(None).cast("double"), "access_penalty": F.lit(0.0)}
        return matches.withColumns(none)
    asked = matches.where("start_lat IS NOT NULL AND start_lon IS NOT NULL").select(F.col("segment_id").alias("key"), F.col("start_lat").alias("lat"), F.col("start_lon").alias("lon"), "discovery_idx")
    found = (exact_road(asked, roads) if c.exact_roads else road_tiers(asked, roads)).select(F.col("key").alias("segment_id"), F.col("status").alias("road_status"), F.col("dist_m").alias("road_dist_m"))
    out = matches.join(found, "segment_id", "left").withColumn("road_status", F.coalesce("road_status", F.lit("not_requested")))
    return out.withColumn("access_penalty", access_penalty(F.col("road_status"), F.col("road_dist_m"), c.access_near_m, c.access_far_m))


def search(spark: SparkSession, segments: DataFrame, streams: DataFrame, roads: DataFrame | None, target: Target, c: MatchConfig, url_base: str = "https://example.org") -> DataFrame:
    """The ranked matches. Rows are taken in order on the executors, so only top rows meet in one task."""
    candidates = length_filter(tile_scan(segments, tile_grid(spark, c), c), target.length_m, c)
    near = streams.join(candidates.select(F.col("id").alias("segment_id")), "segment_id", "left_semi")
    found = best_window(near, target, c).join(candidates.select(F.col("id").alias("segment_id"), "name", "distance", "discovery_idx"), "segment_id")
    found = written(found, "matches")  # a row per candidate, read by the road lookup and again for the ranking
    scored = with_access(found, roads, c).withColumn("final_score", F.col("score") + F.col("access_penalty"))
    best = scored.orderBy("final_score", "discovery_idx").limit(c.top)
    ranked = best.withColumn("rank", F.row_number().over(W.orderBy("final_score", "discovery_idx")))
    grades = ranked.select(F.col("segment_id").alias("profile_id"), F.explode("grade_seq").alias("grade"))
    texts = composition(band_shares(grades)).withColumnRenamed("profile_id", "segment_id")
    start, end = F.col("start_m") / MILE_M, F.col("end_m") / MILE_M
    return ranked.join(texts, "segment_id", "left").select(
        "rank", "segment_id", "name", "final_score", F.col("score").alias("terrain_score"), "access_penalty", "road_status", "road_dist_m",
        access_text(F.col("road_status"), F.col("road_dist_m")).alias("access"),
        F.col("start_m").alias("win_start_m"), F.col("end_m").alias("win_end_m"), start.alias("win_start_mi"), end.alias("win_end_mi"), (end - start).alias("win_len_mi"),
        "gain_ft", "loss_ft", ((F.col("gain_ft") - F.col("loss_ft")) / ((end - start) * FEET_PER_MILE) * 100).alias("net_avg_grade"),
        "direction", F.when(F.col("gain_ft") >= F.col("loss_ft"), "CLIMB").otherwise("DESCENT").alias("leg"),
        "shape_score", "dist_score", "gain_dev", "start_lat", "start_lon", "grade_seq", "composition",
        (F.col("distance") / MILE_M).alias("segment_total_mi"), segment_url(url_base, F.col("segment_id")).alias("url"),
    )


def totals(spark: SparkSession, segments: DataFrame, streams: DataFrame, target: Target, c: MatchConfig) -> DataFrame:
    """measure and n: the tiles of the area, the candidates in them, those of a suitable length, and those that are scored."""
    tiles = tile_grid(spark, c)
    candidates = tile_scan(segments, tiles, c)
    fit = length_filter(candidates, target.length_m, c)
    able = usable(streams, target, c).join(fit.select(F.col("id").alias("segment_id")), "segment_id", "left_semi")
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("measure"), "n") for name, df in (("tiles", tiles), ("candidates", candidates), ("survivors", fit), ("scored", able))]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


def metadata(ids: DataFrame, segments: DataFrame) -> DataFrame:
    """ids with the name of their segment, or one made from the id where the catalogue has none, and whether it has."""
    named = segments.select(F.col("id").alias("segment_id"), F.col("name").alias("_name"))
    own = F.coalesce("_name", F.concat(F.lit("Segment "), F.col("segment_id").cast("string")))
    return ids.join(named, "segment_id", "left").select(*ids.columns, own.alias("name"), F.col("_name").isNotNull().alias("known"))


def report_header(matches: DataFrame) -> DataFrame:
    """The line over the ranks."""
    # Fixed text.
    text = "TOP %d MATCHES (lower combined score = more similar shape + more reachable)"
    return matches.agg(F.format_string(text, F.count("*")).alias("header"))


def report(matches: DataFrame, target_vert_m: float | None = None) -> DataFrame:
    """A text block per rank, in order of rank, with the target's vertical travel where it is given."""
    # Fixed text: the two sentences on direction and leg, and the target's part of the line of gains.
    way = F.when(F.col("direction") == "reverse", F.format_string("Run the segment BACKWARD (%s) \u2014 start at mile %.2f, finish at mile %.2f", "leg", "win_end_mi", "win_start_mi"))
    way = way.otherwise(F.format_string("Run the segment as-recorded (%s) \u2014 mile %.2f to %.2f (%.2f mi)", "leg", "win_start_mi", "win_end_mi", "win_len_mi"))
    wanted = "" if target_vert_m is None else f" (target vertical: {target_vert_m * FOOT_PER_M:.0f} ft)"
    block = F.concat_ws(
        "\n",
        F.format_string("%d. %s  (segment is %.1f mi total)", "rank", "name", "segment_total_mi"),
        F.concat(F.lit("   "), way),
        F.concat(F.format_string("   Gain: %.0f ft | Loss: %.0f ft | Grade: %.1f%%", "gain_ft", "loss_ft", "net_avg_grade"), F.lit(wanted)),
        F.concat(F.lit("   Grade composition: "), F.col("composition")),
        F.format_string("   Scores: shape %.2f | distribution %.2f | gain dev %.0f%% | access %.2f | COMBINED %.2f", "shape_score", "dist_score", F.col("gain_dev") * 100, "access_penalty", "final_score"),
        F.concat(F.lit("   "), F.col("access")),
        F.concat(F.lit("   "), F.col("url")),
    )
    return matches.select("rank", block.alias("block")).orderBy("rank")
