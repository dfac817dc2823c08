"""GPX files as a source and as a sink."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import base_filename, segment_url, xml_escape

_POINT = T.StructType([T.StructField("_lat", T.DoubleType()), T.StructField("_lon", T.DoubleType()), T.StructField("ele", T.DoubleType())])
_SEGMENT = T.StructType([T.StructField("trkpt", T.ArrayType(_POINT))])
_TRACK = T.StructType([T.StructField("name", T.StringType()), T.StructField("trkseg", T.ArrayType(_SEGMENT))])
SCHEMA = T.StructType([T.StructField("trk", T.ArrayType(_TRACK))])


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """track_id (the file), name, trk_idx, seg_idx, pt_idx, lat, lon, ele of all points of all tracks; seq counts them on.

    Routes and waypoints aren't read. Types are given, as whole numbers would be inferred as such.
    """
    files = spark.read.format("xml").option("rowTag", "gpx").schema(SCHEMA).load(path).withColumn("track_id", F.input_file_name())
    tracks = files.select("track_id", F.posexplode("trk").alias("trk_idx", "t"))
    segments = tracks.select("track_id", "trk_idx", "t.name", F.posexplode("t.trkseg").alias("seg_idx", "s"))
    points = segments.select("track_id", "name", "trk_idx", "seg_idx", F.posexplode("s.trkpt").alias("pt_idx", "p"))
    from pyspark.sql import Window as W

    order = W.partitionBy("track_id").orderBy("trk_idx", "seg_idx", "pt_idx")
    return points.select("track_id", "name", "trk_idx", "seg_idx", "pt_idx", F.col("p._lat").alias("lat"), F.col("p._lon").alias("lon"), "p.ele").withColumn("seq", F.row_number().over(order) - 1)


def gpx_lines(streams: DataFrame, reverse: Column, url_base: str) -> DataFrame:
    """streams (segment_id, name, lat, lon, ele as arrays) with lines, the lines of a GPX file.

    Arrays of unequal length are cut to the shortest. Streams without places give no row.
    """
    n = F.least(F.size("lat"), F.size("lon"), F.size("ele"))
    source = streams.where((F.size("lat") > 0) & (F.size("lon") > 0)).withColumn("rev", reverse)
    for c in ("lat", "lon", "ele"):
        source = source.withColumn(c, F.when(F.col("rev"), F.reverse(c)).otherwise(F.col(c)))
    points = F.slice(F.arrays_zip("lat", "lon", "ele"), 1, n)
    title = F.concat(F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit("Segment "), F.col("segment_id").cast("string"))), F.when(F.col("rev"), " (reversed)").otherwise(""))
    # The lines of the layout.
    head = F.array(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>'),
        F.lit('<gpx version="1.1" creator="gradeline" xmlns="http://www.topografix.com/GPX/1/1">'),
        F.lit("  <trk>"),
        F.concat(F.lit("    <name>"), xml_escape(title), F.lit("</name>")),
        F.concat(F.lit('    <link href="'), segment_url(url_base, F.col("segment_id")), F.lit('"/>')),
        F.lit("    <type>running</type>"),
        F.lit("    <trkseg>"),
    )
    body = F.transform(points, lambda p: F.format_string('      <trkpt lat="%.6f" lon="%.6f"><ele>%.1f</ele></trkpt>', F.bround(p["lat"], 6), F.bround(p["lon"], 6), F.bround(p["ele"], 1)))
    tail = F.array(F.lit("    </trkseg>"), F.lit("  </trk>"), F.lit("</gpx>"))
    return source.select("segment_id", "name", "rev", F.concat(head, body, tail).alias("lines"))


def write_gpx(lines: DataFrame, folder: str) -> None:
    """One file per segment under folder, each by the task that has its row; the id keeps segments of one name apart."""
    stem = F.regexp_replace(base_filename(F.col("name"), F.col("segment_id"), F.col("rev")), r"\.gpx$", "")
    files = lines.select(F.concat(stem, F.lit("-"), F.col("segment_id").cast("string"), F.lit(".gpx")).alias("file"), F.array_join("lines", "\n").alias("value"))
    files.write.partitionBy("file").text(folder)


def export_gpx(lines: DataFrame, out: str | None = None) -> str:
    """Writes the one segment of lines as a file of the driver, and returns its path: out, or a name of its own there."""
    rows = lines.select(base_filename(F.col("name"), F.col("segment_id"), F.col("rev")).alias("file"), "lines").limit(2).collect()
    if len(rows) != 1:
        raise ValueError("an export needs one segment that has places")
    path = export_path(out, rows[0]["file"])
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join([*rows[0]["lines"], ""]))
    return path


def export_path(out: str | None, name: str) -> str:
    """Where an export goes: nowhere named or a folder, then its own name there; a path that ends in .gpx as it is."""
    if not out:
        return os.path.join(os.getcwd(), name)
    if os.path.isdir(out) or out.endswith(os.sep) or not out.lower().endswith(".gpx"):
        return os.path.join(out, name)
    return out
