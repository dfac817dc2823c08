"""Names, keys and identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_segment_id(ref: Column) -> Column:
    """The id in a bare number or a .../segments/<number> address; null where there is none."""
    s = F.trim(ref)
    inside = F.regexp_extract(s, r"/segments/(\d+)", 1)
    return F.when(s.rlike(r"^\d+$"), s.try_cast("bigint")).when(inside != "", inside.try_cast("bigint"))


def slugify(name: Column) -> Column:
    """Letters of any script, digits, _ and - in lower case, runs of blanks as one _; null for what leaves nothing."""
    kept = F.lower(F.trim(F.regexp_replace(name, r"[^\p{L}\p{N}_\s-]", "")))
    return F.nullif(F.regexp_replace(kept, r"\s+", "_"), F.lit(""))


def base_filename(name: Column, segment_id: Column, reverse: Column) -> Column:
    stem = F.coalesce(slugify(name), F.concat(F.lit("segment_"), segment_id.cast("string")))
    return F.concat(stem, F.when(reverse, "_reversed").otherwise(""), F.lit(".gpx"))


def xml_escape(s: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        s = F.replace(s, F.lit(sign), F.lit(name))
    return s


def tile_cache_key(*bounds: Column) -> Column:
    """Four bounds to 4 places, with signs and points that suit a file name."""
    return F.concat(F.translate(F.concat_ws("_", *[F.format_string("%.4f", b) for b in bounds]), "-.", "mp"), F.lit(".json"))


def memo_key(lat: Column, lon: Column) -> Column:
    """A cell of about 11 m that shares one road lookup."""
    return F.struct(F.bround(lat, 4).alias("lat4"), F.bround(lon, 4).alias("lon4"))


def segment_url(base: str, segment_id: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/segments/"), segment_id.cast("string"))
