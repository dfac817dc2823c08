"""Geographic and access functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import EARTH_M, KM_PER_DEGREE, PENALTY_FAR, PENALTY_NONE, ROAD_RADII_M


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres; rounding can't push the root's argument over 1. Null if a coordinate is."""
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))


def km_to_deg_lat(km: Column) -> Column:
    return km / KM_PER_DEGREE


def km_to_deg_lon(km: Column, at_lat: Column) -> Column:
    return km / (F.lit(KM_PER_DEGREE) * F.cos(F.radians(at_lat)))


def access_penalty(status: Column, dist_m: Column, near_m: float, far_m: float) -> Column:
    """0 up to near, then a ramp to PENALTY_FAR at far; PENALTY_NONE where no road was found, 0 where none was sought."""
    ramp = F.bround(PENALTY_FAR * (dist_m - near_m) / (far_m - near_m), 2)
    found = F.when(dist_m <= near_m, 0.0).when(dist_m >= far_m, PENALTY_FAR).otherwise(ramp)
    return F.when(status == "none", PENALTY_NONE).when(status == "found", found).otherwise(0.0)


def access_text(status: Column, dist_m: Column) -> Column:
    none = f"no road within {ROAD_RADII_M[-1] / 1000:g}km"
    return F.when(status == "found", F.format_string("~%dm from a road", F.bround(dist_m, 0).cast("long"))).when(status == "none", none).otherwise("access not confirmed")


def probe_tier(dist_m: Column) -> Column:
    """The smallest probe radius that reaches so far; null beyond the last."""
    out = F.lit(None).cast("double")
    for r in reversed(ROAD_RADII_M):
        out = F.when(dist_m <= r, F.lit(r)).otherwise(out)
    return out
