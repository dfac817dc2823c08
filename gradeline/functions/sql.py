"""The engine's functions for SQL: scalar ones and the tile grid as SQL, so Catalyst inlines them; two on Arrow."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..config import EARTH_M, KM_PER_DEGREE

SCALAR = {
    "haversine_m(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE": f"{2 * EARTH_M!r}D * asin(sqrt(least(1D, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))",
    "km_to_deg_lat(km DOUBLE) RETURNS DOUBLE": f"km / {KM_PER_DEGREE!r}D",
    "km_to_deg_lon(km DOUBLE, at_lat DOUBLE) RETURNS DOUBLE": f"km / ({KM_PER_DEGREE!r}D * cos(radians(at_lat)))",
    "slugify(name STRING) RETURNS STRING": r"nullif(regexp_replace(lower(trim(regexp_replace(name, '[^\\p{L}\\p{N}_\\s-]', ''))), '\\s+', '_'), '')",
    "parse_segment_id(ref STRING) RETURNS BIGINT": r"CASE WHEN trim(ref) RLIKE '^\\d+$' THEN try_cast(trim(ref) AS BIGINT) ELSE try_cast(nullif(regexp_extract(trim(ref), '/segments/(\\d+)', 1), '') AS BIGINT) END",
}
TILES = (
    "tile_grid(lat DOUBLE, lon DOUBLE, radius_km DOUBLE, box_km DOUBLE) RETURNS TABLE (tile_idx INT, sw_lat DOUBLE, sw_lon DOUBLE, ne_lat DOUBLE, ne_lon DOUBLE)",
    f"""SELECT cast(i * n_lon + j AS INT), low_lat + i * s_lat, low_lon + j * s_lon, low_lat + i * s_lat + s_lat, low_lon + j * s_lon + s_lon
 FROM (SELECT *, explode(sequence(0, n_lon - 1)) AS j FROM (SELECT *, explode(sequence(0, n_lat - 1)) AS i FROM (
 SELECT *, cast(ceil((lat + d_lat - low_lat) / s_lat) AS INT) AS n_lat, cast(ceil((lon + d_lon - low_lon) / s_lon) AS INT) AS n_lon FROM (
 SELECT *, lat - d_lat AS low_lat, lon - d_lon AS low_lon FROM (SELECT radius_km / {KM_PER_DEGREE!r}D AS d_lat, radius_km / ({KM_PER_DEGREE!r}D * cos(radians(lat))) AS d_lon,
 box_km / {KM_PER_DEGREE!r}D AS s_lat, box_km / ({KM_PER_DEGREE!r}D * cos(radians(lat))) AS s_lon)))))""",
)


def dtw_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    from ..operators.windows import warp

    return pd.Series([None if x is None or y is None or not len(x) or not len(y) else float(warp(np.asarray(x, float), np.asarray(y, float)[None])[0]) for x, y in zip(a, b)], dtype=object)


def wasserstein_1d(a: pd.Series, b: pd.Series) -> pd.Series:
    from ..operators.windows import quantiles

    def one(x, y) -> float:
        return float(np.abs(quantiles(np.sort(np.asarray(x, float))[None], 100) - quantiles(np.sort(np.asarray(y, float))[None], 100)).mean())

    return pd.Series([None if x is None or y is None or not len(x) or not len(y) else one(x, y) for x, y in zip(a, b)], dtype=object)


def register(spark: SparkSession) -> None:
    """Makes all of them known to the session."""
    for head, body in [*SCALAR.items(), TILES]:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udf.register("dtw_distance", F.pandas_udf(dtw_distance, "double"))
    spark.udf.register("wasserstein_1d", F.pandas_udf(wasserstein_1d, "double"))
