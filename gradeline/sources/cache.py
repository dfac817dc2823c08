"""Cached lookups as tables: fresh entries, negative entries, and what has to be fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import CACHE_DAYS

#: A stream in JSON as the catalogue service gives it, or the negative entry.
STREAM_JSON = "struct<distance:array<double>,altitude:array<double>,latlng:array<array<double>>,_miss:boolean>"


def decode_streams(raw: DataFrame, json_col: str = "payload") -> DataFrame:
    """raw with distance, altitude, latlng (null if it doesn't fit) and is_miss; broken JSON gives nulls."""
    s = F.from_json(F.col(json_col), STREAM_JSON)
    out = raw.withColumn("_s", s).withColumns({"distance": F.col("_s.distance"), "altitude": F.col("_s.altitude"), "is_miss": F.coalesce(F.col("_s._miss"), F.lit(False))})
    return out.withColumn("latlng", F.when(F.size("_s.latlng") == F.size("distance"), F.col("_s.latlng"))).drop("_s")


def fresh(cache: DataFrame, as_of: Column, days: int = CACHE_DAYS, refresh: bool = False) -> DataFrame:
    """The latest entry of each key, if it is at most so many days old."""
    latest = W.partitionBy("cache_key").orderBy(F.col("fetched_at").desc(), F.col("payload_id").desc())
    young = F.lit(not refresh) & (F.col("fetched_at") >= as_of - F.make_dt_interval(F.lit(days)))
    return cache.withColumn("rn", F.row_number().over(latest)).where((F.col("rn") == 1) & young).drop("rn")


def cached_or_missing(keys: DataFrame, cache: DataFrame, as_of: Column, days: int = CACHE_DAYS) -> DataFrame:
    """keys (cache_key) with state: hit, miss (a negative entry) or fetch, and the payload of a hit."""
    found = fresh(cache, as_of, days).select("cache_key", "payload_id", "is_miss")
    state = F.when(F.col("is_miss").isNull(), "fetch").when(F.col("is_miss"), "miss").otherwise("hit")
    return keys.join(found, "cache_key", "left").select("cache_key", state.alias("state"), F.when(~F.col("is_miss"), F.col("payload_id")).alias("payload_id"))


def lookup(keys: DataFrame, cache: DataFrame, service: DataFrame, as_of: Column, days: int = CACHE_DAYS) -> DataFrame:
    """keys with source (cache, service or none) and payload_id: cached where fresh, else what service (cache_key, payload_id) has."""
    found = cached_or_missing(keys, cache, as_of, days)
    known = found.where("state <> 'fetch'").select("cache_key", F.when(F.col("state") == "hit", "cache").otherwise("none").alias("source"), "payload_id")
    asked = found.where("state = 'fetch'").select("cache_key").join(service.select("cache_key", "payload_id"), "cache_key", "left")
    return known.unionByName(asked.select("cache_key", F.when(F.col("payload_id").isNull(), "none").otherwise("service").alias("source"), "payload_id"))


def fetched_entries(keys: DataFrame, cache: DataFrame, service: DataFrame, as_of: Column, days: int = CACHE_DAYS) -> DataFrame:
    """The entries that a lookup adds to the cache: what it fetched, and a negative entry for each key that has nothing."""
    missing = cached_or_missing(keys, cache, as_of, days).where("state = 'fetch'").select("cache_key")
    asked = missing.join(service.select("cache_key", "payload_id"), "cache_key", "left")
    return asked.select("cache_key", "payload_id", as_of.alias("fetched_at"), F.col("payload_id").isNull().alias("is_miss"))


def write_cache(entries: DataFrame, path: str) -> None:
    """Replaces the cache."""
    entries.write.mode("overwrite").parquet(path)


def clear_cache(spark: SparkSession, path: str) -> bool:
    """Deletes the cache; whether there was one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
