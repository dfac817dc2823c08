"""Connected components of links, by alternating large-star and small-star steps until no link changes.

Each step is a grouped minimum, summed up before it is shuffled, and an equi-join that adaptive execution can split, so
a node with very many links meets in no task. The links of a step are written, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, give_back_driver, written


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first())


def _large(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(links: DataFrame) -> DataFrame:
    """links go from the larger node u to the smaller v."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node but the smallest of each. links: u, v, u <> v."""
    now = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = _state(now)
    while True:
        last, now = now, written(_small(_large(now)), "links")
        discard(last)
        give_back_driver(links.sparkSession)
        state, before = _state(now), state
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
