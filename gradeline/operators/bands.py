"""Grade bands: the share of a profile in each, and the one-line text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import GRADE_BANDS


def band_shares(grades: DataFrame) -> DataFrame:
    """profile_id, band_idx, label, share of every band, also the empty ones. Bands are half-open."""
    shares = [F.avg(F.when((F.col("grade") >= low) & (F.col("grade") < high), 1.0).otherwise(0.0)) for low, high, _ in GRADE_BANDS]
    rows = F.array(*[F.struct(F.lit(i).alias("band_idx"), F.lit(label).alias("label"), F.col(f"s{i}").alias("share")) for i, (_, _, label) in enumerate(GRADE_BANDS)])
    wide = grades.groupBy("profile_id").agg(*[s.alias(f"s{i}") for i, s in enumerate(shares)])
    return wide.select("profile_id", F.explode(rows).alias("b")).select("profile_id", "b.*")


def composition(shares: DataFrame) -> DataFrame:
    """profile_id and its bands as text, the largest first, without the empty ones; ties keep the order of the bands."""
    some = F.sort_array(F.collect_list(F.when(F.col("share") > 0, F.struct((-F.col("share")).alias("o"), "band_idx", "label", "share"))))
    text = F.array_join(F.transform("b", lambda x: F.concat(F.bround(x["share"] * 100, 0).cast("int").cast("string"), F.lit("% "), x["label"])), ", ")
    return shares.groupBy("profile_id").agg(some.alias("b")).select("profile_id", text.alias("composition"))
