"""Elevation profiles in long form: distances, vertical travel, interpolation and grade bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from ..config import MILE_M
from ..functions.geo import haversine_m

def _by_point() -> WindowSpec:
    return W.partitionBy("profile_id").orderBy("seq")


def steps(points: DataFrame) -> DataFrame:
    """Each point with step_m, its distance from the one before; 0 for the first. Gaps between parts of a track count."""
    last = {c: F.lag(c).over(_by_point()) for c in ("lat", "lon")}
    return points.withColumn("step_m", F.coalesce(haversine_m(last["lat"], last["lon"], F.col("lat"), F.col("lon")), F.lit(0.0)))


def cumulative(points: DataFrame) -> DataFrame:
    """Points with dist_m, the distance along the track."""
    run = _by_point().rowsBetween(W.unboundedPreceding, W.currentRow)
    return steps(points).withColumn("dist_m", F.sum("step_m").over(run)).drop("step_m")


def gain_loss(points: DataFrame) -> DataFrame:
    """gain_m, loss_m and max_vert_m of each profile, from raw differences."""
    d = F.col("ele_m") - F.lag("ele_m").over(_by_point())
    sums = points.select("profile_id", d.alias("d")).groupBy("profile_id").agg(
        F.sum(F.greatest(F.coalesce("d", F.lit(0.0)), F.lit(0.0))).alias("gain_m"), F.sum(F.greatest(-F.coalesce("d", F.lit(0.0)), F.lit(0.0))).alias("loss_m")
    )
    return sums.withColumn("max_vert_m", F.greatest("gain_m", "loss_m"))


def summary(points: DataFrame) -> DataFrame:
    """Points, length and average grade of each profile; the grade of one without length is null."""
    ends = points.groupBy("profile_id").agg(F.count("*").alias("n_points"), F.max("dist_m").alias("total_m"), F.min_by("ele_m", "seq").alias("first_ele"), F.max_by("ele_m", "seq").alias("last_ele"))
    grade = F.when(F.col("total_m") > 0, (F.col("last_ele") - F.col("first_ele")) / F.col("total_m") * 100)
    return ends.select("profile_id", "n_points", "total_m", (F.col("total_m") / MILE_M).alias("total_mi"), grade.alias("avg_grade"))


def stretches(points: DataFrame, *values: str) -> DataFrame:
    """The half-open stretches [x0, x1) between knots, with v0 and v1 of each value; before the first knot and after the
    last the value is constant. Of several knots at one distance the last begins the next stretch."""
    edge = F.lead("dist_m").over(_by_point())
    inner = points.select("profile_id", F.col("dist_m").alias("x0"), edge.alias("x1"), *(c for v in values for c in (F.col(v).alias(f"{v}0"), F.lead(v).over(_by_point()).alias(f"{v}1"))))
    inner = inner.where("x1 IS NULL OR x1 > x0").withColumn("x1", F.coalesce("x1", F.lit(float("inf"))))
    first = points.where("seq = 0").select("profile_id", F.lit(float("-inf")).alias("x0"), F.col("dist_m").alias("x1"), *(c for v in values for c in (F.col(v).alias(f"{v}0"), F.col(v).alias(f"{v}1"))))
    return inner.unionByName(first)


def _placed(samples: DataFrame, points: DataFrame, *values: str) -> DataFrame:
    """samples with _stretch, the last stretch that began, and _closed, the last one that began and isn't endless.

    Samples and stretches stand in one order along the profile: one sort and one running window, however many knots and
    samples a profile has. Samples of unknown profiles go.
    """
    ends = ["x0", "x1", *(f"{v}{i}" for v in values for i in (0, 1))]
    knots = stretches(points, *values).select("profile_id", F.col("x0").alias("x"), F.struct(*ends).alias("_stretch"))
    both = knots.unionByName(samples.withColumn("_sample", F.lit(1)), allowMissingColumns=True)
    so_far = W.partitionBy("profile_id").orderBy("x", F.col("_sample").asc_nulls_first()).rowsBetween(W.unboundedPreceding, W.currentRow)
    last = {"_stretch": F.col("_stretch"), "_closed": F.when(F.col("_stretch.x1") < float("inf"), F.col("_stretch"))}
    found = both.withColumns({name: F.last(s, ignorenulls=True).over(so_far) for name, s in last.items()})
    return found.where("_sample = 1 AND _stretch IS NOT NULL").select(*samples.columns, *last)


def _between(v: str, part: Column) -> Column:
    """The value a part of the way along _stretch; the constant one before the first knot and after the last."""
    v0, v1 = F.col(f"_stretch.{v}0"), F.col(f"_stretch.{v}1")
    inside = v0 + (v1 - v0) * part
    return F.when(v1.isNull() | F.isnan(inside) | (F.col("_stretch.x0") == float("-inf")), v0).otherwise(inside).alias(v)


def interpolate(samples: DataFrame, points: DataFrame, *values: str) -> DataFrame:
    """samples (profile_id, x, ...) with each value of points at x. Samples of unknown profiles go."""
    x0, x1 = F.col("_stretch.x0"), F.col("_stretch.x1")
    return _placed(samples, points, *values).select(*samples.columns, *(_between(v, (F.col("x") - x0) / (x1 - x0)) for v in values))


def bins(points: DataFrame, bin_m: float) -> DataFrame:
    """profile_id, total, n_bins: how many bins of about bin_m each profile gets, two at least."""
    total = points.groupBy("profile_id").agg(F.max("dist_m").alias("total")).where("total > 0")
    return total.withColumn("n_bins", F.greatest(F.lit(2), F.bround(F.col("total") / bin_m).cast("int")))


def _on_grid(s: str) -> Column:
    """Whether a stretch begins at a whole multiple of its length, as all do on a grid that starts at 0."""
    place = F.col(f"{s}.x0") / (F.col(f"{s}.x1") - F.col(f"{s}.x0"))
    return place == F.rint(place)


def resample(points: DataFrame, bin_m: float) -> DataFrame:
    """profile_id, bin_idx, grade: the percent grade of each of equal bins, from elevations interpolated at their edges.

    On an even grid an edge's place is counted in stretches, and the last edge lies at the end of the last stretch, as in
    the SQL: a grade on the border of two bands, such as 0, is off by some 1e-15 either way, which decides its band.
    A bin beside a knot without elevation has the grade null, and NaN and infinity are carried on.
    """
    step, end = F.col("total") / F.col("n_bins"), F.col("i") == F.col("n_bins")
    edges = bins(points, bin_m).select("profile_id", "total", "n_bins", F.explode(F.sequence(F.lit(0), F.col("n_bins"))).alias("i"))
    edges = edges.withColumn("x", F.when(end, F.col("total")).otherwise(F.col("i") * step))
    # a last knot that shares its place with others may have another elevation than the one that ends the stretch
    ends = end & _on_grid("_closed") & (F.col("_closed.ele_m1") == F.col("_stretch.ele_m0"))
    placed = _placed(edges, points, "ele_m").withColumn("_stretch", F.when(ends, F.col("_closed")).otherwise(F.col("_stretch")))
    x0, length = F.col("_stretch.x0"), F.col("_stretch.x1") - F.col("_stretch.x0")
    part = F.when(_on_grid("_stretch"), F.col("i") * step / length - x0 / length).otherwise((F.col("x") - x0) / length)
    inner = (F.col("_stretch.x0") > float("-inf")) & (F.col("_stretch.x1") < float("inf"))
    ele = F.when(inner, F.col("_stretch.ele_m0") + (F.col("_stretch.ele_m1") - F.col("_stretch.ele_m0")) * part).otherwise(F.col("_stretch.ele_m0"))
    found = placed.select(*edges.columns, ele.alias("ele_m")).withColumn("next", F.lead("ele_m").over(W.partitionBy("profile_id").orderBy("i")))
    return found.where("i < n_bins").select("profile_id", F.col("i").alias("bin_idx"), ((F.col("next") - F.col("ele_m")) / step * 100).alias("grade"))


def grade_arrays(grades: DataFrame) -> DataFrame:
    """One row per profile with its grades in order."""
    pairs = F.array_sort(F.collect_list(F.struct("bin_idx", "grade")))
    return grades.groupBy("profile_id").agg(F.transform(pairs, lambda p: p["grade"]).alias("grades"))


def packed(points: DataFrame) -> DataFrame:
    """One row per profile: dist and ele as arrays in order."""
    knots = F.array_sort(F.collect_list(F.struct("seq", "dist_m", "ele_m")))
    return points.groupBy("profile_id").agg(knots.alias("k")).select("profile_id", F.col("k.dist_m").alias("dist"), F.col("k.ele_m").alias("ele"))
