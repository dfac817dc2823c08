"""Sequence functions on arrays: spaced points, reversal, vertical travel, warping and quantile distances.

All are higher-order functions in the JVM; operators.windows has the same scores as a batched kernel.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def linspace(low: Column, high: Column, n: int) -> Column:
    """n evenly spaced values with both ends, each from its own index."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == n - 1, high).otherwise(low + i * (high - low) / (n - 1)))


def reverse_grades(grades: Column) -> Column:
    """The same road run the other way: order and signs turn."""
    return F.transform(F.reverse(grades), lambda g: -g + F.lit(0.0))


def _differences(values: Column) -> Column:
    n = F.size(values) - 1
    return F.zip_with(F.slice(values, 1, n), F.slice(values, 2, n), lambda a, b: b - a)


def gain(values: Column) -> Column:
    return F.aggregate(_differences(values), F.lit(0.0), lambda s, d: s + F.greatest(d, F.lit(0.0)))


def loss(values: Column) -> Column:
    return F.aggregate(_differences(values), F.lit(0.0), lambda s, d: s + F.greatest(-d, F.lit(0.0)))


def dtw(a: Column, b: Column) -> Column:
    """Dynamic time warping with absolute costs over the longer length. One row of the table is carried at a time."""
    inf = F.lit(float("inf"))
    first = F.concat(F.array(F.lit(0.0)), F.transform(b, lambda _: inf))

    def next_row(row: Column, x: Column) -> Column:
        steps = F.zip_with(b, F.sequence(F.lit(0), F.size(b) - 1), lambda y, j: F.struct(F.abs(x - y).alias("c"), F.least(F.get(row, j), F.get(row, j + 1)).alias("m")))
        return F.aggregate(steps, F.array(inf), lambda acc, s: F.concat(acc, F.array(s["c"] + F.least(s["m"], F.element_at(acc, -1)))))

    return F.element_at(F.aggregate(a, first, next_row), -1) / F.greatest(F.size(a), F.size(b))


def quantiles(values: Column, n: int = 100) -> Column:
    """n linear-interpolated quantiles with both ends."""
    ordered, last = F.array_sort(values), F.size(values) - 1

    def at(i: Column) -> Column:
        x = i * last / F.lit(float(n - 1))
        k = F.least(F.floor(x).cast("int"), F.greatest(last - 1, F.lit(0)))
        low = F.get(ordered, k)
        return low + (x - k) * (F.coalesce(F.get(ordered, k + 1), low) - low)

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)


def emd(a: Column, b: Column, n: int = 100) -> Column:
    """Mean absolute difference of quantiles: the distance of two sets of values whatever their order."""
    gaps = F.zip_with(quantiles(a, n), quantiles(b, n), lambda x, y: F.abs(x - y))
    return F.aggregate(gaps, F.lit(0.0), lambda s, d: s + d) / n
