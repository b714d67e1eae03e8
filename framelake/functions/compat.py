"""Array-language numerics as column expressions: saturating casts, midpoint percentiles, first-index argmax."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def to_int16(x: Column) -> Column:
    """Rounds half away from zero and saturates; a missing or not-a-number value is 0."""
    clean = F.when(F.isnan(x) | x.isNull(), F.lit(0.0)).otherwise(x.cast("double"))
    return F.least(F.greatest(F.round(clean), F.lit(-32768.0)), F.lit(32767.0)).cast("short")


def nan_to_null(x: Column) -> Column:
    """Not-a-number values as null, so that aggregates skip them."""
    return F.when(~F.isnan(x), x)


def non_negative(x: Column) -> Column:
    """Missing, not-a-number and negative values as 0."""
    return F.when(x.isNull() | F.isnan(x) | (x < 0), F.lit(0.0)).otherwise(x)


def midpoint_percentile(values: Column, percent: float) -> Column:
    """Percentile of an array with the k-th smallest of n at 100 * (k - 0.5) / n, linear between, constant outside."""
    ordered = F.sort_array(F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v)))
    n = F.size(ordered)
    place = F.least(F.greatest(n * (percent / 100.0) + 0.5, F.lit(1.0)), n.cast("double"))
    low = F.floor(place).cast("int")
    high = F.least(low + 1, n)
    a, b = F.element_at(ordered, F.greatest(low, F.lit(1))), F.element_at(ordered, F.greatest(high, F.lit(1)))
    return F.when(n > 0, a + (place - low) * (b - a))


def group_percentile(rows: DataFrame, keys: list[str], value: str, percent: float, name: str) -> DataFrame:
    """``midpoint_percentile`` of each group as column ``name``: its two order statistics are picked by rank, so no group
    is gathered in memory; a group without values has null.  Keys must not be null."""
    clean = rows.where(F.col(value).isNotNull() & ~F.isnan(value))
    sizes = rows.groupBy(*keys).agg(F.count(F.when(~F.isnan(value), F.col(value))).alias("__n"))
    ranked = clean.select(*keys, value, F.row_number().over(Window.partitionBy(*keys).orderBy(value)).alias("__k")).join(sizes, keys)
    place = F.least(F.greatest(F.col("__n") * (percent / 100.0) + 0.5, F.lit(1.0)), F.col("__n").cast("double"))
    low = F.floor(place)
    picked = ranked.withColumn("__p", place - low).where((F.col("__k") == low) | (F.col("__k") == F.least(low + 1, F.col("__n"))))
    found = picked.groupBy(*keys).agg((F.min(value) + F.max("__p") * (F.max(value) - F.min(value))).alias(name))
    return sizes.select(*keys).join(found, keys, "left")


def argmax(value: Column, index: Column) -> Column:
    """Aggregate: the smallest index that has the largest value."""
    return -F.max(F.struct(value.alias("v"), (-index).alias("i")))["i"]


def pearson(x: Column, y: Column) -> Column:
    """Aggregate: correlation, null for a constant side instead of an error."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def tidy(x: Column, digits: int = 6) -> Column:
    """Rounded for comparison, without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def gaussian_weights(length: int) -> list[float]:
    """Normalised window of this length with standard deviation (length - 1) / 5."""
    import math

    half = (length - 1) / 2
    raw = [math.exp(-0.5 * (2.5 * (k - half) / half) ** 2) if half else 1.0 for k in range(length)]
    return [r / sum(raw) for r in raw]
