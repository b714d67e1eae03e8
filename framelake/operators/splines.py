"""Splines over traces of any length: basis values and products are native, and only a small system per trace meets in a task.

At a place at most degree + 1 basis functions differ from zero; they are an array column.  The right side of a least-squares
fit is then a sum by (trace, function), the square matrix a sum by (trace, function, function) of a row's own products,
both with partial sums before the shuffle.  What a trace leaves is as large as its knots, not as its frames.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Arrays of (function, value).
BASIS = "array<struct<j:int,b:double>>"


def domain(knots: list[float], degree: int) -> tuple[float, float]:
    """The places where the functions add up to one."""
    return float(knots[degree]), float(knots[len(knots) - degree - 1])


def basis(x: Column, knots: list[float], degree: int, outside: str = "zero") -> Column:
    """The functions of a place that are not zero, with their values (triangular scheme of de Boor).

    ``outside``: places beyond the domain have no functions, or with ``constant`` those of the nearest end.
    """
    low, high = domain(knots, degree)
    at = F.least(F.greatest(x.cast("double"), F.lit(low)), F.lit(high))
    table = F.array(*[F.lit(float(k)) for k in knots])
    # The last span that begins at or before the place, within the domain; empty spans are passed over.
    starts = sorted({float(k): i for i, k in enumerate(knots[degree : len(knots) - degree - 1], degree)}.values())
    span = F.lit(starts[0])
    for i in starts[1:]:
        span = F.when(at >= F.lit(float(knots[i])), F.lit(i)).otherwise(span)

    def scheme(s: Column) -> Column:
        knot = lambda k: F.element_at(table, s["i"] + k + 1)
        values: list[Column] = [F.lit(1.0)]
        for d in range(1, degree + 1):
            saved, after = F.lit(0.0), []
            for r in range(d):
                right, left = knot(r + 1) - s["x"], s["x"] - knot(r + 1 - d)
                part = F.try_divide(values[r], right + left)
                part = F.coalesce(part, F.lit(0.0))
                after.append(saved + right * part)
                saved = left * part
            values = [*after, saved]
        return F.array(*[F.struct((s["i"] - degree + k).cast("int").alias("j"), v.alias("b")) for k, v in enumerate(values)])

    found = F.transform(F.array(F.struct(span.alias("i"), at.alias("x"))), scheme)[0].cast(BASIS)
    if outside == "constant":
        return F.when(x.isNotNull(), found)
    return F.when((x >= low) & (x <= high), found).when(x.isNotNull(), F.array().cast(BASIS))


def products(rows: DataFrame, group: str, x: str, y: str, knots: list[float], degree: int, outside: str = "zero") -> tuple[DataFrame, DataFrame]:
    """(``group``, ``j``, ``by``) and (``group``, ``j``, ``k``, ``bb``), j <= k: the transposed basis times the values, and
    times itself.  Rows without a place or a value are left out."""
    there = F.col(y).isNotNull() & F.col(x).isNotNull()
    own = rows.where(there).select(group, F.col(y).cast("double").alias("y"), basis(F.col(x), knots, degree, outside).alias("own"))
    right = own.select(group, "y", F.inline("own")).groupBy(group, "j").agg(F.sum(F.col("b") * F.col("y")).alias("by"))
    pairs = F.flatten(F.transform("own", lambda p: F.transform(F.filter("own", lambda q: q["j"] >= p["j"]), lambda q: F.struct(p["j"].alias("j"), q["j"].alias("k"), (p["b"] * q["b"]).alias("b")))))
    square = own.select(group, F.inline(pairs)).groupBy(group, "j", "k").agg(F.sum("b").alias("bb"))
    return right, square


def fit(rows: DataFrame, group: str, x: str, y: str, knots: list[float], degree: int, smooth: float = 0.0, outside: str = "zero") -> DataFrame:
    """(``group``, ``j``, ``weight``): least-squares weights of every trace, with ``smooth`` times the squared second
    differences of the weights as penalty.  Weights that neither values nor penalty fix are those of least size."""
    right, square = products(rows, group, x, y, knots, degree, outside)
    n = len(knots) - degree - 1
    rough = np.diff(np.eye(n), 2, axis=0)
    penalty = smooth * rough.T @ rough
    kind = dict(rows.dtypes)[group]

    def of(key: tuple, left: pd.DataFrame, gram: pd.DataFrame) -> pd.DataFrame:
        a, b = penalty.copy(), np.zeros(n)
        b[left["j"].to_numpy(int)] = left["by"]
        j, k, v = gram["j"].to_numpy(int), gram["k"].to_numpy(int), gram["bb"].to_numpy(float)
        a[j, k] += v
        a[k[j != k], j[j != k]] += v[j != k]
        weights = np.linalg.lstsq(a, b, rcond=1e-12)[0]
        return pd.DataFrame({group: [key[0]] * n, "j": np.arange(n, dtype=np.int32), "weight": weights})

    return right.groupBy(group).cogroup(square.groupBy(group)).applyInPandas(of, f"{group} {kind}, j int, weight double")


def evaluate(rows: DataFrame, weights: DataFrame, group: str, x: str, knots: list[float], degree: int, outside: str = "zero") -> DataFrame:
    """``rows`` with the spline's ``value``; 0 beyond the domain unless ``outside`` is ``constant``.

    A trace's weights are one array, as long as its knots, so every place is looked up in its own row.
    """
    arrays = weights.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("j", "weight"))).alias("__w"))
    terms = F.transform(basis(F.col(x), knots, degree, outside), lambda p: p["b"] * F.coalesce(F.try_element_at("__w", p["j"]), F.lit(0.0)))
    return rows.join(arrays, group).withColumn("value", F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)).drop("__w")


def slope(weights: DataFrame, group: str, knots: list[float], degree: int) -> tuple[DataFrame, list[float]]:
    """Weights of the derivative, a spline of one degree less, and its knots."""
    inner = [float(k) for k in knots[1:-1]]
    wide = F.array(*[F.lit(float(b - a)) for a, b in zip(knots[1 : -degree - 1], knots[degree + 1 : -1], strict=True)])
    after = weights.select(group, (F.col("j") - 1).cast("int").alias("j"), F.col("weight").alias("next"))
    both = weights.join(after, [group, "j"])
    rise = degree * (F.col("next") - F.col("weight"))
    step = F.element_at(wide, F.col("j") + 1)
    return both.select(group, "j", F.when(step > 0, rise / step).otherwise(0.0).alias("weight")), inner
