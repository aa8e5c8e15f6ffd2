"""Tail probabilities as column expressions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def student_t_upper(t: Column, df: Column) -> Column:
    """P(T > t) for whole degrees of freedom, by the finite trigonometric series."""
    theta = F.atan(t / F.sqrt(df))
    sin, cos2 = F.sin(theta), F.pow(F.cos(theta), 2)
    odd = df % 2 == 1
    terms = F.when(odd, (df - 1) / 2).otherwise(df / 2).cast("int")
    first = F.when(odd, F.cos(theta)).otherwise(F.lit(1.0))
    # term k+1 over term k: cos^2 * (2k)/(2k+1) for odd df, cos^2 * (2k-1)/(2k) for even df
    grow = lambda k: F.when(odd, 2.0 * k / (2.0 * k + 1.0)).otherwise((2.0 * k - 1.0) / (2.0 * k))
    series = F.when(
        terms > 0,
        F.aggregate(
            F.sequence(F.lit(1), terms),
            F.struct(first.alias("term"), F.lit(0.0).alias("total")),
            lambda a, k: F.struct(
                (a["term"] * cos2 * grow(k)).alias("term"), (a["total"] + a["term"]).alias("total")
            ),
            lambda a: a["total"],
        ),
    ).otherwise(F.lit(0.0))
    inside = F.when(odd, (theta + sin * series) * (2.0 / math.pi)).otherwise(sin * series)
    return F.when(df >= 1, F.lit(0.5) - inside / 2.0)


def normal_upper(z: Column) -> Column:
    """P(Z > z) for z >= 0 by the all-positive erf series; beyond 12 it is zero."""
    x = F.least(F.abs(z), F.lit(12.0)) / math.sqrt(2.0)
    erf = F.aggregate(
        F.sequence(F.lit(1), F.lit(400)),
        F.struct(x.alias("term"), F.lit(0.0).alias("total")),
        lambda a, k: F.struct(
            (a["term"] * 2.0 * x * x / (2.0 * k + 1.0)).alias("term"), (a["total"] + a["term"]).alias("total")
        ),
        lambda a: a["total"] * (2.0 / math.sqrt(math.pi)) * F.exp(-x * x),
    )
    upper = F.greatest((F.lit(1.0) - erf) / 2.0, F.lit(0.0))
    return F.when(z >= 0, upper).otherwise(1.0 - upper)


def _exact_two_sided(u: float, n1: int, n2: int) -> float:
    """Two-sided p of the Mann-Whitney U without ties: counts of rank sums by recurrence."""
    ways = [1] + [0] * (n1 * n2)
    for i in range(1, n1 + 1):
        for s in range(n1 * n2, n2 + i - 1, -1):
            ways[s] -= ways[s - n2 - i]
        for s in range(i, n1 * n2 + 1):
            ways[s] += ways[s - i]
    total = math.comb(n1 + n2, n1)
    top = max(u, n1 * n2 - u)
    return min(1.0, 2.0 * sum(ways[math.ceil(top):]) / total)


@F.pandas_udf(T.DoubleType())
def mann_whitney_exact(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Exact two-sided p for result rows whose smaller sample has at most eight values."""
    for u, n1, n2 in batches:
        yield pd.Series(
            [
                None if pd.isna(a) or min(b, c) > 8 else _exact_two_sided(float(a), int(b), int(c))
                for a, b, c in zip(u, n1, n2)
            ],
            dtype="float64",
        )
