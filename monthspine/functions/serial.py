"""Moments of one time-ordered array column (one value per month, so bounded by the calendar)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_values(value: Column | str, date: str = "date") -> Column:
    """Aggregate: a group's non-null values in date order."""
    v = F.col(value) if isinstance(value, str) else value
    pairs = F.sort_array(F.collect_list(F.when(v.isNotNull(), F.struct(F.col(date).alias("d"), v.alias("v")))))
    return F.transform(pairs, lambda p: p["v"])


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def lagged_products(e: Column, k: int) -> Column:
    """Sum over t of e(t) * e(t-k)."""
    m = F.greatest(F.size(e) - k, F.lit(0))
    return total(F.zip_with(F.slice(e, F.lit(k + 1), m), F.slice(e, F.lit(1), m), lambda a, b: a * b))


def with_deviations(df: DataFrame, xs: str) -> DataFrame:
    """Add n, mean and the deviations from the mean of an array column."""
    n = F.size(xs)
    out = df.withColumn("n", n.cast("bigint")).withColumn("mean", F.when(n > 0, total(F.col(xs)) / n))
    return out.withColumn("_e", F.transform(xs, lambda x: x - F.col("mean")))


def with_hac_tstat(df: DataFrame, xs: str, lags: int = 12) -> DataFrame:
    """t statistic of the mean under Bartlett-weighted autocovariances, no small-sample factor."""
    d = with_deviations(df, xs)
    s = lagged_products(F.col("_e"), 0)
    for k in range(1, lags + 1):
        s = s + 2.0 * (1.0 - k / (lags + 1.0)) * lagged_products(F.col("_e"), k)
    d = d.withColumn("_s", s)
    return d.withColumn("t_stat", F.when(F.col("_s") > 0, F.col("mean") * F.col("n") / F.sqrt("_s"))).drop("_e", "_s")


def with_long_run_variance(df: DataFrame, xs: str, h: int) -> DataFrame:
    """Add n, mean and the unit-weight long-run variance through lag h-1."""
    d = with_deviations(df, xs)
    v = lagged_products(F.col("_e"), 0)
    for k in range(1, h):
        v = v + 2.0 * lagged_products(F.col("_e"), k)
    return d.withColumn("lrv", F.when(F.col("n") > 0, v / F.col("n"))).drop("_e")


def hln_factor(n: Column, h: int) -> Column:
    """Finite-sample factor (n + 1 - 2h + h(h-1)/n) / n."""
    return (n + 1.0 - 2.0 * h + h * (h - 1.0) / n) / n
