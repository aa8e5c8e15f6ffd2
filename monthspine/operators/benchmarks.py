"""Benchmark forecasts of a target (keys, date, y): one window pass, no self-join.

Frames count rows, so the target must hold one row per month and key. A missing outcome inside
a frame makes that benchmark NULL, as a plain mean would.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from .transforms import by_date, training_rows


def complete(y: str, w: WindowSpec, value: Column) -> Column:
    seen = F.count(F.lit(1)).over(w)
    return F.when((seen > 0) & (F.count(y).over(w) == seen), value)


def hist_mean(y: str, keys: list[str], gap: int = 0) -> Column:
    """Mean of the outcomes realised ``gap`` + 1 months before."""
    w = training_rows(keys, gap)
    return complete(y, w, F.avg(y).over(w))


def rolling(y: str, keys: list[str], window: int = 60) -> Column:
    """Mean of the previous ``window`` outcomes."""
    w = by_date(keys).rowsBetween(-window, -1)
    return complete(y, w, F.avg(y).over(w))


def random_walk(y: str, keys: list[str], gap: int = 0) -> Column:
    """The last outcome known."""
    return F.lag(y, gap + 1).over(by_date(keys))


def with_ewma(df: DataFrame, keys: list[str], y: str = "y", halflife: float = 60, out: str = "ewma") -> DataFrame:
    """Exponentially weighted mean of all previous outcomes, seeded with the first.

    Closed form over prefix sums of y(i) * decay^-i, in runs of 500 half-lives of rows: powers start anew in each run, so
    none leaves the double range, and older runs than the one before weigh less than a double's last bit.
    """
    alpha = 1.0 - math.exp(-math.log(2.0) / halflife)
    decay, run = 1.0 - alpha, max(2, int(500 * halflife))
    past = training_rows(keys, 0)
    d = df.withColumn("_i", F.row_number().over(by_date(keys)) - 1).withColumn("_run", F.floor(F.col("_i") / run))
    place = (F.col("_i") % run).cast("double")
    scaled = F.when(F.col("_i") == 0, F.col(y)).otherwise(F.lit(alpha) * F.col(y)) * F.pow(F.lit(decay), -place)
    d = d.withColumn("_w", scaled)
    inside = Window.partitionBy(*keys, "_run").orderBy("date")
    d = d.withColumn("_own", F.coalesce(F.sum("_w").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    d = d.withColumn("_all", F.sum("_w").over(Window.partitionBy(*keys, "_run")))
    before = F.coalesce(F.lag("_all", run).over(by_date(keys)), F.lit(0.0)) * F.pow(F.lit(decay), F.lit(float(run)))
    value = (F.col("_own") + before) * F.pow(F.lit(decay), place - 1)
    return d.withColumn(out, complete(y, past, value)).drop("_i", "_run", "_w", "_own", "_all")


def with_ar1(df: DataFrame, keys: list[str], y: str = "y", out: str = "ar1") -> DataFrame:
    """Expanding first-order autoregression on all previous outcomes.

    While the lagged outcomes do not vary the least-norm solution is used: the mean outcome scaled
    by (1 + x * x_now) / (1 + x^2).
    """
    past = training_rows(keys, 0)
    d = df.withColumn("_x", F.lag(y).over(by_date(keys)))
    pair = F.col("_x").isNotNull() & F.col(y).isNotNull()
    d = d.withColumn("_px", F.when(pair, F.col("_x"))).withColumn("_py", F.when(pair, F.col(y)))
    slope, icept = F.regr_slope("_py", "_px").over(past), F.regr_intercept("_py", "_px").over(past)
    mx, my = F.avg("_px").over(past), F.avg("_py").over(past)
    d = d.withColumn("_b", slope).withColumn("_a", icept).withColumn("_mx", mx).withColumn("_my", my)
    flat = F.col("_my") * (1.0 + F.col("_mx") * F.col("_x")) / (1.0 + F.col("_mx") * F.col("_mx"))
    value = F.coalesce(F.col("_a") + F.col("_b") * F.col("_x"), flat)
    return d.withColumn(out, complete(y, past, value)).drop("_x", "_px", "_py", "_b", "_a", "_mx", "_my")


BENCHMARKS = ["hist_mean", "ewma", "rolling", "ar1", "zero"]


def with_benchmarks(df: DataFrame, keys: list[str], gap: int = 0, halflife: float = 60, window: int = 60, kinds: list[str] = tuple(BENCHMARKS), y: str = "y") -> DataFrame:
    """Add one column per benchmark. Only the historical mean knows a gap."""
    unknown = set(kinds) - set(BENCHMARKS)
    if unknown:
        raise ValueError(f"unknown benchmark: {sorted(unknown)}")
    out = df
    if "hist_mean" in kinds:
        out = out.withColumn("hist_mean", hist_mean(y, keys, gap))
    if "rolling" in kinds:
        out = out.withColumn("rolling", rolling(y, keys, window))
    if "ewma" in kinds:
        out = with_ewma(out, keys, y, halflife)
    if "ar1" in kinds:
        out = with_ar1(out, keys, y)
    if "zero" in kinds:
        out = out.withColumn("zero", F.lit(0.0))
    return out
