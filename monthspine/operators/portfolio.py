"""Mean-variance value of forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .significance import dm_hln
from .transforms import training_rows, upto_now

# Risk aversion, weight bounds, error gap, least history, decay, annual factor, lags.
GAMMA, BOUNDS, GAP, MIN_HISTORY, ALPHA, ANNUAL, HORIZON = 5.0, (-1.0, 2.0), 11, 12, 0.05, 1.0, 12


def error_variance(df: DataFrame, keys: list[str], error: str, out: str, gap: int = GAP, min_history: int = MIN_HISTORY, alpha: float = ALPHA) -> DataFrame:
    """Exponentially weighted mean of squared errors known ``gap`` + 1 months before, newest first.

    Ages count non-missing errors. Weights are powers of the running error count, whose scale drops
    out of the ratio, so two prefix sums give every month at once.
    """
    seen = F.col(error).isNotNull()
    d = df.withColumn("_n", F.count(error).over(upto_now(keys)).cast("double"))
    w = F.when(seen, F.pow(F.lit(1.0 - alpha), -F.col("_n")))
    d = d.withColumn("_w", w).withColumn("_we", w * F.pow(error, 2))
    past = training_rows(keys, gap)
    value = F.try_divide(F.sum("_we").over(past), F.sum("_w").over(past))
    return d.withColumn(out, F.when(F.count(error).over(past) >= min_history, value)).drop("_n", "_w", "_we")


def weight(forecast: str, variance: str, gamma: float = GAMMA, bounds: tuple[float, float] = BOUNDS) -> Column:
    """Forecast over risk, clipped to the bounds; NULL without variance."""
    raw = F.try_divide(F.col(forecast), gamma * F.col(variance))
    zero_risk = F.when(F.col(forecast) > 0, F.lit(bounds[1])).when(F.col(forecast) < 0, F.lit(bounds[0]))
    w = F.when(F.col(variance) == 0, zero_risk).otherwise(raw)
    return F.when(w.isNotNull(), F.greatest(F.least(w, F.lit(bounds[1])), F.lit(bounds[0])))


def utility(w: str, realised: str, variance: str, gamma: float = GAMMA) -> Column:
    return F.col(w) * F.col(realised) - 0.5 * gamma * F.pow(w, 2) * F.col(variance)


def utilities(df: DataFrame, keys: list[str], gap: int = GAP, min_history: int = MIN_HISTORY, alpha: float = ALPHA, start: str | None = None) -> DataFrame:
    """Weights and utilities of model and benchmark; ``valid`` marks months with every input."""
    d = df.withColumn("_em", F.col("y") - F.col("y_hat")).withColumn("_eb", F.col("y") - F.col("bench"))
    d = error_variance(d, keys, "_em", "var_model", gap, min_history, alpha)
    d = error_variance(d, keys, "_eb", "var_bench", gap, min_history, alpha)
    d = d.withColumn("w_model", weight("y_hat", "var_model")).withColumn("w_bench", weight("bench", "var_bench"))
    d = d.withColumn("u_model", utility("w_model", "y", "var_model")).withColumn("u_bench", utility("w_bench", "y", "var_bench"))
    valid = F.lit(True)
    for c in ["y_hat", "bench", "var_model", "var_bench", "y"]:
        valid = valid & F.col(c).isNotNull()
    if start is not None:
        valid = valid & (F.col("date") >= F.lit(start).cast("date"))
    return d.drop("_em", "_eb").withColumn("valid", valid)


def cer_gain(u: DataFrame, keys: list[str], h: int = HORIZON) -> DataFrame:
    """Certainty-equivalent gain in percent over the benchmark, average weights and its test."""
    mean = lambda c: F.avg(F.when(F.col("valid"), F.col(c)))
    g = u.groupBy(*keys).agg(
        F.count(F.when(F.col("valid"), 1)).alias("obs"),
        (100.0 * ANNUAL * (mean("u_model") - mean("u_bench"))).alias("cer_pct"),
        mean("w_model").alias("avg_w_model"), mean("w_bench").alias("avg_w_bench"),
    )
    d = u.where("valid").withColumn("_d", F.col("u_model") - F.col("u_bench"))
    test = dm_hln(d, keys, "_d", h).select(*keys, "dm_stat", "p_value")
    return g.join(test, keys, "left")


def cer_delta(u: DataFrame, keys: list[str], model: str, a: str, b: str, h: int = HORIZON) -> DataFrame:
    """Utility difference of two models over the months valid for both, with its test."""
    side = lambda m: F.max(F.when(F.col(model) == m, F.col("u_model")))
    pair = (
        u.where(F.col("valid") & F.col(model).isin(a, b)).groupBy(*keys, "date")
        .agg(side(a).alias("ua"), side(b).alias("ub")).where(F.col("ua").isNotNull() & F.col("ub").isNotNull())
        .withColumn("_d", F.col("ua") - F.col("ub"))
    )
    return dm_hln(pair, keys, "_d", h).select(
        *keys, "n", (100.0 * ANNUAL * F.col("mean")).alias("delta_cer_pct"), "dm_stat", "p_value"
    )
